"""SQL of op11, op12 and op13. DuckDB has no crc32, so it is folded over the half bytes of a text's UTF-8 in hexadecimal."""

from __future__ import annotations

#: The remainders of the half bytes, from the polynomial of crc32 with its bits reversed.
_HALF = []
for _n in range(16):
    for _ in range(4):
        _n = (_n >> 1) ^ (0xEDB88320 if _n & 1 else 0)
    _HALF.append(_n)


def crc32(text: str) -> str:
    """The unsigned crc32 of a text. Of each byte the low half comes first."""
    halves = f"list_concat([4294967295::BIGINT], list_transform(range(0, 2 * strlen({text})), lambda i: (strpos('0123456789ABCDEF', substr(hex({text}), (i + 1 - 2 * (i % 2) + 1)::INT, 1)) - 1)::BIGINT))"
    return f"xor(list_reduce({halves}, lambda c, b: xor(c >> 4, ({_HALF}::BIGINT[])[(xor(c, b) & 15) + 1])), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Strings of 200 bytes are taken from blocks of a text's hexadecimal form, so that no cut looks at a whole text.
OP11_SQL = """
WITH texts AS (SELECT doc_id, hex(coalesce(text, '')) AS data FROM documents),
blocks AS (SELECT doc_id, b, substr(data, 2 * b + 1, 2 * (1024 + 199)) AS part FROM (SELECT doc_id, data, unnest(range(0, greatest(0, length(data) // 2 - 199), 1024)) AS b FROM texts)),
starts AS (SELECT doc_id, b + i AS p, md5_number(substr(part, 2 * i + 1, 400)) AS h FROM (SELECT *, unnest(range(0, length(part) // 2 - 199)) AS i FROM blocks)),
again AS (SELECT doc_id, p FROM starts SEMI JOIN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1) USING (h)),
marked AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS opens FROM again),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 200 AS z FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(data, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(data) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(data, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

OP12_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
),
hashed AS (SELECT run, k, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT DISTINCT word, n, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON a.word = b.head || b.tail
    UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON a.word = b.head || b.tail
),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, coalesce((SELECT arg_max(root, step) FROM chain c WHERE c.word = forms.word), word) AS root, n, n_near::BIGINT AS n_near, form_n FROM forms
"""

OP13_SQL = rf"""
WITH texts AS (
    SELECT 's' AS side, doc_id AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
    UNION ALL SELECT 't', item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM benchmark
),
runs AS (
    SELECT side, id, feature, count(*) AS k FROM (
        SELECT side, id, unnest(w) AS feature FROM texts
        UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts) GROUP BY ALL
),
bucket_of AS (SELECT feature, {crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM runs)),
held AS (SELECT bucket, coalesce(sum(k) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(k) FILTER (side = 't'), 0)::BIGINT AS t FROM runs JOIN bucket_of USING (feature) GROUP BY bucket),
gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM held) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM held) + 10000)::DOUBLE)))::BIGINT AS gain FROM held),
weighed AS (SELECT id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS total FROM runs JOIN bucket_of USING (feature) JOIN gained USING (bucket) WHERE side = 's' GROUP BY id),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0) AS weight,
           ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM documents JOIN (SELECT id, w FROM texts WHERE side = 's') ON id = doc_id LEFT JOIN weighed USING (id)
),
drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM drawn WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM drawn LEFT JOIN ranks USING (doc_id)
"""
