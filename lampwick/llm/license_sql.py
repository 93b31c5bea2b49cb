"""The SQL of op1."""

from .license_scan import COPYRIGHT, NAMED, PHRASES, SPELLINGS, catalogue


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _phrases(expr: str) -> str:
    out = f"(' ' || {expr} || ' ')"
    for a, b in PHRASES.items():
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


_MAP = "MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in SPELLINGS.items()) + "}"
_PLAIN = r"trim(regexp_replace(lower(x), '[^\p{L}\p{Nd}]+', ' ', 'g'))"
_LINE = _phrases(f"CASE WHEN regexp_matches(lower(x), {_text(COPYRIGHT)}) OR regexp_matches(x, {_text(NAMED)}) THEN '' ELSE array_to_string(list_transform(string_split({_PLAIN}, ' '), lambda w: coalesce(spelling[w], w)), ' ') END")

OP1_SQL = rf"""
WITH texts AS (
    SELECT doc_id, NULL AS license_id, coalesce(text, '') AS text FROM documents
    UNION ALL
    SELECT NULL, * FROM (VALUES {", ".join(f"({_text(k)}, {_text(v)})" for k, v in catalogue())})
),
lined AS (
    SELECT doc_id, license_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: {_LINE}), lambda y: y <> '') AS lines
    FROM texts, (SELECT {_MAP} AS spelling)
),
digested AS (
    SELECT doc_id, license_id, lines, CASE WHEN len(lines) > 0 THEN sha256({_phrases("array_to_string(lines, ' ')")}) END AS digest FROM lined
),
known AS (SELECT digest, min(license_id) AS license_id FROM digested WHERE license_id IS NOT NULL GROUP BY digest),
docs AS (SELECT doc_id, digest, list_transform(list_distinct(lines), lambda y: sha256(y)) AS units FROM digested WHERE license_id IS NULL),
hits AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM (SELECT doc_id, unnest(units) AS digest FROM docs) JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(h.notices, '') AS notices
FROM docs d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN hits h ON h.doc_id = d.doc_id
"""
