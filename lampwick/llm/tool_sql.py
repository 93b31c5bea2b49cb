"""The SQL of op2: the same log, order, checks and JSON, written out for the five tools."""

OP2_SQL = r"""
WITH RECURSIVE log AS (
    SELECT conv_id, turn, role,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
           to_json(coalesce(text, ''))::VARCHAR AS h,
           (conv_id + turn) % 5 AS pick,
           CASE WHEN conv_id % 4 = 1 THEN turn + (CASE WHEN turn % 2 = 0 THEN 1 ELSE -1 END) ELSE turn END AS pos
    FROM conversations WHERE role = 'assistant' OR (role = 'user' AND turn > 0)
),
calls AS (
    SELECT conv_id, turn, pos, 'c' || turn AS call_id, n, pick, h,
           CASE WHEN turn >= 2 AND (conv_id + turn) % 3 <> 0 THEN turn - 2 END AS parent
    FROM log WHERE role = 'assistant'
),
results AS (SELECT conv_id, turn - 1 AS turn, pos, 'c' || (turn - 1) AS call_id, h FROM log WHERE role = 'user'),
linked AS (
    SELECT c.*, r.pos AS result_pos, greatest(c.pos, coalesce(r.pos, c.pos)) AS last_pos,
           c.parent IS NOT NULL AND p.turn IS NULL AS missing_parent, p.turn AS there
    FROM calls c
    LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn
    LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.parent
),
placed AS (
    SELECT conv_id, turn, pos AS order_pos, last_pos, 0 AS hops FROM linked WHERE there IS NULL
    UNION ALL
    SELECT l.conv_id, l.turn, greatest(l.pos, p.order_pos, p.last_pos), greatest(l.last_pos, p.order_pos, p.last_pos), p.hops + 1
    FROM linked l JOIN placed p ON p.conv_id = l.conv_id AND p.turn = l.there
),
checked AS (
    SELECT l.*, p.order_pos, p.hops,
           CASE pick
               WHEN 0 THEN CASE WHEN n % 7 = 0 THEN 'type:limit' ELSE '' END
               WHEN 1 THEN CASE WHEN n % 5 = 0 THEN 'unlisted:depth' ELSE '' END
               WHEN 2 THEN CASE WHEN n % 3 = 0 THEN 'missing:formal' ELSE '' END
               ELSE '' END AS wrong,
           CASE pick
               WHEN 0 THEN '{"limit":' || (CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END) || ',"query":' || h || '}'
               WHEN 1 THEN '{' || (CASE WHEN n % 5 = 0 THEN '"depth":1,' ELSE '' END) || '"of":[' || h || ',' || n || '],"unit":"words"}'
               WHEN 2 THEN '{' || (CASE WHEN n % 3 = 0 THEN '' ELSE '"formal":' || (CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END) || ',' END) || '"text":' || h || '}'
               WHEN 3 THEN '{"ratio":' || n || '.5,"when":{"day":' || (n % 7) || ',"hour":' || (n % 24) || '}}'
               ELSE '{"q":' || h || '}' END AS canonical,
           ['lookup', 'count', 'translate', 'schedule', 'unlisted'][pick + 1] AS name
    FROM linked l JOIN placed p USING (conv_id, turn)
)
SELECT conv_id, pos, 'call' AS kind, call_id,
       CASE WHEN pick = 4 THEN 'unknown_tool' WHEN n % 11 = 0 THEN 'bad_json' WHEN wrong <> '' THEN 'invalid' WHEN result_pos IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       CASE WHEN n % 11 = 0 THEN '' ELSE wrong END AS errors, missing_parent, order_pos, (hops * 2)::BIGINT AS depth,
       '{' || (CASE WHEN n % 11 = 0 THEN '' ELSE '"arguments":' || canonical || ',' END) || '"id":"' || call_id || '","name":"' || name || '","type":"tool_call"}' AS json
FROM checked
UNION ALL
SELECT r.conv_id, r.pos, 'result', r.call_id, CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'ok' END, '',
       coalesce(c.missing_parent, false), greatest(r.pos, coalesce(c.order_pos, r.pos)), (coalesce(c.hops * 2 + 1, 0))::BIGINT,
       '{"content":' || r.h || ',"id":"' || r.call_id || '","type":"tool_result"}'
FROM results r LEFT JOIN checked c USING (conv_id, turn)
"""
