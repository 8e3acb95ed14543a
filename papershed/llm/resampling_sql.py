"""DuckDB SQL for the operators that need a CRC-32, which DuckDB lacks: it is worked out byte by byte from its table."""

from __future__ import annotations

#: ``crc_table``: the 256 registers of the reflected polynomial, as one list.
CRC_TABLE = """crc_table AS MATERIALIZED (
          SELECT list_transform(range(256), lambda v: list_reduce(range(8),
                   lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, v)) AS crc)"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an SQL string, where ``crc_table`` is in FROM."""
    byte = f"16 * (strpos('0123456789ABCDEF', hex({text})[2 * p - 1]) - 1) + strpos('0123456789ABCDEF', hex({text})[2 * p]) - 1"
    values = f"list_transform(range(1, strlen({text}) + 1), lambda p: {byte})"
    return f"xor(4294967295, list_reduce({values}, lambda x, y: xor(x >> 8, crc[CAST(xor(x, y) & 255 AS INTEGER) + 1]), 4294967295))"


WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RESAMPLING_SQL = rf"""
        WITH {CRC_TABLE},
        w AS (
          SELECT kind, r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
                UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark)),
        f AS (
          SELECT kind, r, unnest(w) AS f FROM w
          UNION ALL
          SELECT kind, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
        n AS (SELECT kind, r, f, count(*) AS n FROM f GROUP BY ALL),
        b AS (SELECT f, CAST({crc32("f")} % 10000 AS INTEGER) AS bucket FROM (SELECT DISTINCT f FROM n), crc_table),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t
              FROM n JOIN b USING (f) GROUP BY bucket),
        total AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM c),
        g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)
                       / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c, total),
        x AS (SELECT r, sum(n) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
              FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY r),
        h AS (
          SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
          FROM w LEFT JOIN x USING (r) WHERE kind = 'd'),
        s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
        k AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM s)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
               CASE WHEN able AND place <= 25 * (SELECT count(*) FROM k WHERE able) // 100 THEN place END AS rank
        FROM k"""

LINES_SQL = f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT r, doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS p FROM d),
        k AS (SELECT r, doc_id, p, text, trim({LOWERED}, {WHITE}) AS key FROM x),
        c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(text, chr(10) ORDER BY p) FILTER (c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id"""

REPAIR_SQL = f"""
        WITH RECURSIVE {CRC_TABLE},
        k AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        kind AS (SELECT k.*, {crc32("name")} % 20 AS kind FROM k, crc_table),
        d AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
          FROM kind WHERE kind <> 0),
        o AS (
          SELECT conv_id, turn, role, text, trim(text, {WHITE}) AS bare,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
          FROM d),
        g AS (
          SELECT conv_id, turn, role, text, CAST(i AS BIGINT) AS i, left(role, 1) AS initial,
                 CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                 coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
          FROM o),
        inserts (state, i_cost, i_letters, i_out, reached) AS (VALUES
          ('e', 0, '', '', 'e'), ('e', 2, 'I', chr(10) || 'user:', 'u'), ('e', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a'),
          ('s', 0, '', '', 's'), ('s', 2, 'I', chr(10) || 'user:', 'u'), ('s', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a'),
          ('u', 0, '', '', 'u'), ('u', 2, 'I', chr(10) || 'assistant:', 'a'), ('u', 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 'u'),
          ('a', 0, '', '', 'a'), ('a', 2, 'I', chr(10) || 'user:', 'u'), ('a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a')),
        turns (reached, initial, role_name, target) AS (VALUES
          ('e', 's', NULL, 's'), ('e', 'u', 'user', 'u'), ('s', 'u', 'user', 'u'), ('u', 'a', 'assistant', 'a'), ('a', 'u', 'user', 'u')),
        moves AS (
          SELECT state, i_cost + 3 AS cost, i_letters || 'D' AS letters, i_out AS before, 'D' AS edit, CAST(NULL AS VARCHAR) AS needs, CAST(NULL AS VARCHAR) AS new_role, reached AS target FROM inserts
          UNION ALL SELECT state, i_cost, i_letters || 'K', i_out, 'K', initial, NULL, target FROM inserts JOIN turns USING (reached)
          UNION ALL SELECT state, i_cost + 2, i_letters || 'R', i_out, 'R', NULL, role_name, target FROM inserts JOIN turns USING (reached) WHERE role_name IS NOT NULL),
        v AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, 'e' AS state, 0 AS cost, '' AS audit, '' AS lines FROM g GROUP BY conv_id
          UNION ALL
          SELECT conv_id, i, state, cost, audit, lines FROM (
            SELECT v.conv_id, g.i, m.target AS state, v.cost + m.cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
                   v.audit || m.letters AS audit,
                   v.lines || m.before || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || new_role || ':' || text END AS lines,
                   row_number() OVER (PARTITION BY v.conv_id, m.target
                     ORDER BY v.cost + m.cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, v.audit || m.letters) AS nth
            FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1 JOIN moves m ON m.state = v.state
            WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR needs = initial)))
          WHERE nth = 1),
        ends AS (
          SELECT conv_id, v.cost + i_cost AS cost, audit || i_letters AS audit, lines || i_out AS lines,
                 row_number() OVER (PARTITION BY conv_id ORDER BY v.cost + i_cost, audit || i_letters) AS nth
          FROM v JOIN inserts USING (state)
          WHERE reached IN ('e', 'a') AND v.i = (SELECT max(i) FROM g WHERE g.conv_id IS NOT DISTINCT FROM v.conv_id)),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
          FROM g GROUP BY conv_id)
        SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) ids
        LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id AND ends.nth = 1"""
