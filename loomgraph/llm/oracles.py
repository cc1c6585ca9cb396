"""DuckDB SQL of the queries in queries.py that SQL can express."""

#: crc32 by its polynomial: the table of 256 entries, the bytes of a hexadecimal text h, and the sum of bytes b.
CRC = r"""
bits AS (
  SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
)
"""
BYTES = "list_transform(range(1, length({h}) + 1, 2), lambda i: (16 * (instr('0123456789ABCDEF', {h}[i]) - 1) + instr('0123456789ABCDEF', {h}[i + 1]) - 1)::BIGINT)"
CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"

OP13_SQL = "WITH RECURSIVE" + CRC + r""", texts AS (
  SELECT 's' AS side, doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', NULL, row_number() OVER (), coalesce(text, '') FROM benchmark
), cut AS (
  SELECT side, doc_id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM cut
), shown AS (
  SELECT DISTINCT feature, hex(encode(feature)) AS h FROM grams
), hashed AS (
  SELECT feature, """ + CRC_OF.format(b=BYTES.format(h="h")) + r""" % 10000 AS bucket FROM shown, crc_table
), placed AS (
  SELECT side, row, bucket FROM grams JOIN hashed USING (feature)
), counted AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM placed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weighed AS (
  SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM placed JOIN gain USING (bucket) WHERE side = 's' GROUP BY row
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM cut LEFT JOIN weighed USING (row) WHERE side = 's'
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS place, 25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""

OP11_SQL = "WITH RECURSIVE" + CRC + r""", texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS hx FROM documents
), hashed AS (
  SELECT row, doc_id, w, len(w) AS n, CASE WHEN hx = '' THEN 0 ELSE """ + CRC_OF.format(b=BYTES.format(h="hx")) + r""" END AS h FROM texts, crc_table
), turned AS (
  SELECT row, doc_id, n, w, h, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM hashed
), period AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM turned
), edited AS (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM period
), words AS (
  SELECT row, unnest(range(n)) AS i, unnest(w) AS word FROM edited
), pairs AS (
  SELECT x.row, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND y.i > x.i
), islands AS (
  SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM pairs
), stretches AS (
  SELECT row, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY row, q, g HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS (
  SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length
), told AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    min(struct_pack(l := -length, s := start, p := period)) AS best FROM runs GROUP BY row
), dropped AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (row, i) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period, (1000 * -best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM edited LEFT JOIN told USING (row) LEFT JOIN kept USING (row)
"""

OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT row, c, substr(h, 2 * c + 1, 1200) AS part, least(500, length(h) // 2 - c) AS size FROM (SELECT row, h, unnest(range(0, length(h) // 2, 500)) AS c FROM texts)
), places AS (
  SELECT row, c, unnest(range(length(part) // 2 - 99)) AS j, part FROM parts WHERE length(part) >= 200
), strings AS (
  SELECT row, c + j AS i, row_number() OVER (PARTITION BY md5_number(substr(part, 2 * j + 1, 200)) ORDER BY row, c + j) AS nth FROM places WHERE j < 500
), marked AS (
  SELECT row, unnest(range(i, i + 100)) AS i FROM strings WHERE nth > 1
), gone AS (
  SELECT DISTINCT row, i FROM marked
), spans AS (
  SELECT row, count(*) AS n_removed, count(DISTINCT g) AS n_spans FROM (SELECT row, i - row_number() OVER (PARTITION BY row ORDER BY i) AS g FROM gone) GROUP BY row
), bytes AS (
  SELECT row, unnest(range(c, c + size)) AS i, c, part FROM parts SEMI JOIN spans USING (row)
), kept AS (
  SELECT row, string_agg(substr(part, 2 * (i - c) + 1, 2), '' ORDER BY i) AS k FROM bytes ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM texts LEFT JOIN spans USING (row) LEFT JOIN kept USING (row)
"""

OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), shown AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS shown FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(shown) + 11)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
