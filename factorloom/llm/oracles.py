"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, g.n AS n, item_id FROM grams g JOIN windows v ON g.n = v.n AND g.win = v.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1}


def feistel_sql(source: str, x: str) -> str:
    """(row, x) of `source` (row, n, side, and the number as x) after one application of the network."""
    from .sharding import PRIME, round_keys

    sql = f"SELECT row, n, side, {x} // side AS l, {x} % side AS r FROM {source}"
    for a, b in round_keys(42):
        t = f"((r * {a} + {b}) % {PRIME})"
        sql = f"SELECT row, n, side, r AS l, (l + ({t} * {t}) % {PRIME}) % side AS r FROM ({sql})"
    return f"SELECT row, n, side, l * side + r AS x FROM ({sql})"


#: The bitwise CRC-32 table by its rule, then one fold over the bytes of each text.
CRC = """crc_table AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
bytes AS (SELECT rowid_, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT)) AS b FROM docs WHERE text IS NOT NULL),
crcs AS (SELECT rowid_, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, v: xor(c >> 8, t[CAST(xor(c, v) & 255 AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM bytes, crc_table)"""

OP3 = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents),
{CRC},
sized AS (SELECT d.doc_id, CAST(coalesce(octet_length(encode(d.text)), 0) + 8 AS BIGINT) AS size, c.text_crc32 FROM docs d LEFT JOIN crcs c USING (rowid_)),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size NULLS FIRST, text_crc32 NULLS FIRST) - 1 AS row, (SELECT count(*) FROM documents) AS n,
  (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM documents) AS side FROM sized),
walk AS (
  {feistel_sql("numbered", "row")}
  UNION ALL
  SELECT * FROM ({feistel_sql("(SELECT * FROM walk WHERE x >= n)", "x")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 24 AS INTEGER) AS shard, CAST(x // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (row) WHERE walk.x < walk.n
"""
ORACLES["op3_sharding"] = OP3

OP8 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT rid, doc_id, hex(encode(text)) AS hx FROM t),
windows AS (SELECT rid, i, hash(substr(hx, 2 * i + 1, 800)) AS h FROM (SELECT rid, hx, unnest(range(0, len(hx) // 2 - 399)) AS i FROM d WHERE len(hx) >= 800)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM windows JOIN twice USING (h)),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS s FROM starts),
spans AS (SELECT rid, s, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY rid, s),
gaps AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT rid, max(z), 1000000000 FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(hx, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS hx FROM gaps JOIN d USING (rid) GROUP BY rid),
sums AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS blank_w FROM t),
places AS (
  SELECT rid, i, sum(octet_length(encode(b))) OVER (PARTITION BY rid ORDER BY i) AS z, octet_length(encode(w)) AS n
  FROM (SELECT rid, unnest(w) AS w, unnest(blank_w) AS b, unnest(range(1, len(w) + 1)) AS i FROM words)),
runs AS (SELECT rid, i, hash(array_to_string(w[i : i + 50], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 49)) AS i FROM words WHERE len(w) > 50)),
again AS (SELECT h FROM runs GROUP BY h HAVING count(*) > 1),
firsts AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM runs JOIN again USING (h)),
islands AS (SELECT rid, min(i) AS a, max(i) + 50 AS z FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS s FROM firsts) GROUP BY rid, s),
passages AS (SELECT x.rid, sum(q.z - (p.z - p.n)) AS n_passage_bytes FROM islands x JOIN places p ON p.rid = x.rid AND p.i = x.a JOIN places q ON q.rid = x.rid AND q.i = x.z GROUP BY x.rid)
SELECT d.doc_id, CAST(len(d.hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256,
  CAST(coalesce(n_passage_bytes, 0) AS BIGINT) AS n_passage_bytes
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept k USING (rid) LEFT JOIN passages USING (rid)
"""
ORACLES["op8_suffix_dedup"] = OP8
