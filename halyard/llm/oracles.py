"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op9_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM w
), n AS (
  SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), ends AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, ends.b FROM r JOIN ends ON r.b = ends.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    # Base32 of the SHA-1: groups of five bits of its 160, as letters.
    "op10_warc_archive": """
WITH d AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), b AS (
  SELECT page_id, h, n, array_to_string(list_transform(list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', h[i]) - 1), lambda v: substr(bin(v + 16), 2, 4)), '') AS bits FROM d
), p AS (
  SELECT page_id, n, max(page_id) OVER (PARTITION BY h, n) AS last,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN bits[5 * k + j] = '1' THEN [16, 8, 4, 2, 1][j] ELSE 0 END)) AS INTEGER), 1)), '') AS digest FROM b
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p""",
    "op2_mtree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * c.z[i])) AS BIGINT), 0) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.z) = len(c.z)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # Sources of up to 2,000 rows, so one shard each; blocks go to the highest quotients one by one.
    "op7_sainte_lague_mix": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z, CAST(row_number() OVER (ORDER BY source IS NULL, source) - 1 AS BIGINT) AS k FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][k % 3 + 1] AS w FROM s
), u AS (
  SELECT CAST(3 * sum(z) AS HUGEINT) AS num, CAST(2 * sum(w) AS HUGEINT) AS den, 0 AS turn FROM w
  UNION ALL
  SELECT n.num, n.den, n.turn FROM (
    SELECT CAST(3 * sum(w.z) - 4 * sum(CASE WHEN 2 * w.z * u.den < w.w * u.num THEN w.z ELSE 0 END) AS HUGEINT) AS num,
      CAST(2 * sum(CASE WHEN 2 * w.z * u.den < w.w * u.num THEN 0 ELSE w.w END) AS HUGEINT) AS den, u.turn + 1 AS turn
    FROM u, w WHERE u.turn < 50 GROUP BY u.num, u.den, u.turn) n
), l AS (
  SELECT num, den FROM u ORDER BY turn DESC LIMIT 1
), t AS (
  SELECT source, z, k, CASE WHEN 2 * z * den < w * num THEN CAST(2 * z AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM w, l
), n AS (
  SELECT CAST(floor(sum(target) / 16 + 0.5) AS BIGINT) AS seats FROM t
), h AS (
  SELECT k, q, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, k) AS place FROM (SELECT k, target, unnest(range(0, CAST(target / 16 AS BIGINT) + 50)) AS q FROM t)
), g AS (
  SELECT t.k, count(h.q) AS quota FROM t LEFT JOIN (SELECT h.* FROM h, n WHERE place <= seats) h ON h.k = t.k GROUP BY t.k
), p AS (
  SELECT t.*, CAST(ceil(2 * z / 16.0) AS BIGINT) AS blocks FROM t
), f AS (
  SELECT p.*, least(g.quota, p.blocks) AS quota, CAST(CAST('0x' || substr(md5('mix:first:' || p.k || ':0'), 1, 8) AS BIGINT) % greatest(blocks, 1) AS BIGINT) AS first FROM p JOIN g USING (k)
), x AS (
  SELECT d.doc_id, d.size, f.z, f.target, f.blocks * 16 AS m, f.first * 16 AS a, (f.first + f.quota) * 16 AS b,
    sum(d.size) OVER (PARTITION BY f.k ORDER BY CAST('0x' || substr(md5('mix:order:' || d.doc_id), 1, 8) AS BIGINT), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, z AS source_size, target, CAST(
    greatest(0, least(b, m, pos + size) - greatest(a, pos)) + greatest(0, least(b - m, pos + size) - pos)
  + greatest(0, least(b, m, z + pos + size) - greatest(a, z + pos)) + greatest(0, least(b - m, z + pos + size) - (z + pos)) AS BIGINT) AS taken FROM x""",
}
