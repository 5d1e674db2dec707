"""The operators of this subpackage as queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import encoder, extraction, minhash, mixing, pieces, quality, separators, sharding, suffixes, tokenfiles, topk


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_tokens(_read(spark, sf_dir, "documents"), encoder.default_tokenizer(), separator=50256)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), pieces.default_model()).drop("ids")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, similarity=0.8)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    field = quality.train(documents, _read(spark, sf_dir, "labels"))
    return quality.rate(documents, field)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(_read(spark, sf_dir, "documents"), encoder.default_tokenizer(), end_id=0)[1]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=16)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_read(spark, sf_dir, "documents"), length=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_sentencepiece, op4_minhash, op5_quality, op6_mixing, op7_top_k, op8_token_files, op9_sharding, op10_suffix_dedup)
}

#: Links by shared shingles, then the least id reachable. Shingle sets are taken whole, no sampling.
OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, k.n HAVING 100 * count(*) >= 80 * (m.n + k.n - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

OP6 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), hashed AS (SELECT *, md5(concat_ws('/', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)) AS turn FROM docs),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM docs GROUP BY source
), weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), cut AS (SELECT min_by(level, cap / w) AS level FROM levels WHERE cap / w > level),
targets AS (SELECT source, r, source_size, CASE WHEN cap / w <= (SELECT level FROM cut) THEN cap ELSE (SELECT level FROM cut) * w END AS target FROM weighed),
queue AS (
  SELECT h.*, t.r, t.source_size, t.target, sum(size) OVER (PARTITION BY t.r ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM hashed h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, turn, r, size, copy, (upto + copy * source_size)::DOUBLE / target AS finish
  FROM queue, (SELECT unnest([0, 1]) AS copy) WHERE size > 0 AND (upto + copy * source_size - size)::DOUBLE < target
), served AS (SELECT *, sum(size) OVER (ORDER BY finish, r, turn, doc_id, copy ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT doc_id, turn, sum(size)::BIGINT AS taken FROM served WHERE total <= 1.5::DOUBLE * (SELECT sum(size) FROM docs)::DOUBLE GROUP BY doc_id, turn)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM queue q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.turn = t.turn
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

#: Bytes as pairs of hexadecimal digits.
OP10 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, b, substring(h, 2 * b + 1, 1424) AS p FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 512)) AS b FROM docs)),
windows AS (SELECT doc_id, b + j AS i, md5_number_lower(substring(p, 2 * j + 1, 400)) AS k FROM (SELECT doc_id, b, p, unnest(range(0, least(len(p) // 2 - 199, 512))) AS j FROM parts)),
hits AS (SELECT w.doc_id, w.i FROM windows w JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) t ON w.k = t.k),
edges AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
left_over AS (
  SELECT c.doc_id, string_agg(substring(d.h, 2 * c.before + 1, 2 * (c.s - c.before)), '' ORDER BY c.s) AS head, max(c.e) AS tail, sum(c.e - c.s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans
  FROM cuts c JOIN docs d ON c.doc_id = d.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(l.n_removed, 0)::BIGINT AS n_removed, coalesce(l.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(l.head, '') || substring(d.h, 2 * coalesce(l.tail, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN left_over l ON d.doc_id = l.doc_id
"""

SQL = {"op4_minhash": OP4, "op6_mixing": OP6, "op7_top_k": OP7, "op10_suffix_dedup": OP10}
