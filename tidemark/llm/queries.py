"""The opN queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annular, bagminhash, bloomlm, debruijn, gracehash, lengths, maxtree, media, mixing, packing, projections, suffixes, toxicity
from .common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(read(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score_texts(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digest(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.correct(media.store_texts(read(spark, sf_dir, "documents"))))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gracehash.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxtree.search(maxtree.index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annular.compressed(read(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS weight,
    source_size * 3.0::DOUBLE AS most FROM sources),
levels AS (
  SELECT *, most / weight AS level FROM weighed),
tries AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS attempt FROM levels),
water AS (SELECT min_by(attempt, level) FILTER (WHERE attempt <= level) AS level FROM tries),
targets AS (
  SELECT t.source, t.source_size, least(t.most, t.weight * coalesce(w.level, 'inf'::DOUBLE)) AS target FROM tries t, water w),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)
    * size)::BIGINT AS taken
FROM rated
"""

OP11_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size
  FROM plain WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(content) AS text_sha256 FROM ranked
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM docs GROUP BY doc_id, term),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (
  SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN dfs USING (term), totals),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM weighed JOIN tfs USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _op13_sql(rounds: int = 4) -> str:
    """Every round of assignment and means, with all distances."""
    out = r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
book0 AS MATERIALIZED (
  SELECT p, r - 1 AS c, x AS e FROM parts WHERE r <= 256)"""
    assign = """,
near{i} AS MATERIALIZED (
  SELECT r, p, x, min((d, c)) AS best FROM (
    SELECT r, a.p, x, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, e)])::BIGINT AS d FROM parts a JOIN book{i} b ON a.p = b.p)
  GROUP BY r, p, x)"""
    means = """,
sums{i} AS (
  SELECT p, c, list(floor(s::DOUBLE / n)::BIGINT ORDER BY k) AS e FROM (
    SELECT p, best[2] AS c, k, sum(x[k]) AS s, count(*) AS n FROM near{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k) GROUP BY p, best[2], k) GROUP BY p, c),
book{j} AS MATERIALIZED (
  SELECT p, c, coalesce(s.e, b.e) AS e FROM book{i} b LEFT JOIN sums{i} s USING (p, c))"""
    for i in range(rounds):
        out += assign.format(i=i) + means.format(i=i, j=i + 1)
    out += assign.format(i=rounds) + f""",
coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY r),
mark AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), mark
"""
    return out


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_media": op9_media,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op11_exact_dedup": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_vector_codes": OP13_SQL}
