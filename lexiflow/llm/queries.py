"""The contracts' queries: each derives its columns from its operator's results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import hardneg, linededup, media, mixing, neardup, packing, pii, quality, resample, secrets, sql, tokenout, toxicity, urlfilter
from lexiflow.llm.common import Tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ["assign", "access", "hex"]
    count = lambda k: F.size(f"_{k}").cast("long").alias(f"n_{k}")
    return secrets.scan(docs).select("doc_id", *map(count, base), F.sha2(secrets.spans(base), 256).alias("base_sha256"), secrets.spans([*base, "entropy"]).alias("spans"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.components(docs, words=3, percent=85)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    return quality.measure(docs).select("doc_id", *(f"_q.{c}" for c in columns))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenout.materialise(docs).index


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = mixing.draw_copies(docs, keep=["doc_id"])
    return drawn.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "media")
    stored = tables.cut(media.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text")), "stored")
    out = media.convert(stored)
    return out.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", F.octet_length("pcm_wav").cast("long").alias("pcm_bytes"), F.sha2("pcm_wav", 256).alias("pcm_sha256"),
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = pii.scan(docs, pii.fit(pii.label(pii.sample(docs))))
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text")
    return resample.resample(docs, target)


_QUERIES = (
    op1_secrets, op2_neardup, op3_urls, op4_toxicity, op5_lines, op6_quality, op7_token_output, op8_packing, op9_mixing, op10_media, op11_pii,
    op12_hard_negatives, op13_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_OP5 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, id, i, line, CASE WHEN length(k) >= 20 THEN k END AS k FROM (
    SELECT r, id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT r, id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT r, id, string_split(text, chr(10)) AS l FROM t)))),
common AS (SELECT k, max(id) AS keep FROM lines WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT id) >= 3),
judged AS (SELECT l.*, c.k IS NOT NULL AND l.id < c.keep AS gone FROM lines l LEFT JOIN common c ON l.k = c.k),
done AS (SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM t JOIN done USING (r)
"""

_OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/mix-1'), 1, 8))::BIGINT // 1048576)::INT AS step FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
weighted AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM ranked),
levels AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM weighted),
sums AS (SELECT *, sum(cap) OVER w - cap AS full_before, sum(weight) OVER () - sum(weight) OVER w + weight AS left_weight, sum(source_size) OVER () AS everything
  FROM levels WINDOW w AS (ORDER BY ratio, rank)),
leveled AS (SELECT *, (everything::DOUBLE * 1.5::DOUBLE - full_before::DOUBLE) / left_weight::DOUBLE AS level FROM sums),
chosen AS (SELECT level FROM leveled WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM chosen) * weight::DOUBLE, cap::DOUBLE)) AS target FROM leveled),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM targets),
wants AS (SELECT *, target - (whole * source_size)::DOUBLE AS want FROM rates),
bins AS (SELECT source, step, sum(size) AS words FROM sized GROUP BY source, step),
cumulated AS (SELECT w.source, w.want, b.step + 1 AS edge, abs((sum(b.words) OVER (PARTITION BY b.source ORDER BY b.step))::DOUBLE - w.want) AS gap
  FROM bins b JOIN wants w ON b.source IS NOT DISTINCT FROM w.source),
best AS (SELECT source, want, gap, edge FROM cumulated QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, edge) = 1),
edges AS (SELECT source, CASE WHEN gap < want THEN edge ELSE 0 END AS edge FROM best)
SELECT s.doc_id, s.size, w.source_size, w.target, ((w.whole + (s.step < e.edge)::BIGINT) * s.size)::BIGINT AS taken
FROM sized s JOIN wants w ON s.source IS NOT DISTINCT FROM w.source JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": sql.op1(), "op2_neardup": sql.op2(), "op3_urls": sql.op3(), "op5_lines": _OP5, "op6_quality": sql.op6(), "op9_mixing": _OP9, "op12_hard_negatives": sql.OP12, "op13_resampling": sql.OP13}
