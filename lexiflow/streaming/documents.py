"""Document streams: the per-row operators under ``readStream``, and windowed counts with a watermark.

Every operator that works inside a row runs on a stream as it is; what this module adds is the source, event
time that stays with a document's paragraphs, and a sink that resumes from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiflow.functions import scores as S
from lexiflow.functions import text as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, path: str, schema: str = SCHEMA, files_a_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come; ``files_a_trigger`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def timed_paragraphs(docs: DataFrame, time_col: str, late: str, lang: str | None = "en") -> DataFrame:
    """(doc_id, para_idx, text, time): lines with their document's event time; rows later than ``late`` are left out of state."""
    docs = docs if lang is None else docs.filter(F.col("lang") == lang)
    lines = docs.select("doc_id", F.col(time_col).alias("time"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("para_idx", "text"))
    return lines.withWatermark("time", late).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), T.trimmed(F.col("text")).alias("text"), "time")


def action_counts(docs: DataFrame, time_col: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, action, n): paragraphs by reading difficulty in tumbling windows of event time."""
    return S.paragraph_scores(timed_paragraphs(docs, time_col, late)).groupBy(F.window("time", window).alias("window"), "action").agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a query that takes what is there and stops; run again it goes on where it was."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
