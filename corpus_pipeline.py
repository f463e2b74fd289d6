"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage's table the next one's input.

Defined results, by stage, for rows that are not plain documents:

- nulls: a null text is empty, so quality_rules rejects it; a null doc_id is a document of its own for near_dedup and is kept,
  all such rows are one document below all ids for line_dedup; a null source is a source of its own; a null lang stays null.
- empty and blank texts: rejected by quality_rules (no words); one that line_dedup has emptied has no shingles and stays in
  near_dedup, has size 0 and therefore as many copies as its source's rate and its draw say in mix_sources, and is one piece, the closing
  id, in pack_sequences.
- very long texts are read whole by every stage, each in its own row.
- ties and repeated rows: rows of one doc_id are judged alike, are one document for the counts of line_dedup and near_dedup, get equal
  draws, and are packed as rows of their own.
- empty tables: every stage gives none; run() has the columns of pack_sequences.
- extra columns, whatever their names: not read, and gone after the first stage, which returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import linededup, mixing, neardup, packing, quality
from lexiflow.llm.common import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after what a stage did to the text."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (operator 6); kept ones lose their failing lines.  Null and empty texts are rejected."""
    return _documents(quality.clean_documents(docs.select(*COLUMNS)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay in the last of them alone (operator 5).  No document goes, an emptied one included."""
    return _documents(linededup.dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 2; five words, 80 %): the smallest doc_id, with all its rows."""
    return _documents(neardup.drop_near_duplicates(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (operator 9), none of them not at all."""
    return _documents(mixing.mix(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2,048 ids (operator 8); a row that stands there twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Near-dedup and packing are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages over documents, each one's rows a table of the shared folder that the next one reads; the pieces of the last.

    A stage's table is deleted once the next one is written, unless ``keep`` is set.
    """
    docs, tables, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = tables.cut(stage(spark, docs, sf_dir), name)
        if before and not keep:
            tables.drop(before)
        before = name
    return docs
