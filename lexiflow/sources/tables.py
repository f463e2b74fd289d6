"""Tables, paragraphs and dictionaries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.functions import values as V
from lexiflow.operators.terms import token_counts

#: Letters of a word that deal words of one count over tasks when they are ranked.
_HEAD = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and the session is local (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexiflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/lexiflow-{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as the session's ``lexiflow.input.partitions`` says; as its files lie where that is unset.

    For inputs of one or two row groups, which would keep all but a core or two idle.
    """
    parts = df.sparkSession.conf.get("lexiflow.input.partitions", None)
    return df.repartition(int(parts)) if parts else df


def texts(docs: DataFrame, lang: str | None = "en") -> DataFrame:
    """(doc_id, paras): a document's trimmed lines in order, in the row."""
    docs = docs if lang is None else docs.filter(F.col("lang") == lang)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    line = lambda x, i: F.struct(i.cast("long").alias("para_idx"), T.trimmed(x).alias("text"))
    return docs.select("doc_id", F.transform(lines, line).alias("paras"))


def paragraphs(docs: DataFrame, lang: str | None = "en") -> DataFrame:
    """(doc_id, para_idx, text): a document's lines, trimmed."""
    docs = docs if lang is None else docs.filter(F.col("lang") == lang)
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("para_idx", "text"))
    return lines.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), T.trimmed(F.col("text")).alias("text"))


def tokens(paras: DataFrame) -> DataFrame:
    """(doc_id, para_idx, tok_idx, raw): tokens between white space."""
    t = paras.select("doc_id", "para_idx", F.posexplode(F.split("text", f"{T.JAVA_SPACE}+", -1)).alias("tok_idx", "raw"))
    return t.withColumn("tok_idx", F.col("tok_idx").cast("long"))


def frequency_list(docs: DataFrame) -> DataFrame:
    """(word, rank): every cleaned word of English paragraphs, the most frequent first, rank from 0; ties by word.

    A rank is the words of larger counts, those of its count with smaller first letters, and the place among the
    rest.  Words are ordered within a count and first letters only; the one window over all has a row for each count.
    """
    # Asked for here, for Spark adds it to one side of a join alone, whose texts would then be read and counted anew.
    words = token_counts(docs.filter(F.col("lang") == "en").select("text")).filter(F.substring("word", 1, _HEAD).isNotNull())
    counts = words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("_head", F.substring("word", 1, _HEAD))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("n", "_head").agg(F.count("*").alias("_size"))
    larger = groups.groupBy("n").agg(F.sum("_size").alias("_size")).select("n", before("_size", Window.orderBy(F.desc("n"))).alias("_larger"))
    groups = groups.select("n", "_head", before("_size", Window.partitionBy("n").orderBy("_head")).alias("_smaller")).join(larger, "n")
    place = F.row_number().over(Window.partitionBy("n", "_head").orderBy("word")) - 1
    rank = F.col("_larger") + F.col("_smaller") + F.col("_place")
    return counts.withColumn("_place", place).join(groups, ["n", "_head"]).select("word", rank.cast("long").alias("rank"))


def vocabulary(freq: DataFrame, every: int = 50, least: int = 5) -> DataFrame:
    """(term, branch, weight): a weighted vocabulary, here every 50th of the longer frequent words with branches in turn."""
    names = list(V.BRANCH_WEIGHTS)
    branch = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("rank") / every) % len(names) + 1).cast("int"))
    weights = F.create_map(*(F.lit(x) for kv in V.BRANCH_WEIGHTS.items() for x in kv))
    out = freq.filter((F.col("rank") % every == 0) & (F.length("word") >= least)).select(F.col("word").alias("term"), branch.alias("branch"))
    return out.withColumn("weight", weights[F.col("branch")])


def read_frequency_json(spark: SparkSession, path: str) -> DataFrame:
    """A frequency file [[word, number], ...]: the index is the rank, the last of equal words wins."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("rank", "entry"))
    return raw.groupBy(F.lower(F.get("entry", 0)).alias("word")).agg(F.max("rank").cast("long").alias("rank"))


def read_stop_json(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Stop words and sentence starters of a {stopWords, sentenceStarters} file: small lists, used as literals."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "stopWords array<string>, sentenceStarters array<string>").alias("v")).select(F.transform("v.stopWords", F.lower), F.transform("v.sentenceStarters", F.lower)).first()
    return sorted(set(row[0] or [])), sorted(set(row[1] or []))
