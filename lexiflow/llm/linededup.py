"""Line dedup (operator 5) over levelled sorted runs of line hashes, DataFrame operations only.

A run has (key, docs, last) rows: a line's 128-bit hash, the number of documents that hold it and the largest of
their ids.  A level is a table in the shared folder, bucketed by key; all levels have the same buckets, and a run is one
sorted file a bucket.  A new batch is written in that form, merge-anti-joined with the levels for lines never
seen, and adds those as a run of its own to level 0; a level with ``fanout`` runs is merged into one run of the next, so
each key is rewritten once per level.  Anti-joins, merges and the last sums read buckets side by side: nothing is
exchanged between runs.  Batches are summed by key with partial sums, so a line that a third of all documents
hold costs one row per task.

Decisions meet lines by key: keys in at least a 2,000th of all (line, document) pairs, fewer than 2,001
whatever the input, are broadcast; each other key is in fewer rows than that, so a shuffle by key stays even.
What comes back to a text is the list of places of its lines that go, at most as long as its lines; the text is put
together from the runs of lines between them, so work is linear in its lines.

Defined results: a null or empty text is one empty line; a line's key is the line without the six ASCII
white-space characters at both ends, A-Z in lower case; keys shorter than ``min_chars`` never count;
several rows of one doc_id are one document for counting; all rows of null doc_id are one document below
all ids; an empty table gives no rows; extra columns stay, but for those named like the two counts, which give way to them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.arrays import let
from lexiflow.llm.common import Tables, free, settings

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
#: Keys in at least one of so many (line, document) pairs are broadcast.
HOT = 2_000
#: Rows that a bucket holds at most, on average; fewer where that takes no more than so many buckets.
BUCKET_ROWS, SMALL_BUCKET, SMALL_BUCKETS = 4_000_000, 250_000, 1_000
#: The counts that ``dedup_lines`` adds.
COUNTS = ("_n_lines", "_n_dropped")
_NO_ID = -(1 << 63)
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """128 bits of the key as a pair; null for keys that never count."""
    key = F.btrim(F.translate(line, _AZ, _az), F.lit(" \t\n\x0b\x0c\r"))
    pair = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key, F.lit("~")).alias("b"))
    return F.when(F.length(key) >= min_chars, pair)


#: Scans keep buckets, and the order of buckets of one file each; unions claim no partitioning.
_BY_BUCKETS = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.unionOutputPartitioning": "false",
}


class LineRuns:
    """The levelled store.  Its tables are files in the shared folder, so lost executors lose nothing.

    Runs have no key in common.  What a batch holds of known keys goes to a table of hits, for counts.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.runs: dict[int, int] = {}  # runs by level
        self.files, self.prefix = Tables(spark, "lines"), f"lexiflow_lines_{uuid.uuid4().hex}"

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def _append(self, rows: DataFrame, table: str) -> None:
        """Adds a sorted file a bucket.  What lies in such buckets already is not exchanged again."""
        name = self._name(table)
        path = self.files.paths.get(name) or self.files.new_path(name)
        with settings(self.spark), settings(self.spark, _BY_BUCKETS):
            rows = rows.repartition(self.buckets, "a", "b").sortWithinPartitions("a", "b")
            # Hashes do not compress.
            writer = rows.write.option("compression", "none").bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path)
            writer.mode("append").saveAsTable(name)

    def _drop(self, table: str) -> None:
        if self._name(table) in self.files.paths:
            self.spark.sql(f"DROP TABLE {self._name(table)}")
            self.files.drop(self._name(table))

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def _levels(self) -> list[DataFrame]:
        return [self._read(f"level{k}") for k in sorted(self.runs)]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key no run holds: a merge anti-join with each level in turn."""
        for level in self._levels():
            rows = rows.join(level.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (a, b, _doc), all of a document's lines, each once."""
        known = F.col("_doc") != _NO_ID
        docs = F.count_if(known) + F.max(F.when(known, 0).otherwise(1))
        rows = lines.groupBy("a", "b").agg(docs.cast("long").alias("docs"), F.max("_doc").alias("last"))
        if self.runs:
            self._append(rows, "batch")
            rows = self._read("batch")
            for level in self._levels():
                self._append(rows.join(level.select("a", "b").hint("merge"), ["a", "b"], "left_semi"), "hits")
            rows = self.unseen(rows)
        if 0 in self.runs:  # a level cannot be read and written at once
            self._append(rows, "fresh")
            rows = self._read("fresh")
        self._append(rows, "level0")
        self._drop("fresh")
        self._drop("batch")
        level, self.runs[0] = 0, self.runs.get(0, 0) + 1
        while self.runs[level] >= self.fanout:
            self._append(self._read(f"level{level}"), f"level{level + 1}")
            self._drop(f"level{level}")
            del self.runs[level]
            level += 1
            self.runs[level] = self.runs.get(level, 0) + 1

    def table(self, min_docs: int = 1) -> DataFrame:
        """(a, b, docs, last) over all that was added, of keys in ``min_docs`` documents."""
        hits, out = None, None
        if self._name("hits") in self.files.paths:
            hits = self._read("hits").groupBy("a", "b").agg(F.sum("docs").alias("_docs"), F.max("last").alias("_last"))
        for rows in self._levels():
            if hits is not None:
                docs = F.col("docs") + F.coalesce("_docs", F.lit(0))
                rows = rows.join(hits.hint("merge"), ["a", "b"], "left")
                rows = rows.select("a", "b", docs.alias("docs"), F.greatest("last", "_last").alias("last"))
            rows = rows.filter(F.col("docs") >= min_docs)
            out = rows if out is None else out.unionByName(rows)
        return out

    def close(self) -> None:
        for table in ("hits", *(f"level{k}" for k in self.runs)):
            self._drop(table)


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's document, and what tells its texts apart."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)), F.xxhash64(docs[text_col])


def document_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_doc, _text, _at, a, b): each line that counts, and its place."""
    keys = F.transform(lines_of(docs[text_col]), lambda x: key_hash(x, min_chars))
    doc, text = _identity(docs, id_col, text_col)
    # Below the explode; within one select a text would be hashed anew for each of its lines.  (An outer explode, for a
    # plain one would have the keys computed twice, once to see whether there are any.)
    rows = docs.select(doc.alias("_doc"), text.alias("_text"), keys.alias("_keys"))
    out = rows.select("_doc", "_text", F.posexplode_outer("_keys").alias("_at", "_k")).filter("_k IS NOT NULL")
    return out.select("_doc", "_text", "_at", "_k.a", "_k.b")


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """(_doc, _text, _drop): for each text that loses lines, their places, rising."""
    spark = docs.sparkSession
    tables = Tables(spark, "line-dedup")
    batch = F.pmod(F.xxhash64("_doc"), F.lit(batches)).cast("int")
    lines = document_lines(docs, id_col, text_col, min_chars).withColumn("_batch", batch)
    lines = tables.cut(lines.sortWithinPartitions("_batch"), "lines")
    n = lines.count()
    buckets = max(1, -(-n // BUCKET_ROWS), min(-(-n // SMALL_BUCKET), SMALL_BUCKETS))
    store = LineRuns(spark, buckets, fanout)
    for i in range(batches):
        store.add(lines.filter(F.col("_batch") == i).select("a", "b", "_doc").distinct())
    with settings(spark, _BY_BUCKETS):
        common = tables.cut(store.table(min_docs), "common")
    store.close()
    least = max(min_docs, -(-n // HOT))

    def met(keys: DataFrame) -> DataFrame:
        return lines.join(keys, ["a", "b"]).filter(F.col("_doc") < F.col("last")).select("_doc", "_text", "_at")

    hot = met(F.broadcast(common.filter(F.col("docs") >= least)))
    rest = met(common.filter(F.col("docs") < least).hint("shuffle_hash"))
    return hot.unionByName(rest).groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("_at")).alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text reduced, and _n_lines and _n_dropped.

    A line goes where its key is in at least ``min_docs`` documents and this is not the largest of them.
    A text that loses no line stays as it is, null included.
    """
    docs = docs.drop(*COUNTS)
    doc, text, drop = free(docs, "_doc", "_text", "_drop")
    gone = dropped_lines(docs, id_col, text_col, **options).toDF(doc, text, drop)
    own, part = _identity(docs, id_col, text_col)
    joined = docs.withColumns({doc: own, text: part}).join(gone.hint("shuffle_hash"), [doc, text], "left")
    lines, places = lines_of(F.col(text_col)), F.col(drop)

    def between(lines: Column) -> Column:
        """The lines before each place that goes, and after the last."""
        begin = lambda i: F.coalesce(F.get(places, i - 1) + 1, F.lit(0))
        end = lambda i: F.coalesce(F.get(places, i), F.size(lines))
        runs = F.transform(F.sequence(F.lit(0), F.size(places)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))
        return F.array_join(F.flatten(runs), "\n")

    reduced = F.when(places.isNotNull(), let(lines, between)).otherwise(F.col(text_col))
    dropped = F.when(places.isNotNull(), F.size(places)).otherwise(0)
    counts = [F.size(lines).cast("long").alias(COUNTS[0]), dropped.cast("long").alias(COUNTS[1])]
    return joined.select(*(reduced.alias(c) if c == text_col else F.col(c) for c in docs.columns), *counts)
