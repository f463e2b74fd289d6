"""Results kept by content: a text that was analysed with the same parameters is not analysed again, a file that was read is not read again.

Three tables in a shared folder: ``files`` (path and time of change of what was read), ``rows`` (which file holds which document
with which digest) and ``results`` (what came out, by digest), the last one by parameter set.  A run lists files (names and times, no
contents), reads new ones alone, analyses digests that no result has, and appends to each table once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_FILE = ["file", "changed"]


class Analyses:
    """A cache of ``analyse``: (digest, text) of different texts to rows with a digest."""

    def __init__(self, spark: SparkSession, path: str, parameters: dict, analyse: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.analyse = spark, path.rstrip("/"), analyse
        self.key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]
        self.analysed = 0  # texts of the last run

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # not written yet
            return None

    def _results(self) -> DataFrame | None:
        return self._read(f"results/parameters={self.key}")

    def run(self, source: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """(doc_id, digest and the results' columns) of every document of the Parquet files under ``source``."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
        now = listed.select(F.col("path").alias("file"), F.unix_micros("modificationTime").alias("changed"))
        seen = self._read("files")
        fresh = now if seen is None else now.join(seen, _FILE, "left_anti")
        paths = [r["file"] for r in fresh.select("file").distinct().collect()]  # names of new files
        if paths:
            docs = self.spark.read.parquet(*paths)
            of_file = F.col("_metadata")
            rows = docs.select(
                of_file["file_path"].alias("file"), F.unix_micros(of_file["file_modification_time"]).alias("changed"), F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest")
            )
            rows.write.mode("append").parquet(f"{self.path}/rows")
        self._analyse_missing(source, text_col, now)
        if paths:
            fresh.write.mode("append").parquet(f"{self.path}/files")
        current = self._current(now)
        return current.select("doc_id", "digest").join(self._results(), "digest").drop("parameters")

    def _current(self, now: DataFrame) -> DataFrame:
        """Rows of the files as they are now; a file that was written anew or is gone counts no more."""
        return self._read("rows").dropDuplicates(["file", "changed", "doc_id", "digest"]).join(now, _FILE, "left_semi")

    def _analyse_missing(self, source: str, text_col: str, now: DataFrame) -> None:
        rows, known = self._current(now), self._results()
        wanted = rows.select("digest").distinct() if known is None else rows.select("digest").distinct().join(known.select("digest"), "digest", "left_anti")
        files = [r["file"] for r in rows.join(wanted, "digest", "left_semi").select("file").distinct().collect()]  # files that hold a new text
        self.analysed = wanted.count() if files or known is None else 0
        if not files and known is not None:
            return
        docs = self.spark.read.parquet(*files) if files else self.spark.read.parquet(source).limit(0)
        texts = docs.select(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest"), F.coalesce(text_col, F.lit("")).alias("text"))
        texts = texts.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
        self.analyse(texts).write.mode("append").parquet(f"{self.path}/results/parameters={self.key}")
