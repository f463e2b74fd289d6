"""Settings as a log of changes: the last write of a key wins, and only what its owner's settings touch is worked out anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective(log: DataFrame, owner: str = "owner", key: str = "key", value: str = "value", at: str = "at", order: str = "seq") -> DataFrame:
    """(owner, key, value, at): the last value of each key, by time and then by ``order``; changes without a time are left out."""
    last = F.max_by(F.struct(value, at), F.struct(at, order))
    return log.filter(F.col(at).isNotNull()).groupBy(owner, key).agg(last.alias("_x")).select(owner, key, F.col(f"_x.{value}").alias(value), F.col(f"_x.{at}").alias(at))


def parameters(log: DataFrame, defaults: dict[str, float], owner: str = "owner", key: str = "key", value: str = "value", at: str = "at", order: str = "seq") -> DataFrame:
    """(owner, and a column for each of ``defaults``): an owner's settings over the defaults."""
    known = effective(log, owner, key, value, at, order).filter(F.col(key).isin(*defaults))
    own = [F.coalesce(F.max(F.when(F.col(key) == k, F.col(value))), F.lit(v)).alias(k) for k, v in defaults.items()]
    return known.groupBy(owner).agg(*own)


def changed(log: DataFrame, since: Column, names: dict, order: str = "seq") -> DataFrame:
    """(owner): those whose effective parameters differ from what they were at ``since``; a change and its undoing are no change."""
    before, now = parameters(log.filter(F.col("at") <= since), names, order=order), parameters(log, names, order=order)
    same = " AND ".join(f"a.`{n}` <=> coalesce(b.`{n}`, {v})" for n, v in names.items())
    return now.alias("a").join(before.alias("b"), "owner", "left").filter(f"NOT ({same})").select("owner")


def refresh(spark, path: str, owners: DataFrame, compute: Callable[[DataFrame], DataFrame], buckets: int = 64) -> None:
    """Works out the rows of ``owners`` (owner) anew in the table at ``path``, which is partitioned by ``bucket`` of the owner.

    Only the buckets of these owners are read and written (dynamic partition overwrite); their other owners' rows stay as they are.
    ``compute``: owners to rows with a column owner.
    """
    bucket = F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int")
    fresh = compute(owners).withColumn("bucket", bucket)
    touched = [r[0] for r in owners.select(bucket.alias("b")).distinct().collect()]  # ``buckets`` at most
    if not touched:
        return
    old = spark.read.schema(fresh.schema).option("basePath", path).parquet(path).filter(F.col("bucket").isin(*touched))
    kept = old.join(owners, "owner", "left_anti").unionByName(fresh)
    # The rows that stay are written beside the table first: a partition is not read while it is overwritten.
    side = f"{path.rstrip('/')}-refresh"
    kept.write.mode("overwrite").parquet(side)
    done = spark.read.schema(fresh.schema).parquet(side)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write(df: DataFrame, path: str, buckets: int = 64) -> None:
    """A new table of rows with an owner, as ``refresh`` reads it."""
    df.withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(path)
