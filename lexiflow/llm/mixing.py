"""Mixing sources to target weights (operator 9).

Words are summed per source with map-side partial sums, so a source with a third of all rows costs one
row per task.  Targets follow by water filling over the table of sources, and rates from them.  Each
document is emitted floor(rate) times, and once more where its seeded hash falls below the fraction.

``fitted`` draws (the default) compare the hash in 4,096 steps.  A second partial sum, of words per source and
step, gives the step at which the words taken come nearest to the fraction of the source's words; the draw uses that
step in place of the bare fraction, so the probability equals the fraction in words.  Plain draws
(``fitted=False``) use the bare fraction: in expectation they meet the target, but a source of few documents, one of
them long, can miss it by half, which is not near.  Both agree where sources are large.

Nothing is ranked or summed in one task: sources are numbered by range partitions, and the water level takes a few
sums over the table of sources.  Documents meet their source's rate in salted parts; Spark broadcasts the rates only
where it finds them under its size limit.

Defined results: a null text has size 0; a null source is a source of its own and comes last; repeated
rows get equal draws; a source without words has target 0; an empty table gives no rows; extra columns stay, but for
those named like the four results of ``draw_copies``, which give way to them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import WORD, Tables, free

WEIGHTS = (5, 2, 1)
SHARE, CEILING, STEPS, SEED = 1.5, 2, 4096, "mix-1"
#: Parts of a source's documents in the join with its rate.
SALTS = 32
#: What ``draw_copies`` adds.
RESULTS = ("_size", "_source_size", "_target", "_copies")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """32 bits from the key's hash; the same on every run and in any partitioning."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _numbered(totals: DataFrame, tables: Tables) -> DataFrame:
    """Sources with _rank from 0, by code point, null last: places in range partitions, and the rows of those before."""
    parts = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = totals.repartitionByRange(parts, F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = tables.cut(dealt, "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last()))
    return dealt.join(sizes, "_part").withColumn("_rank", F.col("_before") + place - 1).drop("_part", "_before")


def targets(
    totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, tables: Tables | None = None
) -> DataFrame:
    """``totals`` (_source, _source_size) with _target: weighted shares of ``share`` of all words, none above its ceiling.

    The level is words a unit of weight.  Sources whose ceiling is below their share at the level are full, and
    the level rises as the rest share what those leave, until no more are full.
    """
    tables = tables or Tables(totals.sparkSession, "mix-targets")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    df = _numbered(totals, tables).withColumn("_weight", weight).withColumn("_ceiling", F.col("_source_size") * ceiling)
    df = tables.cut(df.withColumn("_ratio", F.col("_ceiling") / F.col("_weight")), "weighted")
    everything, left = df.agg(F.sum("_source_size"), F.sum("_weight")).first()
    full, rows, level = 0, 0, None
    while left:
        level = ((everything or 0) * share - full) / left
        above = F.col("_ratio") < F.lit(level)
        now, full, rest = df.agg(F.count_if(above), F.sum(F.when(above, F.col("_ceiling"))), F.sum(F.when(~above, F.col("_weight")))).first()
        full, left = full or 0, rest or 0
        if now == rows:
            break
        rows, level = now, None
    most = F.col("_ceiling").cast("double")
    target = most if level is None else F.least(most, F.lit(level) * F.col("_weight"))
    return df.select("_source", "_source_size", target.alias("_target"))


def plan(sized: DataFrame, fitted: bool = True, tables: Tables | None = None, **options) -> DataFrame:
    """Per source: size, target, whole copies and the draw (out of 2**32) below which a document gets one more.

    ``sized``: _source, _size and _draw per document.
    """
    tables = tables or Tables(sized.sparkSession, "mix-plan")
    width = (1 << 32) // STEPS
    step = F.floor(F.col("_draw") / width).cast("int").alias("_step")
    bins = tables.cut(sized.groupBy("_source", step).agg(F.sum("_size").alias("_words")), "bins")
    totals = targets(bins.groupBy("_source").agg(F.sum("_words").alias("_source_size")), tables=tables, **options)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    totals = totals.withColumn("_whole", F.floor(rate))
    if not fitted:
        return totals.withColumn("_edge", F.floor((rate - F.col("_whole")) * float(1 << 32)))
    totals = totals.withColumn("_want", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    # A null source must meet itself in the join.
    joined = bins.join(totals, bins["_source"].eqNullSafe(totals["_source"])).select(totals["*"], "_step", "_words")
    upto = F.sum("_words").over(Window.partitionBy("_source").orderBy("_step"))
    best = joined.withColumn("_gap", F.abs(upto - F.col("_want")))
    best = best.groupBy("_source", "_source_size", "_target", "_whole", "_want")
    best = best.agg(F.min(F.struct("_gap", (F.col("_step") + 1).alias("_next"))).alias("_best"))
    edge = F.when(F.col("_best._gap") < F.col("_want"), F.col("_best._next").cast("long") * width).otherwise(F.lit(0))
    return best.select("_source", "_source_size", "_target", "_whole", edge.cast("long").alias("_edge"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str], results: list[str], seed: str, **options) -> DataFrame:
    """Columns ``keep`` of ``docs``, and size, source size, target and copies by the names in ``results``."""
    tables = Tables(docs.sparkSession, "mix")
    source, own, salt, name, whole, edge = free(docs, "_source", "_draw", "_salt", "_name", "_whole", "_edge")
    size, source_size, target, copies = results
    kept = [docs[c] for c in keep]
    full = docs.select(*kept, docs[source_col].alias(source), words(docs[text_col]).alias(size), draw(docs[id_col], seed).alias(own))
    if text_col not in keep:  # without texts the table is small: count words once
        full = tables.cut(full, "sizes")
    sized = full.select(F.col(source).alias("_source"), F.col(size).alias("_size"), F.col(own).alias("_draw"))
    rates = tables.cut(plan(sized, tables=tables, **options), "rates").toDF(name, source_size, target, whole, edge)
    rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = F.col(source).eqNullSafe(F.col(name)) & (F.pmod(F.col(own), F.lit(SALTS)) == F.col(salt))
    n = (F.col(whole) + (F.col(own) < F.col(edge)).cast("long")).cast("int")
    return full.join(rates, met).select(*keep, size, source_size, target, n.alias(copies))


def draw_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: str = SEED, **options
) -> DataFrame:
    """``docs`` (columns ``keep``, else all) with _size, _source_size, _target and _copies, the times each is emitted."""
    columns = [c for c in docs.columns if c not in RESULTS]
    columns = columns if keep is None else [c for c in columns if c in keep]
    return _drawn(docs, id_col, text_col, source_col, columns, list(RESULTS), seed, **options)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """``docs``' rows, each as often as the mix takes it."""
    names = free(docs, *RESULTS, "_copy")
    drawn = _drawn(docs, id_col, text_col, source_col, docs.columns, names[:4], seed, **options)
    drawn = drawn.filter(F.col(names[3]) > 0)
    return drawn.withColumn(names[4], F.explode(F.array_repeat(F.lit(0), F.col(names[3])))).select(*docs.columns)
