"""Column functions over arrays."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def running(values: Column, combine: Callable[[Column, Column], Column] = operator.add) -> Column:
    """An array's sums (or what an associative ``combine`` makes) up to each place, by doubling: n log n, nothing is appended."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int"))
    before = lambda a, i, k: F.get(a, i - F.call_function("shiftleft", F.lit(1), k))
    both = lambda a, x, i, k: F.coalesce(combine(before(a, i, k), x), x)
    return F.aggregate(rounds, values, lambda a, k: F.transform(a, lambda x, i: both(a, x, i, k)))


def last_at_most(rising: Column, value: Column) -> Column:
    """The place in an array in rising order of its last element <= ``value``; -1 where there is none.  Binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(rising) + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(-1).alias("lo"), F.size(rising).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below, open_ = F.get(rising, middle) <= value, a["hi"] - a["lo"] > 1
        low = F.when(open_ & below, middle).otherwise(a["lo"])
        high = F.when(open_ & ~below, middle).otherwise(a["hi"])
        return F.struct(low.alias("lo"), high.alias("hi"))

    return F.aggregate(steps, start, step)["lo"]


def placed(hits: Column, pieces: Column) -> Column:
    """(start, end) of each of a text's matches, in code points; ``pieces`` is the text split by the same pattern."""

    def places(hit: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, 1, F.size(hit)), hit, lambda p, h: F.length(p) + F.length(h))
        return let(sizes, lambda s: F.zip_with(running(s), hit, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"))))

    return F.when(F.size(hits) > 0, places(hits)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
