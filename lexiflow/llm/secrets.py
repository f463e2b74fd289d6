"""Secret scans (operator 1), DataFrame functions only.

Three patterns give base spans.  Beyond them, runs of 20 or more token characters are candidates: a run's
class (hex, base64 or alnum) sets a threshold, and a window slides over the run.  Its Shannon entropy
follows from one count going down and one going up a step: counts stand in a 128-character table, and
the sum of c log2 c changes by two terms.  A run whose best window reaches its threshold is a span, unless
an allow-list fits it (words, numbers, paths, UUIDs, alphabets) or a base span covers part of it.

A match's place comes from running sums of the lengths of the pieces between matches, so each pattern reads the
text once, and a second time only where it matched; a run finds base spans around it by binary search.  Work grows
with a text's matches as n log n.  Everything happens inside the row: no shuffle.

Defined results: a null text is empty and has no spans; places are code points, ends exclusive; repeated
rows give repeated rows; texts of any length are read whole; an empty table gives no rows; extra columns
stay, but for those named like the four results of ``scan``, which give way to them there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.arrays import last_at_most, let, placed, running
from lexiflow.llm.common import free

#: Kind, pattern, group that is measured, least length; in the order of the spans' kinds.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}+", 0, 16),  # the runs of [0-9a-f]+ that are long enough: short ones are in every word
)
KINDS = (*(kind for kind, *_ in BASE), "entropy")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
_SPANS = "array<struct<start:int,end:int,value:string>>"
#: Bits that a window must reach, by class; a window of 20 has 4.32 at most, of hex digits 3.92 at most.
THRESHOLDS = {"hex": 3.0, "base64": 3.8, "alnum": 3.6}
ALLOW = (
    r"^[A-Za-z+/_=-]*$",  # words and paths
    r"^[0-9+/_=-]*$",  # numbers and dates
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)abcdefgh|12345678|qwertyui|example|placeholder|xxxxxxxx",  # alphabets and samples
    r"^[A-Za-z]+[0-9]{1,4}$|^([A-Za-z]+[/_=+-]+)+[0-9]{1,4}[/_=+-]*$",  # a word or path with a number
)

_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of every match, leftmost and not overlapping; value: what the group holds."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)

    whole = lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value"))
    found = let(hits, lambda hit: F.when(F.size(hit) > 0, F.zip_with(placed(hit, pieces), values, whole)))
    return F.coalesce(found, F.expr("array()").cast(_SPANS))


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of ``window`` characters of an ASCII string."""
    clog = F.array(*map(F.lit, _CLOG))
    count = lambda table, code: F.ascii(F.substr(table, code + 1, F.lit(1))) - 1
    put = lambda table, code, c: F.overlay(table, F.char(c + 1), code + 1, F.lit(1))

    def change(state: Column, code: Column, by: int) -> Column:
        c = count(state["table"], code)
        return F.struct(put(state["table"], code, c + by).alias("table"), (state["s"] + F.get(clog, c + by) - F.get(clog, c)).alias("s"))

    def step(a: Column, i: Column, chars: Column) -> Column:
        code_at = lambda k: F.ascii(F.get(chars, k - 1))
        left = let(F.when(i > window, code_at(i - window)), lambda code: F.when(code.isNotNull(), change(a, code, -1)).otherwise(F.struct(a["table"].alias("table"), a["s"].alias("s"))))
        entered = let(left, lambda x: let(code_at(i), lambda code: change(x, code, 1)))
        best = lambda x: F.when(i >= window, F.least(a["least"], x["s"])).otherwise(a["least"])
        return let(entered, lambda x: F.struct(x["table"].alias("table"), x["s"].alias("s"), best(x).alias("least")))

    start = F.struct(F.lit("\x01" * 128).alias("table"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
    # An array of characters: a place in a string is found from its beginning, which is quadratic on long runs.
    least = let(F.split(run, "", -1), lambda chars: F.aggregate(F.sequence(F.lit(1), F.length(run)), start, lambda a, i: step(a, i, chars))["least"])
    return F.lit(math.log2(window)) - least / window


def looks_secret(run: Column) -> Column:
    """Whether no allow-list fits the run and its best window reaches the threshold of its class."""
    allowed = run.rlike(ALLOW[0])
    for pattern in ALLOW[1:]:
        allowed = allowed | run.rlike(pattern)
    hexes, mixed = run.rlike("^[0-9a-fA-F]+$"), run.rlike("[A-Z]") & run.rlike("[a-z]") & run.rlike("[0-9]")
    threshold = F.when(hexes, THRESHOLDS["hex"]).when(mixed, THRESHOLDS["base64"]).otherwise(THRESHOLDS["alnum"])
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(run) >= threshold)


def _uncovered(runs: Column, taken: list[str]) -> Column:
    """Those of ``runs`` that share no character with the spans of the columns, each rising without overlaps."""

    def without(found: Column, name: str) -> Column:
        spans = F.col(name)

        def apart(m: Column, starts: Column) -> Column:
            return ~F.coalesce(F.get(spans, last_at_most(starts, m["end"] - 1))["end"] > m["start"], F.lit(False))

        own = let(F.transform(spans, lambda b: b["start"]), lambda starts: F.filter(found, lambda m: apart(m, starts)))
        return F.when(F.size(spans) > 0, own).otherwise(found)

    return functools.reduce(without, taken, runs)


def _scanned(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``docs`` with the spans of the three base kinds and of entropy in columns of these names."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def long_enough(least: int) -> Callable[[Column], Column]:
        return lambda m: F.length(m["value"]) >= least

    for name, (_, pattern, group, least) in zip(names, BASE, strict=False):
        docs = docs.withColumn(name, F.filter(_matches(text, pattern, group), long_enough(least)))
    runs = F.filter(_matches(text, CANDIDATE), lambda m: looks_secret(m["value"]))
    # A column of its own, so that it is computed once however often it is looked at.
    docs = docs.withColumn(names[-1], runs)
    return docs.withColumn(names[-1], _uncovered(F.col(names[-1]), names[:-1]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _assign, _access, _hex and _entropy: arrays of (start, end, value)."""
    return _scanned(docs, text_col, [f"_{kind}" for kind in KINDS])


def spans(kinds: list[str]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""

    def entry(rank: int, kind: str):
        return lambda m: F.struct(m["start"].alias("s"), F.lit(rank).alias("k"), F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")).alias("t"))

    each = [F.transform(F.col(f"_{kind}"), entry(i, kind)) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["t"]), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced; overlapping spans become one mark."""
    names = free(docs, *(f"_{kind}" for kind in KINDS), "_flat", "_past")
    flat, past, text = names[-2], names[-1], F.col(text_col)
    place = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    out = _scanned(docs, text_col, names[:4])
    out = out.withColumn(flat, F.array_sort(F.transform(F.concat(*map(F.col, names[:4])), place)))
    out = out.withColumn(past, running(F.transform(F.col(flat), lambda m: m["end"]), F.greatest))

    def piece(m: Column, i: Column) -> Column:
        """The text since the spans before, and a mark; nothing where they reach into this one."""
        done = F.coalesce(F.get(F.col(past), i - 1), F.lit(0))
        between = F.concat(F.substr(text, done + 1, m["start"] - done), F.lit(mark))
        return F.when(m["start"] >= done, between).otherwise("")

    tail = F.substr(text, F.array_max(past) + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform(F.col(flat), piece), ""), tail)
    own = F.when(F.size(flat) > 0, whole).otherwise(text)
    return out.select(*(own.alias(c) if c == text_col else F.col(c) for c in docs.columns))
