"""MinHash near-dedup (operator 2) with tensored banding and exact verification.

Each text gives ``2 * SIDE`` small collections of ``ROWS`` minhashes.  A table's key joins one collection of the
left side with one of the right, so SIDE * SIDE tables of 2 * ROWS rows each come from 2 * SIDE * ROWS
minhashes in place of 2 * SIDE * SIDE * ROWS.  With 8 x 8 tables of 6 rows a link at exactly 85 % is missed with
probability 1e-3, at 80 % with 6e-3, at 90 % with 3e-5; chance collisions stay rare.

1. Equal shingle sets (exact copies) collapse to the smallest doc_id by a partial aggregate, over a 128-bit
   cryptographic digest of the whole set.
2. Representatives that share a table key meet under the bucket's leader, the member with most collisions in
   all tables, so a group of near copies meets under few leaders.  No pair is emitted: memberships
   (leader, document) are linear in the tables.
3. A leader's members are dealt to blocks of bounded size, the leader itself to all of them, so that blocks of one
   group of copies join by it; a task holds one block, gets whole texts, and counts every pair's intersection
   exactly by a product of 0/1 matrices.  It emits a spanning forest of its links.
4. Components come from alternating star contraction over the links, in Spark.
5. Where a leader has several blocks that components don't join yet, its stragglers (members outside its
   largest component) are verified against every block that they can reach: sets link only where
   100 * smaller >= percent * larger, so a straggler meets members of such sizes alone.  Members of the largest
   component need no second look at each other, and no link between different texts is lost to the blocks.

Joins of per-document tables are merge joins at every size: none of these tables has a bound, and the plan that
is tested small is the one that runs large.  Elsewhere (links, components) Spark broadcasts a side where it finds it
under its size limit.  Leaders with very many members are salted in joins.  All that is sent on is in tables of the shared folder, deleted once used;
nothing per document reaches the driver.

Defined results: a null, empty or blank text has no shingles and links with nothing; a text of fewer words
has one shingle, all its words; several rows of one doc_id are one document; a null doc_id has no
component, links with nothing and is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import Tables, chunks, free, mix

SIDE, ROWS = 8, 3
#: Keys with more than one in so many of all rows are joined by broadcasting: fewer than so many.
HOT = 2000
#: A block's members, and their shingles together, in expectation; parts of a leader's members in joins.
BLOCK, BLOCK_SHINGLES, SALTS = 256, 1 << 20, 16

_HASHES = 2 * SIDE * ROWS
_A = mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1, _HASHES + 1, dtype=np.uint64) + np.uint64(1 << 40))
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) + np.uint64(1 << 41)) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each row's different shingles, as rising 64-bit hashes."""
    for _, text in chunks(column, lower=True):
        h = text.hashes()
        n = max(len(h) - words + 1, 0)
        s = np.zeros(n, np.uint64)
        for k in range(words):
            s = mix(s + h[k : k + n] * _PLACES[k])
        for lo, hi in zip(text.first[:-1].tolist(), text.first[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(s[lo : hi - words + 1])
            elif hi > lo:
                few = h[lo:hi]
                yield mix((few * _PLACES[: len(few)]).sum(keepdims=True) + np.uint64(len(few)))
            else:
                yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    whole = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def minhash(shingles: np.ndarray) -> np.ndarray:
    out = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(out, (part[:, None] * _A + _B).min(axis=0), out=out)
    return out


def collections(signature: np.ndarray) -> np.ndarray:
    """The 2 * SIDE collections, left ones first, each hashed to a long."""
    rows = mix(signature).reshape(2 * SIDE, ROWS)
    out = np.arange(2 * SIDE, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * _PLACES[k] + rows[:, k])
    return out.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n, a and b (the set's digest), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                first, second = digest(s)
                a.append(first)
                b.append(second)
                keys.append(collections(minhash(s)) if len(s) else None)
            numbers = [pa.array(x, pa.int64()) for x in (n, a, b)]
            arrays = [batch.column(0), *numbers, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "a", "b", "keys"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, a long, b long, keys array<long>")


def links_of(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: (member, smaller member) numbers, one for each joined member."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    if not len(owner):
        return []
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    inverse = np.cumsum(np.diff(inverse, prepend=inverse[:1]) != 0) if len(inverse) else inverse
    both = np.zeros((m, m), np.float64)
    width = max(1, min(8192, (1 << 22) // m))
    top = int(inverse[-1]) + 1 if len(inverse) else 0
    for at in range(0, top, width):
        lo, hi = np.searchsorted(inverse, (at, at + width))
        part = np.zeros((m, min(width, top - at)), np.float32)
        part[owner[lo:hi], inverse[lo:hi] - at] = 1
        both += part @ part.T
    inter = both.astype(np.int64)
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    linked &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.tril(linked, -1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, r) for i in range(m) if (r := root(i)) != i]


def _verified(placed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v), u > v: links within each group of ``placed`` (g, h, rep), by the ``texts`` (rep, text) of all its members."""
    rows = placed.hint("merge").join(texts, "rep").select("g", "h", "rep", "text")
    rows = rows.repartition("g", "h").sortWithinPartitions("g", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reps, sets = None, [], []

        def found() -> tuple[list[int], list[int]]:
            u, v = [], []
            if len(reps) > 1:
                order = sorted(range(len(reps)), key=reps.__getitem__)
                for i, j in links_of([sets[k] for k in order], percent):
                    if reps[order[i]] != reps[order[j]]:
                        u.append(reps[order[i]])
                        v.append(reps[order[j]])
            return u, v

        for batch in batches:
            us, vs = [], []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, rep, s in zip(keys, batch.column(2).to_pylist(), shingle_sets(batch.column(3), words), strict=True):
                if key != group:
                    u, v = found()
                    us += u
                    vs += v
                    group, reps, sets = key, [], []
                reps.append(rep)
                sets.append(s)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        us, vs = found()
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def _apart(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``by_key`` (key, others, size: a row for each key, and its rows), keys with many rows apart.

    A key with more than one in ``HOT`` of ``total`` rows is one of fewer than ``HOT`` such keys: these are broadcast, and their rows go on evenly
    dealt, whichever key a third of all rows has.  The others meet by a merge join.
    """
    values = [c for c in by_key.columns if c not in (key, "size")]
    few = F.col("size") * HOT > total
    value = F.struct(*values, "size")
    hot = by_key.filter(few).select(key, value.alias("_hot"))
    cold = by_key.filter(~few).select(F.col(key).alias("_key"), F.lit(0).alias("_part"), value.alias("_cold"))
    own = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    out = rows.join(F.broadcast(hot), key, "left").withColumn("_key", own).withColumn("_part", F.when(F.col("_hot").isNull(), 0).otherwise(1))
    out = out.hint("merge").join(cold, ["_key", "_part"], "left").withColumn("_value", F.coalesce("_hot", "_cold")).filter("_value IS NOT NULL")
    return out.select(*rows.columns, *(F.col("_value")[c].alias(c) for c in (*values, "size")))


def connected(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.  Alternating large and small stars."""
    tables = tables or Tables(links.sparkSession, "components")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    name = f"edges-{tables.number}"
    edges = tables.cut(links.filter("u > v").distinct(), name)
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state = edges.agg(F.count("*"), mark).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = _apart(both.filter("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
        small = _apart(large, least, "u", state[0]).select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e"))
        before, name = name, f"edges-{tables.number}"
        edges = tables.cut(small.select("e.u", "e.v").filter("u > v").distinct(), name)
        tables.drop(before)
        now = edges.agg(F.count("*"), mark).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _memberships(reps: DataFrame, tables: Tables) -> DataFrame:
    """(leader, rep, n): under which leaders a representative meets others, itself included."""
    sides = [[F.get("keys", s * SIDE + i) for i in range(SIDE)] for s in (0, 1)]
    pairs = [(a, b, i * SIDE + j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1])]
    rows = reps.select("rep", "n", F.explode(F.array(*(F.xxhash64(a, b, F.lit(t)) for a, b, t in pairs))).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    total = reps.count() * len(pairs)
    rows = tables.cut(_apart(rows, shared, "key", total), "buckets")
    weight = rows.groupBy("rep").agg(F.sum("size").alias("weight"))
    rows = rows.hint("merge").join(weight, "rep")
    first = F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top")
    leader = rows.groupBy("key").agg(first, F.count("*").alias("size")).select("key", (-F.col("top.rep")).alias("leader"), "size")
    out = _apart(rows.drop("size"), leader, "key", total).select("leader", "rep", "n").distinct()
    out = tables.cut(out, "memberships")
    tables.drop("buckets")
    return out


def _salted(members: DataFrame, by_leader: DataFrame, how: str) -> DataFrame:
    """Members (leader, rep, ...) joined with rows for leaders; a leader's members are dealt to SALTS parts."""
    members = members.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    parts = by_leader.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.join(parts, ["leader", "_salt"], how).drop("_salt")


def _blocks(members: DataFrame) -> DataFrame:
    """Members with blocks, their leader's number of blocks, and block."""
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    several = members.groupBy("leader").agg(size.alias("blocks")).filter("blocks > 1")
    out = _salted(members, several, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return out.withColumn("block", F.pmod(F.xxhash64("rep", "leader"), F.col("blocks")).cast("int"))


def _second_look(wide: DataFrame, percent: int) -> DataFrame:
    """(g, h, rep): stragglers with all members of their leader that they can reach in size, block by block.

    ``wide``: leader, rep, n, block and component of leaders with several blocks.
    """
    parts = wide.groupBy("leader", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("leader").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component"))["component"].alias("largest"))
    wide = _salted(wide, largest.filter("parts > 1").drop("parts"), "inner")
    # Stragglers of like sizes share a block.
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("long")
    lost = wide.filter("component != largest").withColumn("kind", kind).drop("block")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("several")
    several = lost.groupBy("leader", "kind").agg(size)
    lost = lost.join(several, ["leader", "kind"])
    lost = lost.withColumn("own", F.col("kind") * (1 << 20) + F.pmod(F.xxhash64("rep", "leader"), F.col("several")))
    ranges = lost.groupBy("leader", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = (F.col("low") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("high") * 100)
    met = _salted(wide, ranges, "inner").filter(near).select("leader", "block", "own", "rep")
    others = lost.join(met.select("leader", "block", "own").distinct(), ["leader", "own"])
    placed = met.unionByName(others.select("leader", "block", "own", "rep")).distinct()
    return placed.select(F.col("leader").alias("g"), (F.col("own") * (1 << 24) + F.col("block")).alias("h"), "rep")


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v): different components that ``links`` join."""
    for name in ("u", "v"):
        links = links.join(labels.toDF(name, f"_{name}"), name, "left").withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")
    return links.filter("u != v").distinct()


def component_table(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    tables = Tables(docs.sparkSession, "neardup")
    sketches = tables.cut(sketch(docs, id_col, text_col, words), "sketch")
    full = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    same = full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    reps = tables.cut(same, "reps")
    members = tables.cut(_blocks(_memberships(reps.select("rep", "n", "keys"), tables)), "blocks")
    tables.drop("memberships")
    # All texts move once; those of members are kept for both looks.
    texts = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("text"))
    texts = tables.cut(texts.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi"), "texts")
    own = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    everywhere = members.filter("blocks > 1 AND rep = leader").select("leader", own, "rep")
    placed = members.select("leader", "block", "rep").unionByName(everywhere.filter(F.col("block").isNotNull())).distinct()
    placed = placed.select(F.col("leader").alias("g"), F.col("block").cast("long").alias("h"), "rep")
    links = tables.cut(_verified(placed, texts, words, percent), "links")
    # Copies of one document that differ from row to row tie their sets' representatives together.
    several = full.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    ties = full.select("doc_id", "a", "b", "n").join(several, "doc_id").join(reps.select("a", "b", "n", "rep"), ["a", "b", "n"])
    ties = ties.filter("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    labels = connected(links.unionByName(ties), tables)
    wide = members.filter("blocks > 1").join(labels, F.col("rep") == F.col("node"), "left")
    wide = wide.select("leader", "rep", "n", "block", F.coalesce("component", "rep").alias("component"))
    wide = tables.cut(wide, "wide")
    if not wide.isEmpty():
        more = _verified(_second_look(wide, percent), texts, words, percent)
        joins = tables.cut(_between(more, labels), "joins")
        if not joins.isEmpty():
            merged = connected(joins, tables).toDF("_old", "_new")
            renamed = labels.join(merged, F.col("component") == F.col("_old"), "left")
            # A component of one node has no label yet.
            alone = merged.join(labels, F.col("_old") == F.col("node"), "left_anti").toDF("node", "component")
            labels = renamed.select("node", F.coalesce("_new", "component").alias("component")).unionByName(alone)
    classes = reps.select("a", "b", "n", "rep").hint("merge").join(labels, F.col("rep") == F.col("node"), "left")
    classes = tables.cut(classes.select("a", "b", "n", F.coalesce("component", "rep").alias("_component")), "classes")
    tables.drop(*(name for name in list(tables.paths) if name not in ("sketch", "classes")))
    out = sketches.select("doc_id", "n", "a", "b").hint("merge").join(classes, ["a", "b", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    out = component_table(docs, words, percent, id_col, text_col)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the smallest id's; a repeated row of it stays with it."""
    (name,) = free(docs, "_gone")
    gone = components(docs, words, percent, id_col, text_col).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
