"""Word complexity, sentences, offsets and citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import arrays as A
from lexiflow.functions import scores as S
from lexiflow.functions import text as T
from lexiflow.operators import matching


def words(paras: DataFrame) -> DataFrame:
    """(doc_id, para_idx, word): words as written."""
    return paras.select("doc_id", "para_idx", F.explode(T.find_all(F.col("text"), T.WORD)).alias("word"))


def word_complexity(paras: DataFrame, freq: DataFrame) -> DataFrame:
    """(word, n, syllables, score): the corpus's different lower-case words, each scored once."""
    n = words(paras).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    scored = n.join(freq, "word", "left")
    return scored.select("word", "n", S.syllables_word(F.col("word")).cast("long").alias("syllables"), F.round(S.complexity(F.col("word"), F.col("rank")), 6).alias("score"))


#: Words of a rank below this are looked up in a broadcast list, which is as long as this at most; others by shuffling.
COMMON = 2000


def by_word(rows: DataFrame, words: DataFrame, common: Column, on: str = "word", undecided: Column | None = None) -> DataFrame:
    """``rows`` left joined with ``words`` (unique ``on``), those that are ``common`` apart, so that no frequent word meets in one task.

    ``common`` must hold for a bounded number of words.  ``undecided``: of rows with common words, which go on, by columns of ``words``.
    """
    values = [c for c in words.columns if c != on]
    packed = words.select(on, F.struct(*values).alias("_w"), F.coalesce(common, F.lit(False)).alias("_c"))
    few = packed.filter("_c").select(on, F.col("_w").alias("_a"))
    many = packed.filter("NOT _c").select(F.col(on).alias("_key"), F.col("_w").alias("_b"))
    out = rows.join(F.broadcast(few), on, "left")
    if undecided is not None:
        out = out.select("*", *(F.col("_a")[c].alias(f"_a_{c}") for c in values)).filter(F.col("_a").isNull() | undecided).drop(*(f"_a_{c}" for c in values))
    # Rows that are done with are dealt out evenly: their key is no word.
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*(c for c in rows.columns)), F.lit(1024)).cast("string"))
    out = out.withColumn("_key", F.when(F.col("_a").isNotNull(), spread).otherwise(F.col(on))).join(many, "_key", "left")
    value = F.coalesce("_a", "_b")
    return out.select(*rows.columns, *(value[c].alias(c) for c in values))


def _tiered(rows: DataFrame, freq: DataFrame, level: str) -> DataFrame:
    """``rows`` with the tier of their word, those without one left out.  A word that no list holds has no rank."""
    ranked = freq.withColumn("tier", S.tier(S.complexity(F.col("word"), F.col("rank")), level))
    out = by_word(rows, ranked, F.col("rank") < COMMON, undecided=F.col("_a_tier").isNotNull())
    unknown = S.tier(S.complexity(F.col("word"), F.lit(None).cast("long")), level)
    return out.withColumn("tier", F.when(F.col("rank").isNull(), unknown).otherwise(F.col("tier"))).filter("tier IS NOT NULL").drop("rank")


def complex_vocabulary(paras: DataFrame, freq: DataFrame, level: str = "medium") -> DataFrame:
    """(doc_id, word, n, tier): words never capitalised that reach the level."""
    n = words(paras).filter(~F.col("word").rlike("^[A-Z]")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return _tiered(n, freq, level).select("doc_id", "word", "n", "tier")


_WORD = re.compile(T.WORD, re.A)
_PLACED = pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string())]))


def small(text: str) -> Iterator[re.Match]:
    """Words of two letters or more that begin with a small one."""
    return (m for m in _WORD.finditer(text) if m.end() - m.start() > 1 and not "A" <= text[m.start()] <= "Z")


def small_words(paras: DataFrame) -> DataFrame:
    """(doc_id, para_idx, start, word): words of two letters or more that begin with a small one, with their places in code points."""

    def found(text: str | None) -> list[tuple[int, str]]:
        return [(m.start(), m[0]) for m in small(text or "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in matching.pieces(batches, 1024):
            words = pa.array([found(x) for x in batch.column(2).to_pylist()], _PLACED)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], words], ["doc_id", "para_idx", "words"])

    own = paras.select(F.col("doc_id").cast("long"), F.col("para_idx").cast("long"), "text")
    rows = own.mapInArrow(run, "doc_id long, para_idx long, words array<struct<start: int, word: string>>")
    return rows.select("doc_id", "para_idx", F.explode("words").alias("x")).select("doc_id", "para_idx", "x.start", "x.word")


def underline_tiers(paras: DataFrame, freq: DataFrame, level: str = "medium") -> DataFrame:
    """(doc_id, para_idx, start, end, word, tier): every occurrence, places in code points.

    Common words are done with before anything is shuffled.
    """
    placed = small_words(paras)
    out = _tiered(placed, freq, level)
    start = F.col("start").cast("long")
    return out.select("doc_id", "para_idx", start.alias("start"), (start + F.length("word")).alias("end"), "word", "tier")


def underlined_words(texts: DataFrame, freq: DataFrame, level: str = "medium") -> DataFrame:
    """(doc_id, words) of ``texts`` (doc_id, paras; ids are unique): a document's different words that ``underline_tiers`` gives, each looked up once.

    Documents without one are left out.
    """
    kinds = {"doc_id": pa.int64(), "words": pa.list_(pa.string())}

    def different(paras: list[dict]) -> list[str]:
        met = {w for p in paras for w in _WORD.findall(p["text"] or "")}
        return sorted(w for w in met if len(w) > 1 and not "A" <= w[0] <= "Z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in matching.pieces(batches, 64):
            yield matching.batch_of([(doc, different(paras)) for doc, paras in matching.read(batch)], kinds)

    rows = texts.select("doc_id", "paras").mapInArrow(run, "doc_id long, words array<string>").select("doc_id", F.explode("words").alias("word"))
    return _tiered(rows, freq, level).groupBy("doc_id").agg(F.collect_set("word").alias("words"))


def sentence_rows(paras: DataFrame, split=T.sentences) -> DataFrame:
    """(doc_id, para_idx, sent_idx, sentence)."""
    out = paras.select("doc_id", "para_idx", F.posexplode(split(F.col("text"))).alias("sent_idx", "sentence"))
    return out.withColumn("sent_idx", F.col("sent_idx").cast("long"))


#: A score's text counts by so many characters.
HEAD = 80


def sentence_split(paras: DataFrame, scored: DataFrame, split=None) -> DataFrame:
    """(doc_id, para_idx, sent_idx, sentence): list items of paragraphs scored split or llm, two sentences at least.

    A paragraph takes the first score of its document whose text's first 80 characters open it, by an equi-join: a paragraph's own
    beginnings, of the lengths that its document's scores have (80 at most), against the different beginnings of scores.  Paragraphs
    of one doc_id and para_idx take the same score.  ``paras`` may have these lengths in the row (``lengths``, an array).
    """
    head = F.substring("text", 1, HEAD)
    first = scored.select("doc_id", head.alias("_key"), F.struct("para_idx", "action").alias("_s")).groupBy("doc_id", "_key").agg(F.min("_s").alias("_s"))
    rows = paras
    if "lengths" not in paras.columns:
        rows = paras.join(first.groupBy("doc_id").agg(F.collect_set(F.length("_key")).alias("lengths")), "doc_id")
    beginnings = F.transform(F.filter("lengths", lambda n: n <= F.length("text")), lambda n: F.substring(F.col("text"), F.lit(1), n))
    opened = rows.select("doc_id", "para_idx", F.explode(beginnings).alias("_key")).join(first, ["doc_id", "_key"])
    met = opened.groupBy("doc_id", "para_idx").agg(F.min("_s").alias("_s")).filter(F.col("_s.action").isin("split", "llm")).select("doc_id", "para_idx")
    chosen = paras.drop("lengths").join(met, ["doc_id", "para_idx"], "left_semi")
    split = split or T.split_sentences
    return sentence_rows(chosen.filter(F.size(T.split_sentences(F.col("text"))) >= 2), split)


def heads_of(texts: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text, lengths) of ``texts`` (doc_id, paras): paragraphs with the lengths that beginnings in their row have."""
    lengths = F.array_distinct(F.transform("paras", lambda p: F.least(F.length(p["text"]), F.lit(HEAD))))
    return texts.select("doc_id", lengths.alias("lengths"), F.explode("paras").alias("p")).select("doc_id", "p.para_idx", "p.text", "lengths")


#: Actions in order, as numbers; a paragraph is split unless its score asks for nothing.
_ACTIONS = {"llm": 0, "none": 1, "split": 2}


def sentence_split_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, para_no, sent_idx, sentence) of ``rows`` (doc_id, and arrays paras and scored of para_idx and text): ``sentence_split`` inside
    the row, nothing is shuffled.  para_no counts a document's split paragraphs from 1; ids are unique.

    Beginnings of scores are sorted once a row, and each paragraph's own, of the lengths that they have, are looked for by binary search.
    """
    code = lambda action: F.when(action == "llm", _ACTIONS["llm"]).when(action == "none", _ACTIONS["none"]).otherwise(_ACTIONS["split"])
    # The first score of equal beginnings sorts last, where the search ends.
    score = lambda s: F.struct(F.substring(s["text"], 1, HEAD).alias("key"), (-s["para_idx"]).alias("place"), (-A.let(S.action(s["text"]), code)).alias("code"))

    def placed(heads: Column, keys: Column, lengths: Column) -> Column:
        """(para_idx, place, code) of paragraphs that a score opens, in order."""
        met = lambda h, key: F.when(h["key"] == key, F.struct(h["place"].alias("place"), h["code"].alias("code")))
        opened = lambda key: A.let(F.get(heads, A.last_at_most(keys, key)), lambda h: met(h, key))
        # A length beyond the text's gives the text, which opens itself.
        best = lambda p: F.array_max(F.transform(lengths, lambda n: A.let(F.substring(p["text"], F.lit(1), n), opened)))
        of = lambda p, b: F.struct(p["para_idx"].alias("para_idx"), (-b["place"]).alias("place"), (-b["code"]).alias("code"))
        return F.array_sort(F.filter(F.transform("paras", lambda p: A.let(best(p), lambda b: of(p, b))), lambda m: m["code"].isNotNull()))

    def asked(met: Column, places: Column) -> Column:
        """Paragraphs to split; those of one para_idx take the same score."""
        first = lambda p: F.get(met, A.last_at_most(places, p["para_idx"] - 1) + 1)
        asks = lambda p: A.let(first(p), lambda m: F.coalesce((m["para_idx"] == p["para_idx"]) & (m["code"] != _ACTIONS["none"]), F.lit(False)))
        return F.transform(F.filter("paras", asks), lambda p: F.struct(p["para_idx"].alias("para_idx"), T.split_sentences(p["text"]).alias("l")))

    def numbered(lists: Column, order: Column) -> Column:
        return F.transform(lists, lambda x: F.struct((A.last_at_most(order, x["para_idx"]) + 1).cast("long").alias("para_no"), x["l"].alias("l")))

    # Each of these is worked out once a row.
    heads = F.array_sort(F.transform("scored", score))
    lengths = lambda keys: F.array_distinct(F.transform(keys, lambda k: F.length(k)))
    found = A.let(heads, lambda h: A.let(F.transform(h, lambda x: x["key"]), lambda k: A.let(lengths(k), lambda n: placed(h, k, n))))
    lists = A.let(found, lambda m: A.let(F.transform(m, lambda x: x["para_idx"]), lambda at: asked(m, at)))
    order = lambda own: F.array_sort(F.array_distinct(F.transform(own, lambda x: x["para_idx"])))
    split = A.let(F.filter(lists, lambda x: F.size(x["l"]) >= 2), lambda own: A.let(order(own), lambda o: numbered(own, o)))
    out = rows.select("doc_id", F.explode(split).alias("x")).select("doc_id", "x.para_no", F.posexplode("x.l").alias("sent_idx", "sentence"))
    return out.withColumn("sent_idx", F.col("sent_idx").cast("long"))


def citation_parentheticals(texts: DataFrame) -> DataFrame:
    """(doc_id, content, is_citation): parentheses without inner ones; a last number of a year, or ``et al``."""
    rows = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("content"))
    year = F.regexp_extract("content", r"(\d+)[^\d]*$", 1).rlike(r"^(19|20)\d{2}$")
    return rows.groupBy("doc_id", "content").agg(F.count("*").alias("n")).withColumn("is_citation", year | F.col("content").rlike(T.spark_pattern(r"(?i)\bet\s+al\b")))


def _starts(words: Column) -> Column:
    """Characters before each word, one between words."""
    return A.let(A.running(F.transform(words, lambda w: F.length(w) + 1)), lambda ends: F.zip_with(ends, words, lambda e, w: (e - F.length(w) - 1).cast("long")))


def word_offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word_idx, start, word): words of a text with the characters before them, one between words; each row for itself."""
    words = F.split(T.trimmed(F.col("text")), f"{T.JAVA_SPACE}+", -1)
    placed = A.let(words, lambda w: F.zip_with(_starts(w), w, lambda s, x: F.struct(s.alias("start"), x.alias("word"))))
    return rows.select(*keys, F.posexplode(placed).alias("word_idx", "x")).select(*keys, F.col("word_idx").cast("long").alias("word_idx"), "x.start", "x.word")


def offset_lookup(rows: DataFrame, places: Column, keys: list[str]) -> DataFrame:
    """(keys, at, word_idx, word): for each of a row's ``places`` the last word that starts there or before; word 0 where none does."""
    words = F.split(T.trimmed(F.col("text")), f"{T.JAVA_SPACE}+", -1)

    def found(w: Column, starts: Column, at: Column) -> Column:
        place = lambda i: F.struct(at.alias("at"), i.cast("long").alias("word_idx"), F.get(w, i).alias("word"))
        return A.let(F.greatest(A.last_at_most(starts, at), F.lit(0)), place)

    looked = A.let(words, lambda w: A.let(_starts(w), lambda s: F.transform(places, lambda at: found(w, s, at))))
    return rows.select(*keys, F.explode(looked).alias("x")).select(*keys, "x.*")
