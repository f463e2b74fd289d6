"""Keyword extraction: frequency, acronyms, science patterns, vocabulary hits, scores and top terms of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import arrays as A
from lexiflow.functions import scores as S
from lexiflow.functions import text as T
from lexiflow.functions import values as V
from lexiflow.functions.patterns import PATTERNS
from lexiflow.operators import matching
from lexiflow.operators import terms as O
from lexiflow.operators import words as W
from lexiflow.sources.tables import tokens

_STOPS, _STARTERS = list(V.STOP_WORDS), list(V.STARTERS)


def keyword_frequency(paras: DataFrame, k: int = 5, stops=_STOPS, starters=_STARTERS) -> DataFrame:
    """The k most frequent cleaned tokens of each document (a top-k report); ties by first place."""
    t = paras.select("doc_id", "para_idx", F.posexplode(T.cleaned_tokens(F.col("text"))).alias("tok_idx", "term"))
    t = t.filter((F.length("term") >= 3) & ~F.col("term").isin(stops) & ~F.col("term").isin(starters))
    n = t.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min(F.shiftleft(F.col("para_idx").cast("long"), 32) + F.col("tok_idx")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("doc_id", "term", "n", "rank")


def acronyms(paras: DataFrame, stops=_STOPS) -> DataFrame:
    """(doc_id, acronym, n, first): all-capital tokens of 2 to 6 letters and dotted abbreviations."""
    raw = F.col("raw")
    dotted, plain = T.trim_edges(raw, "A-Z."), T.trim_edges(raw, "A-Z")
    is_dotted = dotted.rlike(r"^([A-Z]\.)+[A-Z]?$")
    term = F.when(is_dotted, T.dotted_form(dotted)).when(plain.rlike("^[A-Z]{2,6}$"), F.lower(plain))
    t = tokens(paras).select("doc_id", term.alias("acronym"), (F.shiftleft("para_idx", 32) + F.col("tok_idx")).alias("place"))
    return t.filter(F.col("acronym").isNotNull() & ~F.col("acronym").isin(stops)).groupBy("doc_id", "acronym").agg(F.count("*").alias("n"), F.min("place").alias("first"))


def rare_long_words(paras: DataFrame) -> DataFrame:
    """(doc_id, word, n): words of 8 letters or more that a document has once or twice."""
    t = tokens(paras).select("doc_id", T.letters(F.col("raw")).alias("word")).filter(F.length("word") >= 8)
    return t.groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter("n <= 2")


def texts_of(paras: DataFrame) -> DataFrame:
    """(doc_id, paras) of paragraphs that come from many rows of a document or page, which is what bounds a list."""
    return paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("paras"))


def full_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, text): the paragraphs of a row joined by spaces."""
    return texts.select("doc_id", F.array_join(F.transform("paras", lambda x: x["text"]), " ").alias("text"))


def science_terms(texts: DataFrame, names=None) -> DataFrame:
    """(doc_id, kind, term, n) per pattern, lower case."""
    # F.trim itself would take an element's place as the characters to trim.
    bare = lambda t: F.trim(t)
    found = [F.transform(F.filter(F.transform(_found(name, p), bare), _at_least(least)), _tagged(name)) for name, p, least in PATTERNS if names is None or name in names]
    out = texts.select("doc_id", F.explode(F.concat(*found)).alias("x")).select("doc_id", "x.kind", "x.term")
    return out.groupBy("doc_id", "kind", "term").agg(F.count("*").alias("n"))


#: Patterns that are words with an ending: endings and least letters before them.
_ENDINGS = {"suffix": (V.SCIENCE_SUFFIXES, 3), "drug": (V.DRUG_STEMS, 4)}


def _found(name: str, pattern: str) -> Column:
    # A gene's last letter may be a Greek one, which needs a boundary of either kind behind it.
    if name in _ENDINGS:
        return T.found_endings(F.col("text"), *_ENDINGS[name])
    return (T.found_from_letters if name == "gene" else T.found_words)(F.col("text"), pattern)


def _at_least(least: int):
    return lambda t: F.length(t) >= least


def _tagged(name: str):
    return lambda t: F.struct(F.lit(name).alias("kind"), F.lower(t).alias("term"))


def vocabulary_hits(paras: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term): different tokens that the vocabulary holds."""
    t = paras.select("doc_id", F.explode(T.cleaned_tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 2)
    return t.distinct().join(vocab.select("term"), "term", "left_semi").select("doc_id", "term")


def term_flags(
    paras: DataFrame, vocab: DataFrame, entities: DataFrame | None = None, italics: DataFrame | None = None, texts: DataFrame | None = None,
    stops=_STOPS, ids: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, term, in_science, in_acronym, in_vocabulary, in_entity, source_rank): one pass over each text.

    Science terms are those of the patterns and ``italics``; ``entities`` of stop words alone are left out.  ``texts``: the paragraphs by
    document, where they are at hand.
    """
    terms = O.document_flags(texts_of(paras) if texts is None else texts, entities, italics, stops, ids)
    terms = terms.join(vocab.select("term").distinct().withColumn("_listed", F.lit(True)), "term", "left")
    has = lambda bit: F.col("sources").bitwiseAND(bit) > 0
    flags = {"in_science": has(O.SCIENCE), "in_acronym": has(O.ACRONYM), "in_vocabulary": has(O.WORD) & F.coalesce("_listed", F.lit(False)), "in_entity": has(O.ENTITY)}
    rank = F.when(F.col("in_entity"), 1).when(F.col("in_acronym"), 2).when(F.col("in_science"), 3).otherwise(4).cast("long")
    found = terms.select("doc_id", "term", *(c.alias(name) for name, c in flags.items()))
    return found.filter(" OR ".join(flags)).withColumn("source_rank", rank)


def score_term(n: Column, weight: Column, rank: Column, science: Column, entity: Column, acronym: Column, complexity: Column) -> Column:
    two = lambda flag: F.when(flag, 2.0).otherwise(1.0)
    specialist = (weight > 1) | science | entity | acronym
    rest = F.when(specialist, S.rarity_bonus(rank)).otherwise(F.greatest(complexity, F.lit(1.0)))
    return F.log2(n.cast("double") + 1) * weight * rest * two(science) * two(entity) * two(acronym)


def keyword_scores(
    paras: DataFrame, freq: DataFrame, vocab: DataFrame, entities: DataFrame | None = None, italics: DataFrame | None = None,
    texts: DataFrame | None = None, stops=_STOPS, starters=_STARTERS, ids: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, term, n, score, rank): every term of a document, best first; ties by source, first place, term.

    Terms that only a set holds are counted in the full text, all of a document's in one pass, 1 if it has none.
    """
    return scored_terms(O.document_terms(texts_of(paras) if texts is None else texts, entities, italics, stops, starters, ids), freq, vocab)


def scored_terms(terms: DataFrame, freq: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same from a document's terms as ``document_terms`` gives them."""
    # What depends on a word alone is worked out once a word, before the words of documents meet it.
    own = A.let(F.col("word"), lambda w: S.complexity(w, F.col("rank")))
    ranked = freq.select(F.col("word").alias("term"), F.col("rank").alias("_rank"), own.alias("_complexity"))
    weighted = vocab.select("term", F.col("weight").alias("_weight"), F.lit(True).alias("_listed"))
    known = ranked.join(weighted, "term", "full")
    terms = W.by_word(terms, known, F.col("_rank") < W.COMMON, "term")
    has = lambda bit: F.col("sources").bitwiseAND(bit) > 0
    science, entity, acronym = (has(bit) for bit in (O.SCIENCE, O.ENTITY, O.ACRONYM))
    listed = has(O.WORD) & F.coalesce("_listed", F.lit(False))
    terms = terms.filter(has(O.COUNTED) | science | entity | acronym | listed)
    source = F.when(entity, 1).when(acronym, 2).when(science, 3).when(listed, 4).otherwise(0)
    # Few terms are in no list.  Spelled out in the row's code their complexity would make it too large for the JVM to compile (8,000 bytes).
    complexity = F.coalesce("_complexity", A.let(F.col("term"), lambda t: S.complexity(t, F.col("_rank"))))
    score = score_term(F.col("n"), F.coalesce("_weight", F.lit(1.0)), F.col("_rank"), science, entity, acronym, complexity)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "_source", F.coalesce("first", F.lit(1 << 62)), "term")
    scored = terms.select("doc_id", "term", "n", "first", source.alias("_source"), F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).select("doc_id", "term", "n", "score", "rank")


def paragraph_top_terms(paras: DataFrame, scored: DataFrame, percent: float = 50, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, para_idx, term, score, rank): each paragraph's best terms, the top ``percent`` and one at least."""
    return matching.top_terms(texts_of(paras) if texts is None else texts, scored, percent)
