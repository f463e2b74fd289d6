"""Readability and complexity scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions import arrays as A
from lexiflow.functions import text as T
from lexiflow.functions import values as V


def syllables_paragraph(word: Column) -> Column:
    """Runs of vowels, y included, after punctuation goes; at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(F.lower(word), "[.,!?()]", ""), F.lit("[aeiouy]+")))


def syllables_word(word: Column) -> Column:
    n = F.regexp_count(F.lower(word), F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), F.when(F.lower(word).endswith("e") & (n > 1), n - 1).otherwise(n))


def _chain(pairs, test) -> Column:
    first, *rest = [(test(k), F.lit(float(v))) for k, v in pairs]
    return reduce(lambda c, x: c.when(*x), rest, F.when(*first)).otherwise(F.lit(1.0))


def rarity_bonus(rank: Column) -> Column:
    return F.when(rank.isNull(), 2.0).when(rank <= 1000, 1.0).when(rank <= 5000, 1.2).when(rank <= 20000, 1.5).otherwise(1.8)


def rarity_score(rank: Column) -> Column:
    return F.when(rank.isNull(), 2.0).when(rank <= 1000, 1.0).when(rank <= 5000, 1.2).when(rank <= 10000, 1.3).when(rank <= 20000, 1.4).otherwise(1.5)


def syllable_score(n: Column) -> Column:
    return F.when(n <= 1, 1.0).when(n == 2, 1.1).when(n == 3, 1.3).otherwise(1.4)


def suffix_score(word: Column) -> Column:
    return _chain(V.SUFFIXES, word.endswith)


def prefix_score(word: Column) -> Column:
    return _chain(V.PREFIXES, word.startswith)


def cluster_score(word: Column) -> Column:
    return F.greatest(F.lit(1.0), *(F.when(word.rlike(p), F.lit(v)).otherwise(1.0) for p, v in V.CLUSTERS))


def complexity(word: Column, rank: Column) -> Column:
    """Product in this order, so that doubles agree between engines."""
    product = rarity_score(rank) * syllable_score(syllables_word(word)) * suffix_score(word) * prefix_score(word) * cluster_score(word)
    return F.when(F.length(word) < 2, 0.0).otherwise(product)


def tier(score: Column, level: str = "medium") -> Column:
    return F.when(score >= V.LEVELS[level], F.when(score >= V.FULL_TIER, "full").otherwise("lite"))


#: A word without a vowel, in a lower-case text with one blank between words.
_NO_VOWEL = "(?<![^ ])[^ aeiouy]++(?![^ ])"


def _counts(x: Column) -> dict[str, Column]:
    """Sentences, words, syllables and letters of a text that ``collapse`` has been through, by passes over the text, not word by word.

    A word's syllables are its runs of vowels, as ``syllables_paragraph`` has them: no run goes past a blank, and a word without one counts as one.
    """
    low = F.lower(x)
    runs = F.regexp_count(F.regexp_replace(low, "[.,!?()]+", ""), F.lit("[aeiouy]+"))
    return {
        "sentence_count": F.size(T.collapsed_sentences(x)).cast("long"), "_n": T.collapsed_words(x).cast("double"),
        "_syllables": (runs + F.regexp_count(low, F.lit(_NO_VOWEL))).cast("double"), "_letters": F.length(F.regexp_replace(x, "[ .,!?()]+", "")).cast("double"),
    }


def _ratios(counts) -> dict[str, Column]:
    return {"avg_word_len": counts("_letters") / counts("_n"), "avg_sent_len": counts("_n") / counts("sentence_count"), "syllable_density": counts("_syllables") / counts("_n")}


def _clamped(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def _flesch(of) -> Column:
    return T.round2(_clamped(F.lit(206.835) - F.lit(1.015) * of("avg_sent_len") - F.lit(84.6) * of("syllable_density")))


def _score(of) -> Column:
    over = lambda c, least: F.greatest(F.lit(0.0), of(c) - F.lit(least))
    return T.round2(_clamped(of("flesch") - F.lit(4.0) * over("avg_word_len", 6.0) - F.lit(1.5) * over("avg_sent_len", 20.0) - F.lit(8.0) * over("syllable_density", 2.0)))


def _action(score: Column) -> Column:
    return F.when(score < 40, "llm").when(score < 60, "split").otherwise("none")


def action(text: Column) -> Column:
    """The action of one text that has a word: ``paragraph_scores``, inside a row."""
    named = lambda values: F.struct(*(v.alias(k) for k, v in values.items()))
    whole = lambda r: _score(lambda k: _flesch(r.getField) if k == "flesch" else r[k])
    return A.let(T.collapse(text), lambda x: A.let(named(_counts(x)), lambda n: A.let(named(_ratios(n.getField)), lambda r: A.let(whole(r), _action))))


def paragraph_scores(paragraphs, text_col: str = "text"):
    """Adds sentence_count, avg_word_len, avg_sent_len, syllable_density, flesch, score and action; null metrics for blank text."""
    df = paragraphs.withColumn("_x", T.collapse(F.col(text_col)))
    df = df.withColumns(_counts(F.col("_x"))).drop("_x").filter("_n > 0").withColumns(_ratios(F.col))
    df = df.withColumn("flesch", _flesch(F.col)).withColumn("score", _score(F.col)).drop("_n", "_syllables", "_letters")
    return df.withColumn("action", _action(F.col("score")))
