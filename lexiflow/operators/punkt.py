"""Sentence ends learnt from the corpus: abbreviations by log-likelihood ratios, after Kiss and Strunk's unsupervised method.

A word that is nearly always followed by a full stop, is short, and holds full stops inside is an abbreviation.  The evidence is a
ratio of likelihoods: of the stops seen behind the word if it is an abbreviation (a stop 99 times in 100) and if stops fall as they do
behind any word.  Two aggregations over the tokens of a language give it; a fixed list is only a prior, which adds to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.functions import values as V

#: Score from which a word is an abbreviation, and the chance of a stop behind one.
LEAST, STOPPED = 0.3, 0.99
#: What words of the fixed list score more: they need little evidence.
PRIOR = 5.0
#: A learnt list up to so long is broadcast.
MOST_BROADCAST = 100_000


def typed(texts: DataFrame) -> DataFrame:
    """(lang, word, stopped, n): words with a letter in lower case, without marks around; whether one full stop ends them; how often.

    Tokens are counted as they stand and looked at once each; a word may have several rows.
    """
    raw = F.explode(F.split("text", f"{T.JAVA_SPACE}+", -1))
    rows = texts.select("lang", raw.alias("raw")).groupBy("lang", "raw").agg(F.count("*").alias("n"))
    rows = rows.select("lang", "n", F.regexp_replace("raw", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "").alias("raw"))
    stopped = F.col("raw").rlike(r"[^.]\.$")
    word = F.lower(F.regexp_replace("raw", r"\.+$", ""))
    return rows.select("lang", word.alias("word"), stopped.alias("stopped"), "n").filter(F.col("word").rlike(r"\p{L}"))


def known(word: Column) -> Column:
    return word.rlike(f"^(?:{'|'.join(x.lower() for x in V.ABBREVIATIONS)})$")


def _likely(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n, each with chance p."""
    return k * F.log(p) + (n - k) * F.log(F.lit(1.0) - p)


def abbreviations(texts: DataFrame) -> DataFrame:
    """(lang, word, n, n_stopped, score, is_abbreviation) of every word that a full stop ends anywhere, by language.

    The first aggregation counts words, the second stops and words of a language.  Ratios are weighed as by the method: long words count
    less (e to the minus letters), stops inside more (by their number and one), each use without a stop less (letters to the minus
    uses).
    """
    words = typed(texts).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stopped"), F.col("n")).otherwise(0)).alias("n_stopped"))
    whole = words.groupBy("lang").agg(F.sum("n").alias("_all"), F.sum("n_stopped").alias("_stops"))
    rows = words.filter("n_stopped > 0").join(F.broadcast(whole), "lang")  # a row a language
    n, k = F.col("n").cast("double"), F.col("n_stopped").cast("double")
    # One stop and one word more, so that no chance is 0 or 1.
    chance = (F.col("_stops") + F.lit(1.0)) / (F.col("_all") + F.lit(2.0))
    ratio = F.lit(2.0) * (_likely(k, n, F.lit(STOPPED)) - _likely(k, n, chance))
    letters = F.length(F.regexp_replace("word", r"\.", "")).cast("double")
    inside = F.length(F.regexp_replace("word", r"[^.]", "")).cast("double")
    weight = F.exp(-letters) * (inside + F.lit(1.0)) * F.pow(letters, k - n)
    score = F.round(ratio * weight + F.when(known(F.col("word")), PRIOR).otherwise(0.0), 6)
    out = rows.select("lang", "word", "n", "n_stopped", score.alias("score")).withColumn("score", F.when(F.col("score") == 0, 0.0).otherwise(F.col("score")))  # no -0
    return out.withColumn("is_abbreviation", F.col("score") >= LEAST)


def sentences(paras: DataFrame, learnt: DataFrame) -> DataFrame:
    """(lang, doc_id, para_idx, n_sentences, n_joined) of ``paras`` (lang, doc_id, para_idx, text): sentences that end at a stop which no
    abbreviation explains, and the ends that abbreviations took away.

    An end is a token with a stop, question or exclamation mark last, before a token that begins with no small letter.
    """
    # A token's own characters are taken at once and its last one looked back at, so a text is gone through once.
    space, other = T.JAVA_SPACE, T.JAVA_NO_SPACE
    end = rf"(?<!{other}){other}++(?<=[.!?])(?={space}++(?![a-z]){other})"
    found = F.regexp_extract_all(T.trimmed(F.col("text")), F.lit(end), F.lit(0))
    tokens = paras.filter(F.length("text") > 0).select("lang", "doc_id", "para_idx", F.explode(found).alias("raw"))
    bare = F.regexp_replace("raw", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")
    word = F.when(F.col("raw").rlike(r"[^.]\.$"), F.lower(F.regexp_replace(bare, r"\.+$", "")))
    found = tokens.select("lang", "doc_id", "para_idx", word.alias("word"))
    listed = learnt.filter("is_abbreviation").select("lang", "word", F.lit(True).alias("_is"))
    few = listed.take(MOST_BROADCAST + 1)
    if len(few) <= MOST_BROADCAST:  # what was looked at is not worked out again
        listed = F.broadcast(paras.sparkSession.createDataFrame(few, listed.schema))
    found = found.join(listed, ["lang", "word"], "left")
    counted = found.groupBy("lang", "doc_id", "para_idx").agg(F.count_if(F.col("_is").isNull()).alias("_ends"), F.count_if("_is").alias("n_joined"))
    out = paras.filter(F.length("text") > 0).select("lang", "doc_id", "para_idx").join(counted, ["lang", "doc_id", "para_idx"], "left")
    return out.select("lang", "doc_id", "para_idx", (F.coalesce("_ends", F.lit(0)) + 1).alias("n_sentences"), F.coalesce("n_joined", F.lit(0)).alias("n_joined"))
