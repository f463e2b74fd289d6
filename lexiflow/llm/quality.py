"""Quality rules (operator 6), line first, DataFrame functions only.

Each line with a word is judged alone: symbols, shouting, navigation separators, boilerplate phrases, long
runs without any punctuation, lines without a letter.  Failing lines are removed; a document that would
lose more than ``max_lost`` of its words is rejected, as is one that fails the base rules (too few words,
too many words in repeated 3-word windows).  Everything happens inside the row: no shuffle, and no key,
source or text length makes one task heavier than its own rows.

Repeated windows are found by sorting longs: the high bits hold the window's hash, the low bits, as many
as the text needs, its position.  Equal neighbours mark positions; marked windows are sorted once more by a
second hash, so a window counts only where both hashes have a twin (over 100 bits together for a million words).
The words under the windows that are left are counted as the union of their spans.

Defined results: a null or empty text has no words and no lines and fails the base; repeated rows are
judged alike; texts of any length are read whole; an empty table gives no rows; extra columns stay, but for one
named ``_q``, which gives way to the measures in ``measure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.arrays import let
from lexiflow.llm.common import WORD, free

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST = 50, 50, 0.5
#: Largest share of a line's characters that are symbols or exclamation marks; words that need a mark among them.
MAX_SYMBOLS, MAX_SHOUTS, UNMARKED_CHARS = 0.08, 0.08, 250
#: Phrases of page furniture in the corpus's languages, lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie policy",
    "accept cookies", "use of cookies", "enable javascript", "javascript is disabled", "click here", "read more", "sign in",
    "log in", "subscribe to our newsletter", "share on facebook", "share on twitter", "powered by", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren",
    "hier klicken", "mehr lesen", "weiterlesen", "jetzt anmelden", "tous droits réservés", "politique de confidentialité",
    "conditions d'utilisation", "accepter les cookies", "cliquez ici", "lire la suite", "se connecter",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "términos de uso", "aceptar cookies",
    "haga clic aquí", "leer más", "iniciar sesión",
)
#: Phrases that ordinary sentences hold too: they count where they make up half of a line or more.
COMMON = (
    "click here", "read more", "sign in", "log in", "powered by", "hier klicken", "mehr lesen", "weiterlesen", "jetzt anmelden",
    "cliquez ici", "lire la suite", "se connecter", "haga clic aquí", "leer más", "iniciar sesión",
)
_PHRASE = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"
#: Marks of any script: punctuation that is no quote, bullet, sign or reference mark.
_USUAL, _NO_MARKS = "[.!?,;:…。！？‼‽⁇⁈⁉]", "〃〽・･＂＃％＆＇＊／＠＼"
_MARKS = _USUAL + r"|[\p{Po}&&[^\x00-\xFF\u2000-\u206F" + _NO_MARKS + "]]"
_SYMBOLS = "[#*$%&|<>{}^~=\\\\]"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def _marked(sorted_: Column, bits: Column) -> Column:
    """Positions of packed windows whose hash a neighbour shares, rising."""
    high = lambda x: F.call_function("shiftright", x, bits)
    last = F.size(sorted_) - 1
    twin = lambda x, i: ((i > 0) & (high(F.get(sorted_, i - 1)) == high(x))) | ((i < last) & (high(F.get(sorted_, i + 1)) == high(x)))
    low = lambda x: x - F.call_function("shiftleft", high(x), bits)
    return F.array_sort(F.transform(F.filter(sorted_, twin), low))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    n = F.size(words)
    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

    def twins(positions: Column, bits: Column, *seed: Column) -> Column:
        """Those of ``positions`` whose window's hash another one has."""
        top = lambda h: F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
        window = lambda i: F.xxhash64(*seed, *(F.get(words, (i + k).cast("int")) for k in range(3)))
        packed = F.transform(positions, lambda i: top(window(i)) + i.cast("long"))
        return let(F.sort_array(packed), lambda s: _marked(s, bits))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(p - a["at"], F.lit(3))).alias("n"))
        return F.aggregate(positions, start, step)["n"]

    every = F.sequence(F.lit(0), n - 3)
    found = let(bits, lambda b: let(twins(every, b), lambda once: covered(twins(once, b, F.lit(11)))))
    return F.when(n > 3, found).otherwise(0).cast("long")


def line_fails(line: Column) -> Column:
    size = F.length(line)
    share = lambda pattern: (size - F.length(F.regexp_replace(line, pattern, ""))) / size
    # Plain lines have none of these characters: one look saves three counts.
    odd = line.rlike(r"[#*$%&|<>{}^~=\\!»›•·]")
    navigation = F.regexp_count(line, F.lit(r"\s[|»›•·]\s")) >= 3
    shouting = (size >= 12) & line.rlike(r"\p{Lu}{2}") & (share(r"\p{Lu}+") > 0.6)
    low, common = F.lower(line), _PHRASE % "|".join(COMMON)
    rest = F.length(F.trim(F.regexp_replace(low, common, "")))
    sure = low.rlike(_PHRASE % "|".join(x for x in BOILERPLATE if x not in COMMON))
    boilerplate = (size <= 300) & low.rlike(_PHRASE % "|".join(BOILERPLATE)) & (sure | (2 * rest <= F.length(F.trim(low))))
    unmarked = (size >= UNMARKED_CHARS) & ~line.rlike(_MARKS)
    return (odd & ((share(_SYMBOLS + "+") > MAX_SYMBOLS) | (share("!+") > MAX_SHOUTS) | navigation)) | shouting | boilerplate | unmarked | ~line.rlike(r"\p{L}")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def _counted(w: Column) -> Column:
    chars = F.length(F.array_join(w, "")).cast("long")
    return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), repeat_words(w).alias("n_repeat_words"))


def _failed(counts: Column) -> Column:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def _measured(docs: DataFrame, text_col: str, max_lost: float, name: str) -> DataFrame:
    """``docs`` with the measures in column ``name``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bad = F.filter(lines_with_words(F.col(text_col)), line_fails)
    lost = F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + word_count(x))
    twice = let(lines_with_words(F.col(text_col)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")

    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
    # Columns of their own, so that the optimizer computes each once however often it is used below.
    c, s, d, own = free(docs, "_counts", "_symbols", "_twice", "_lost")
    out = docs.withColumns({c: let(word_array(F.col(text_col)), _counted), s: symbols, d: twice, own: lost})
    n, r = F.col(c)["n_words"], F.col(c)["n_repeat_words"]
    failed = _failed(F.col(c))
    kept = ~failed & (F.col(own) <= max_lost * n)
    measures = [
        n.alias("n_words"), F.col(c)["word_chars"].alias("word_chars"), F.col(s).alias("n_symbols"), F.col(d).alias("n_dup_lines"),
        r.alias("n_repeat_words"), F.col(own).alias("lost_words"), failed.alias("base_failed"), kept.alias("kept"),
    ]
    return out.select(*docs.columns, F.struct(*measures).alias(name))


def measure(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with _q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, base_failed, kept."""
    return _measured(docs.drop("_q"), text_col, max_lost, "_q")


def clean_text(text: Column) -> Column:
    """The text without failing lines; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~(x.rlike(WORD) & line_fails(x))), "\n")


def clean_documents(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that are kept, without their failing lines; lines without a word stay.

    Every line is judged once: the verdict and the text that is left are made together, by a generator, below which the optimizer
    moves no filter.
    """
    c, kept, left = free(docs, "_counts", "_kept", "_left")
    text = F.col(text_col)

    def verdict(lines: Column, fails: Column) -> Column:
        lost = F.aggregate(F.filter(lines, lambda x, i: F.get(fails, i)), F.lit(0).cast("long"), lambda a, x: a + word_count(x))
        rest = F.array_join(F.filter(lines, lambda x, i: ~F.get(fails, i)), "\n")
        own = F.when(F.exists(fails, lambda f: f), rest).otherwise(text)
        return F.struct((lost <= max_lost * F.col(c)["n_words"]).alias(kept), own.alias(left))

    judged = lambda lines: let(F.transform(lines, lambda x: x.rlike(WORD) & line_fails(x)), lambda f: verdict(lines, f))
    rejected = F.struct(F.lit(False).alias(kept), F.lit(None).cast("string").alias(left))
    one = F.when(_failed(F.col(c)), rejected).otherwise(let(F.split(text, "\n", -1), judged))
    out = docs.withColumn(c, let(word_array(text), _counted)).select(*docs.columns, F.inline(F.array(one)))
    return out.filter(F.col(kept)).select(*(F.col(left).alias(x) if x == text_col else F.col(x) for x in docs.columns))
