"""Column functions over text.  Patterns are ASCII, as the semantics they stand for: Java's \\b is not."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions import values as V

#: An ASCII word boundary.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: For the same patterns in an engine whose \b is ASCII.
WORD = r"\b[A-Za-z][A-Za-z'-]*\b"
DOTTED = r"^([a-zA-Z]\.)+[a-zA-Z]?$"
#: White space as ECMAScript has it, for classes; neither Java's \s nor Python's nor SQL's is this set.
BLANKS = " \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE, NO_SPACE = f"[{BLANKS}]", f"[^{BLANKS}]"
#: The same sets for Spark's expressions.  Java asks each member of a class in turn, so letters are told apart by one wide range first.
_NEAR = r"\t-\r \xa0\u1680-\ufeff"
_OTHER = _NEAR.replace(" ", "")
JAVA_SPACE, JAVA_NO_SPACE = f"[{_NEAR}&&{SPACE}]", f"[^{_NEAR}&&{SPACE}]"


def spelled(pattern: str, space: str = SPACE, no_space: str = NO_SPACE) -> str:
    """``pattern`` with its white space spelled out, inside classes and outside."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.S):
        inside = part == "[" or (inside and part != "]")
        out.append({r"\s": BLANKS if inside else space, r"\S": no_space}.get(part, part))
    return "".join(out)


def spark_pattern(pattern: str) -> str:
    return spelled(pattern, JAVA_SPACE, JAVA_NO_SPACE).replace(r"\b", EDGE)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{JAVA_SPACE}+|{JAVA_SPACE}+\z", "")


def tokens(c: Column) -> Column:
    return F.split(trimmed(c), f"{JAVA_SPACE}+", -1)


def collapse(c: Column) -> Column:
    """White space as single blanks, none at the ends.  A blank alone, as most are, is left as it stands."""
    return F.trim(F.regexp_replace(c, f"(?:[{_OTHER}&&{SPACE}]| (?={JAVA_SPACE})){JAVA_SPACE}*", " "))


def collapsed_words(x: Column) -> Column:
    """Words of a text that ``collapse`` has been through, counted."""
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)


#: A boundary before and behind a character that is a letter, digit or underscore.
_OPENS, _SHUTS = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def found_words(c: Column, pattern: str) -> Column:
    """``find_all`` of a pattern between ``\\b`` whose matches begin and end with ASCII letters, digits or underscores."""
    case = "(?i)" if pattern.startswith("(?i)") else ""
    inner = pattern.removeprefix(case).removeprefix(r"\b").removesuffix(r"\b")
    return F.regexp_extract_all(c, F.lit(case + _OPENS + spark_pattern(inner) + _SHUTS), F.lit(0))


def _either(word: str) -> str:
    return "".join(f"[{x}{x.upper()}]" for x in word)


def found_endings(c: Column, ends: tuple[str, ...], least: int) -> Column:
    """``find_all`` of whole words of ASCII letters in either case, ``least`` of them or more before one of ``ends`` (two letters at least).

    A word is read once, its last two letters are looked at, and then, for few, the endings.
    """
    before: dict[str, set[str]] = {}
    for end in ends:
        before.setdefault(end[-1], set()).add(end[-2])
    last = "|".join(f"[{''.join(x + x.upper() for x in sorted(own))}]{_either(end)}" for end, own in sorted(before.items()))
    whole = rf"(?<=[a-zA-Z]{{{least}}}(?:{'|'.join(map(_either, sorted(ends, key=len, reverse=True)))}))"
    pattern = rf"{_OPENS}[a-zA-Z]{{{least + min(map(len, ends))},}}+{_SHUTS}(?<={last}){whole}"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def found_from_letters(c: Column, pattern: str) -> Column:
    """``find_all`` of a pattern that begins with ``\\b`` and an ASCII letter, digit or underscore: nothing like it may stand before."""
    return F.regexp_extract_all(c, F.lit(_OPENS + spark_pattern(pattern.removeprefix(r"\b"))), F.lit(0))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(spark_pattern(pattern)), F.lit(0))


def letters_hyphens(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z'-]", ""))


def cleaned_tokens(c: Column) -> Column:
    """``letters_hyphens`` of each token between white space, in order, by two passes over the text in place of one over each token."""
    blanks = F.regexp_replace(c, f"{JAVA_SPACE}+", " ")
    return F.split(F.lower(F.regexp_replace(blanks, "[^a-zA-Z' -]+", "")), " ", -1)


def letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z]", ""))


def trim_edges(c: Column, keep: str) -> Column:
    return F.regexp_replace(c, f"^[^{keep}]+|[^{keep}]+$", "")


def is_dotted(c: Column) -> Column:
    return F.trim(c).rlike(DOTTED)


def dotted_form(c: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(c), r"\.$", ""), F.lit("."))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def word_pieces(c: Column) -> Column:
    """Words and the white space between them; joined they are the text."""
    return F.regexp_extract_all(c, F.lit(spark_pattern(r"\S+|\s+")), F.lit(0))


_MASK, _BREAK = "\u0001", "\u0002"
#: Abbreviations begin with so many letters at most and then have a point; most words do not, and the list is not gone through for them.
_ABBREVIATED = f"(?=[a-zA-Z]{{1,{max(len(re.match('[a-zA-Z]+', x)[0]) for x in V.ABBREVIATIONS)}}}+[.])"


def sentences(c: Column) -> Column:
    """Array of sentences: no break after an abbreviation or before a lower-case continuation."""
    return collapsed_sentences(collapse(c))


def collapsed_sentences(x: Column) -> Column:
    """``sentences`` of a text that ``collapse`` has been through."""
    x = F.regexp_replace(x, rf"(?i)(^| ){_ABBREVIATED}({'|'.join(V.ABBREVIATIONS)})\.", f"$1$2{_MASK}")
    x = F.regexp_replace(x, "([.!?]) ([^a-z ])", f"$1{_BREAK}$2")
    return F.filter(F.split(F.replace(x, F.lit(_MASK), F.lit(".")), _BREAK, -1), lambda s: s != "")


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def split_sentences(c: Column) -> Column:
    """The sentences that become list items: those with a letter or digit."""
    return F.filter(sentences(c), lambda s: s.rlike("[A-Za-z0-9]"))
