"""Science term patterns: name, pattern (ASCII \\b), least length; in the order in which terms are found."""

from lexiflow.functions import values as V


def _longest_first(parts) -> str:
    return "|".join(sorted(parts, key=len, reverse=True))


# The patterns, their least lengths and their order.
PATTERNS = (
    ("gene", r"\b(?:[A-Z]{2,5}\d*(?:-[A-Za-zα-ωΑ-Ω0-9]+)*|[a-z]{1,3}[A-Z]{2,4}\d*|[A-Z][a-z]{1,2}\d{1,2})\b", 2),
    ("locus", r"\b(?:\d{1,2}|[XY])[pq]\d+(?:\.\d+)?\b", 3),
    ("suffix", rf"(?i)\b[a-zA-Z]{{3,}}(?:{_longest_first(V.SCIENCE_SUFFIXES)})\b", 6),
    ("binomial", r"\b[A-Z][a-z]+\s+(?:[a-z]{3,})\b", 6),
    ("abbreviated", r"\b[A-Z]\.\s*[a-z]{3,}\b", 4),
    ("drug", rf"(?i)\b[a-zA-Z]{{4,}}(?:{_longest_first(V.DRUG_STEMS)})\b", 6),
    ("formula", r"\b(?:[A-Z][a-z]?\d*){2,}\b", 4),
)
