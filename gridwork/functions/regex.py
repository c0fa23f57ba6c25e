"""``re`` on Spark columns.

Python's ``\\w`` and ``\\d`` are Unicode-aware; Java's are ASCII unless
``(?U)`` is set, and ``(?U)\\w`` then also takes combining marks, which
Python's does not. The classes below spell Python's sets out so that Java and
RE2 (the DuckDB oracle) agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwork.functions.text import WS

# Python's \w and \d as explicit classes, and the patterns the
# review-cleaning lesson uses (dd/dd/dddd dates, [^\w\s] punctuation).
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
DATE_DMY = r"\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4}"
PUNCT = r"[^\p{L}\p{N}_" + WS[1:-1] + "]"
# Our choice for the e-mail and phone text the lesson's samples contain.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\p{Nd}{1,3}[ -]?\p{Nd}{3}[ -]?\p{Nd}{3}[ -]?\p{Nd}{4}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def findall(s, pattern: str, group: int = 0) -> Column:
    """``re.findall``: every non-overlapping match, left to right (an empty
    array when none)."""
    return F.regexp_extract_all(_c(s), F.lit(pattern), group)


def count_matches(s, pattern: str) -> Column:
    """``len(re.findall(pattern, s))`` without building the list of matches
    (``regexp_count``), for patterns that cannot match the empty string."""
    return F.regexp_count(_c(s), F.lit(pattern))


def count_with_empty(s, unit: str) -> Column:
    """``len(re.findall(f"(?:{unit})?", s))``, and with ``unit`` ending in
    ``+`` that of ``*``: the non-empty matches, and an empty one at every
    character that none of them holds and at the end. ``unit`` itself cannot
    match the empty string."""
    s = _c(s)
    return count_matches(s, unit) + F.length(F.regexp_replace(s, unit, "")) + 1


def count_chars(s, char_class: str) -> Column:
    """``len(re.findall(char_class, s))`` for a one-character class such as
    ``[aeiou]`` or ``[^\\p{Nd}]``: the text minus every run of the other
    characters, measured. One replacement per run instead of one match per
    character."""
    if not (char_class.startswith("[") and char_class.endswith("]")):
        raise ValueError("char_class must be a bracket expression")
    inner = char_class[1:-1]
    other = "[" + inner[1:] + "]" if inner.startswith("^") else "[^" + inner + "]"
    return F.length(F.regexp_replace(_c(s), other + "+", ""))


def search(s, pattern: str) -> Column:
    """``re.search(...) is not None``."""
    return _c(s).rlike(pattern)


def sub(s, pattern: str, repl: str) -> Column:
    """``re.sub`` (Java replacement syntax: ``$1`` for groups)."""
    return F.regexp_replace(_c(s), pattern, repl)


def strip_punct(s) -> Column:
    """``re.sub(r"[^\\w\\s]", "", s)``: drops punctuation and emoji, keeps
    accented letters."""
    return F.regexp_replace(_c(s), PUNCT, "")


def digits_joined(s) -> Column:
    """``"".join(re.findall(r"\\d", s))``."""
    return F.array_join(findall(s, DIGIT), "")
