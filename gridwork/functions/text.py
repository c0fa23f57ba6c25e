"""Python ``str`` methods on Spark string columns.

Python's whitespace (``str.isspace``, ``split()``, ``strip()``) is the Unicode
White_Space set plus the separators 0x1c-0x1f; Spark ``trim`` removes spaces
only. ``WS`` below spells the Python set as a regex class that Java and RE2
read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace characters as one regex character class
# (\t \n \v \f \r, the 0x1c-0x1f separators, NEL 0x85 and category Z).
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
# The separators of str.splitlines.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(s, chars: str | None = None, side: str = "both") -> Column:
    """``strip``/``lstrip``/``rstrip``; without ``chars`` Python whitespace."""
    s = _c(s)
    if chars is None:
        cls = WS
    else:
        cls = "[" + "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars) + "]"
    # \A and \z: the very start and end (Java's ``$`` also matches before a
    # final newline, which would strip characters Python keeps).
    pat = {"both": f"\\A{cls}+|{cls}+\\z", "left": f"\\A{cls}+", "right": f"{cls}+\\z"}[side]
    return F.regexp_replace(s, pat, "")


def split_ws(s) -> Column:
    """``s.split()``: split on runs of whitespace, no empty items."""
    return F.filter(F.split(_c(s), f"{WS}+"), lambda x: x != F.lit(""))


def split_lines(s) -> Column:
    """``s.splitlines()``: CR LF is one separator, and only the last item
    falls away if it is empty."""
    parts = F.split(_c(s), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == F.lit(""),
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(s) -> Column:
    """``len(s.splitlines())`` from the number of line breaks (plus one for a
    last line without a break), with no array."""
    s = _c(s)
    breaks = F.regexp_count(s, F.lit(LINE_BREAK))
    open_last = (F.length(s) > 0) & ~s.rlike(f"{LINE_BREAK[5:]}\\z")
    return breaks + F.when(open_last, 1).otherwise(0)


def count_literal(s, literal: str) -> Column:
    """``s.count(literal)``: by what the text loses without it."""
    s = _c(s)
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(literal), F.lit("")))) / len(literal))


def word_count(s) -> Column:
    """``len(s.split())``: the number of maximal runs of non-whitespace,
    counted without building the list of words."""
    return F.regexp_count(_c(s), F.lit(f"[^{WS[1:-1]}]+"))


def is_upper(s) -> Column:
    """``isupper``: at least one cased character and none lower case."""
    s = _c(s)
    return (s == F.upper(s)) & (s != F.lower(s))


def is_lower(s) -> Column:
    s = _c(s)
    return (s == F.lower(s)) & (s != F.upper(s))


def is_alpha(s) -> Column:
    """``isalpha`` (letters, non-empty)."""
    return _c(s).rlike(r"\A\p{L}+\z")


def is_alnum(s) -> Column:
    return _c(s).rlike(r"\A[\p{L}\p{N}]+\z")


def is_numeric(s) -> Column:
    return _c(s).rlike(r"\A\p{N}+\z")


def is_digit(s) -> Column:
    return _c(s).rlike(r"\A\p{Nd}+\z")


def is_space(s) -> Column:
    return _c(s).rlike(f"\\A{WS}+\\z")


def py_find(s, sub: str) -> Column:
    """``s.find(sub)``: 0-based position, -1 when absent."""
    return F.locate(sub, _c(s)) - 1


def py_index(s, sub: str) -> Column:
    """``s.index(sub)``; NULL where Python would raise."""
    p = py_find(s, sub)
    return F.when(p >= 0, p)


def zfill(s, width: int) -> Column:
    """``s.zfill(width)``: pad with zeros after a leading sign; strings at
    least ``width`` long are unchanged (``lpad`` would cut them)."""
    s = _c(s)
    n = F.length(s)
    signed = s.rlike(r"^[+-]")
    return (F.when(n >= width, s)
             .when(signed, F.concat(F.substring(s, 1, 1), F.lpad(F.substring(s, 2, 1 << 30), width - 1, "0")))
             .otherwise(F.lpad(s, width, "0")))


def center(s, width: int, fill: str = " ") -> Column:
    """``s.center(width, fill)`` with CPython's split of the padding: the left
    side gets ``marg // 2`` plus one when both ``marg`` and ``width`` are odd."""
    s = _c(s)
    n = F.length(s)
    marg = F.lit(width) - n
    left = F.floor(marg / 2).cast("int") + F.when((marg % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    right = marg - left
    padded = F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), right))
    return F.when(n >= width, s).otherwise(padded)


def prefixes(s, include_full: bool = False) -> Column:
    """Array of the leading substrings ``s[:1], s[:2], ...``; the full string
    only if ``include_full``."""
    s = _c(s)
    n = F.length(s) if include_full else F.length(s) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, 1, i))) \
            .otherwise(F.array().cast("array<string>"))


def chars(s) -> Column:
    """``list(s)``: one array item per code point (emoji stay whole); the
    empty string gives an empty array (``split`` alone would give ``['']``)."""
    s = _c(s)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def py_slice(s, start: int | None = None, stop: int | None = None) -> Column:
    """``s[start:stop]`` with negative bounds and clipping."""
    s = _c(s)
    n = F.length(s)

    def norm(b, default):
        if b is None:
            return default
        return F.greatest(n + F.lit(b), F.lit(0)) if b < 0 else F.least(F.lit(b), n)

    a = norm(start, F.lit(0))
    e = norm(stop, n)
    return F.when(e > a, F.substring(s, a + 1, e - a)).otherwise(F.lit(""))
