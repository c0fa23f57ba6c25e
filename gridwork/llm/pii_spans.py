"""Personal data: regular expressions propose spans, checksums confirm them,
words nearby adjust the score. DataFrame functions only.

Positions are code points. A text is split at a pattern's matches; lengths of
the parts, added up in blocks, give the positions in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128           # matches whose positions are added up at a time
NEAR = 40             # characters on either side in which context words count
REPORTED = 0.5        # least score of a span


@dataclass(frozen=True)
class Kind:
    """What a text must hold to be searched, the pattern, the score of a
    confirmed match, the words nearby that raise it, and the least length of a
    match."""
    name: str
    needs: str
    pattern: str
    score: float
    context: str
    least: int


# Runs are taken whole (possessive), and a match begins at the start of a run
# or where the last match ended, so a text is searched in linear time; the
# leftmost matches are the same as without.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, r"mail|contact|write|reach", 5),
    Kind("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|host|server|address|login", 7),
    Kind("card", "", r"[0-9](?:[\x20-]?+[0-9])++", 0.7, r"card|visa|credit|payment|expires", 2),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"call|phone|tel\b|mobile|fax", 4),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.7, r"iban|bank|account|transfer", 15),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, r"\bssn\b|social|security", 11),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "struct<start:int,kind:int,end:int,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (no spaces) leaves 1 modulo 97, its first four
    characters moved to the end and letters counted from 10."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        def small(x: Column) -> Column:
            rest = F.ltrim(x, F.lit("0"))
            return F.when(F.length(rest) <= 3, F.concat(F.lit("0"), rest).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when((F.length(code) >= 15) & (F.length(code) <= 34), mod97(code)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def score(kind: Kind, m: Column, g: Column, i: Column) -> Column:
    """Score of match ``i`` by the ``NEAR`` characters of the text on either
    side of it, put together from neighbouring parts and matches: so many as
    hold that many characters even if nothing stands between matches."""
    n = range(-(-NEAR // kind.least))
    before = F.concat_ws("", *[x for j in reversed(n) for x in (F.get(m, i - j - 1), F.right(F.get(g, i - j), F.lit(NEAR)))])
    after = F.concat_ws("", *[x for j in n for x in (F.left(F.get(g, i + j + 1), F.lit(NEAR)), F.get(m, i + j + 1))])
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR)))).rlike(kind.context)
    return F.lit(kind.score) + F.when(near, F.lit(0.2)).otherwise(F.lit(0.0))


def _matches(text: Column, kind: Kind) -> Column:
    """Struct of the text's parts between matches, and the matches."""
    has = (F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)) & (F.lit(kind.name == "email") | text.rlike("[0-9]"))
    return F.when(has, F.struct(F.split(text, kind.pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("m")))


def _spans(found: str, kind: Kind, number: int) -> Column:
    """Confirmed spans of one kind, from a column of :func:`_matches`."""
    m, g = F.col(f"{found}.m"), F.col(f"{found}.g")
    n = F.size(m)
    items = F.arrays_zip(F.slice(g, F.lit(1), n).alias("before"), m.alias("match"), F.sequence(F.lit(0), n - 1).alias("i"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(s: Column, x: Column) -> Column:
        start = s["pos"] + F.length(x["before"])
        end = start + F.length(x["match"])
        points = score(kind, m, g, x["i"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), points.alias("score"))
        keep = confirmed(kind.name, x["match"])
        if kind.name not in BASE:
            keep = keep & (points >= REPORTED)
        return F.struct(end.alias("pos"), F.when(keep, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def block(done: Column, b: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["pos"], F.lit(0))
        inner = F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), F.struct(at.alias("pos"), none.alias("out")), step)
        return F.concat(done, F.array(inner))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), F.expr(f"cast(array() as array<struct<pos:int,out:array<{SPAN}>>>)"), block)
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda x: x["out"]))).otherwise(none)


def find(docs: DataFrame, text_col: str = "text", out: str = "__pii") -> DataFrame:
    """All columns of ``docs`` and ``out``: array of spans (start, kind number
    in KINDS, end exclusive, score), by start, then kind. Null or empty text:
    no spans."""
    plain = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    first = docs.select("*", *[_matches(plain, k).alias(f"{out}_{k.name}") for k in KINDS])
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    spans = F.array_sort(F.concat(*[F.coalesce(_spans(f"{out}_{k.name}", k, i), none) for i, k in enumerate(KINDS)]))
    return first.select(*[f"`{c}`" for c in docs.columns], spans.alias(out))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256
    (of the base kinds' list), spans (list of all), scores (in the same
    order). Repeated rows and null ids are kept. Empty table: empty result."""
    rows = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("__pii", lambda s: s["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("__pii", lambda s: s["kind"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
                       F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("__pii")).alias("spans"), F.col("__pii.score").alias("scores"))


def _replaced(text: Column, m: Column, g: Column, kind: Kind) -> Column:
    n = F.size(m)
    items = F.arrays_zip(F.slice(g, F.lit(1), n).alias("before"), m.alias("match"), F.sequence(F.lit(0), n - 1).alias("i"))

    def part(x: Column) -> Column:
        keep = confirmed(kind.name, x["match"])
        if kind.name not in BASE:
            keep = keep & (score(kind, m, g, x["i"]) >= REPORTED)
        return F.concat(x["before"], F.when(keep, F.lit(f"<{kind.name.upper()}>")).otherwise(x["match"]))
    return F.when(n > 0, F.concat(F.array_join(F.transform(items, part), ""), F.get(g, n))).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """Every confirmed match replaced by its kind in angle brackets, one kind
    after the other, longer ones first; all rows and columns stay. Context is
    read from the text as redacted so far. ``chars_col`` gets the new length.
    Null text stays null."""
    out, text = docs, F.col(f"`{text_col}`")
    for k in sorted(KINDS, key=lambda k: ("iban", "email", "phone", "card", "ip", "ssn").index(k.name)):
        out = out.withColumn("__found", _matches(text, k))
        out = out.withColumn(text_col, _replaced(text, F.col("__found.m"), F.col("__found.g"), k)).drop("__found")
    return out.withColumn(chars_col, F.length(text).cast(dict(docs.dtypes)[chars_col])) if chars_col else out
