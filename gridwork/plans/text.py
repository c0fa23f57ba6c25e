"""String methods and regular expressions (inventory T, R) over whole texts.

Every query reads every row of ``documents`` / ``conversations`` / ``part`` /
``customer`` and the full text of each row. Results are reported as counts,
positions and MD5 digests of the transformed texts, so that the check compares
whole outputs without shipping megabytes of text.

Case mapping differs between the JVM and DuckDB for a few letters (``ß``
upper-cases to ``SS`` in Java and to ``ẞ`` in DuckDB), so case tests run on
the ASCII name columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.functions import regex as RX
from gridwork.functions import text as TX
from gridwork.plans.registry import register
from gridwork.sources import Tables

# DuckDB spellings of the same character classes as functions.text/regex.
_WS_SQL = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
_WORDS_SQL = f"list_filter(regexp_split_to_array(text, '{_WS_SQL}+'), lambda x: x <> '')"
_PUNCT_SQL = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x85\p{Z}]"


_BREAK_SQL = r"(\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def _lines_sql(text: str) -> str:
    """DuckDB: ``splitlines`` as a list."""
    parts = f"regexp_split_to_array({text}, '{_BREAK_SQL}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END)"


@register("t1_text_profile", f"""
SELECT doc_id, length(text) AS n_chars, len({_WORDS_SQL}) AS n_words, len({_lines_sql('text')}) AS n_lines,
       len(string_split(text, ',')) AS n_comma_items
FROM documents""")
def t1_text_profile(spark, sf):
    """``len(s)``, ``len(s.split())``, ``len(s.splitlines())`` and
    ``len(s.split(','))`` for every document."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    TX.word_count("text").cast("long").alias("n_words"),
                    TX.line_count("text").cast("long").alias("n_lines"),
                    F.size(F.split("text", r"\Q,\E")).cast("long").alias("n_comma_items"))


# Str.splitlines' ten separators of one character, and CR LF.
_SEPARATORS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\n"]
_MIXED_SQL = "replace(text, chr(10), list_value({})[doc_id % 11 + 1])".format(", ".join(" || ".join(f"chr({ord(c)})" for c in s) for s in _SEPARATORS))


@register("t8_split_lines", f"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, l[1] AS first_line, md5(array_to_string(l, '|')) AS lines_md5
FROM (SELECT doc_id, {_lines_sql('t')} AS l FROM (SELECT doc_id, {_MIXED_SQL} AS t FROM documents))""")
def t8_split_lines(spark, sf):
    """``s.splitlines()`` where each document has one of the eleven separators
    in place of its line feeds."""
    d = Tables(spark, sf).documents
    separator = F.element_at(F.array(*map(F.lit, _SEPARATORS)), (F.col("doc_id") % 11 + 1).cast("int"))
    lines = TX.split_lines(F.replace("text", F.lit("\n"), separator))
    return d.select("doc_id", lines.alias("l")).select(
        "doc_id", F.size("l").cast("long").alias("n_lines"), F.get("l", F.lit(0)).alias("first_line"), F.md5(F.array_join("l", "|")).alias("lines_md5"))


@register("t2_case_names", """
SELECT c_custkey, upper(c_mktsegment) AS upper_segment, lower(c_name) AS lower_name,
       upper(c_name) = c_name AND lower(c_name) <> c_name AS name_isupper,
       lower(c_mktsegment) = c_mktsegment AND upper(c_mktsegment) <> c_mktsegment AS segment_islower
FROM customer""")
def t2_case_names(spark, sf):
    """``upper``/``lower`` and ``isupper``/``islower`` (needs a cased letter)."""
    c = Tables(spark, sf).customer
    return c.select("c_custkey", F.upper("c_mktsegment").alias("upper_segment"), F.lower("c_name").alias("lower_name"),
                    TX.is_upper("c_name").alias("name_isupper"), TX.is_lower("c_mktsegment").alias("segment_islower"))


@register("t3_slices", """
SELECT conv_id, turn, text[1:10] AS first10, CASE WHEN length(text) >= 10 THEN text[-10:] ELSE text END AS last10,
       text[3:5] AS mid_2_5, CASE WHEN length(text) > 0 THEN text[-1:] ELSE '' END AS last_char
FROM conversations""")
def t3_slices(spark, sf):
    """``s[:10]``, ``s[-10:]``, ``s[2:5]``, ``s[-1]`` (clipping, no errors)."""
    cv = Tables(spark, sf).conversations
    return cv.select("conv_id", "turn", TX.py_slice("text", None, 10).alias("first10"),
                     TX.py_slice("text", -10, None).alias("last10"), TX.py_slice("text", 2, 5).alias("mid_2_5"),
                     TX.py_slice("text", -1, None).alias("last_char"))


@register("t5_char_classes", f"""
SELECT doc_id,
       len(list_filter({_WORDS_SQL}, lambda w: regexp_full_match(w, '\\p{{L}}+'))) AS alpha_words,
       len(list_filter({_WORDS_SQL}, lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+'))) AS alnum_words,
       len(list_filter({_WORDS_SQL}, lambda w: regexp_full_match(w, '\\p{{N}}+'))) AS numeric_words,
       regexp_full_match(text, '{_WS_SQL}+') AS is_space
FROM documents""")
def t5_char_classes(spark, sf):
    """``isalpha``, ``isalnum``, ``isnumeric`` per word, ``isspace`` per text."""
    d = Tables(spark, sf).documents.select("doc_id", "text", TX.split_ws("text").alias("w"))

    def count(pred):
        return F.size(F.filter("w", pred)).cast("long")

    return d.select("doc_id", count(TX.is_alpha).alias("alpha_words"), count(TX.is_alnum).alias("alnum_words"),
                    count(TX.is_numeric).alias("numeric_words"), TX.is_space("text").alias("is_space"))


@register("t4_word_case_counts", f"""
SELECT p_partkey,
       len(list_filter(regexp_split_to_array(p_type, '{_WS_SQL}+'), lambda w: upper(w) = w AND lower(w) <> w)) AS upper_words,
       len(list_filter(regexp_split_to_array(p_name, '{_WS_SQL}+'), lambda w: lower(w) = w AND upper(w) <> w)) AS lower_words
FROM part""")
def t4_word_case_counts(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey",
                    F.size(F.filter(TX.split_ws("p_type"), TX.is_upper)).cast("long").alias("upper_words"),
                    F.size(F.filter(TX.split_ws("p_name"), TX.is_lower)).cast("long").alias("lower_words"))


@register("t9_find_index", """
SELECT doc_id, instr(text, 'the') - 1 AS find_the, CASE WHEN instr(text, 'ion ') > 0 THEN instr(text, 'ion ') - 1 END AS index_ion
FROM documents""")
def t9_find_index(spark, sf):
    """``s.find('the')`` (-1 when absent) and ``s.index('ion ')`` (NULL where
    Python raises)."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", TX.py_find("text", "the").cast("long").alias("find_the"),
                    TX.py_index("text", "ion ").cast("long").alias("index_ion"))


@register("t10_strip", f"""
SELECT conv_id, turn, length(regexp_replace(text, '^{_WS_SQL}+|{_WS_SQL}+$', '', 'g')) AS stripped_len,
       length(regexp_replace(text, '^{_WS_SQL}+', '')) AS lstripped_len,
       length(regexp_replace(text, '{_WS_SQL}+$', '')) AS rstripped_len,
       length(regexp_replace(text, '^[.!?]+|[.!?]+$', '', 'g')) AS stripped_punct_len
FROM conversations""")
def t10_strip(spark, sf):
    """``strip()``, ``lstrip()``, ``rstrip()`` with Python whitespace, and
    ``strip('.!?')``."""
    cv = Tables(spark, sf).conversations
    return cv.select("conv_id", "turn", F.length(TX.py_strip("text")).cast("long").alias("stripped_len"),
                     F.length(TX.py_strip("text", side="left")).cast("long").alias("lstripped_len"),
                     F.length(TX.py_strip("text", side="right")).cast("long").alias("rstripped_len"),
                     F.length(TX.py_strip("text", ".!?")).cast("long").alias("stripped_punct_len"))


@register("t11_replace_join", f"""
SELECT doc_id, md5(replace(text, 'the', 'THE')) AS replaced_md5,
       md5(array_to_string({_WORDS_SQL}, '_')) AS joined_md5
FROM documents""")
def t11_replace_join(spark, sf):
    """``s.replace('the', 'THE')`` and ``'_'.join(s.split())``."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.md5(F.replace("text", F.lit("the"), F.lit("THE"))).alias("replaced_md5"),
                    F.md5(F.array_join(TX.split_ws("text"), "_")).alias("joined_md5"))


@register("t12_center_zfill", """
SELECT c_custkey,
       CASE WHEN length(c_mktsegment) >= 16 THEN c_mktsegment ELSE
         repeat('*', CAST(floor((16 - length(c_mktsegment)) / 2) AS INT)) || c_mktsegment
         || repeat('*', 16 - length(c_mktsegment) - CAST(floor((16 - length(c_mktsegment)) / 2) AS INT)) END AS centered,
       CASE WHEN length(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)) >= 10 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)
            WHEN c_acctbal < 0 THEN '-' || lpad(substr(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), 2), 9, '0')
            ELSE lpad(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), 10, '0') END AS zfilled
FROM customer""")
def t12_center_zfill(spark, sf):
    """``s.center(16, '*')`` (even width: the extra fill goes right) and
    ``str(balance).zfill(10)`` (zeros after the sign)."""
    c = Tables(spark, sf).customer
    bal = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    return c.select("c_custkey", TX.center("c_mktsegment", 16, "*").alias("centered"),
                    TX.zfill(bal, 10).alias("zfilled"))


@register("t16_prefixes", """
SELECT p_partkey, CAST(i AS BIGINT) AS n, p_name[1:i] AS prefix
FROM part, LATERAL (SELECT unnest(generate_series(1, length(p_name) - 1)) AS i)""")
def t16_prefixes(spark, sf):
    """Every leading substring of a name except the full name (the prefix
    loop of the lessons), one row each."""
    p = Tables(spark, sf).part
    longest = F.length("p_name") - 1
    at = p.select("p_partkey", "p_name", F.explode(F.when(longest >= 1, F.sequence(F.lit(1), longest))).alias("n"))
    return at.select("p_partkey", F.col("n").cast("long").alias("n"), F.substring(F.col("p_name"), F.lit(1), F.col("n")).alias("prefix"))


@register("t17_char_frequency", """
SELECT lang, ch, count(*) AS n FROM (
  SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY lang, ch""")
def t17_char_frequency(spark, sf):
    """Per-character rows (``for ch in s``), counted per language. The counts
    are partially aggregated before the shuffle, so a language holding most
    of the text does not gather its characters in one task."""
    d = Tables(spark, sf).documents
    return d.select("lang", F.explode(TX.chars("text")).alias("ch")).groupBy("lang", "ch") \
            .agg(F.count(F.lit(1)).alias("n"))


# -- R: regular expressions -------------------------------------------------

@register("r1_findall_counts", """
SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) AS vowels,
       len(regexp_extract_all(text, '\\$')) AS dollars,
       len(regexp_extract_all(text, '[\\p{L}\\p{N}_]')) AS word_chars,
       len(regexp_extract_all(text, 'th.')) AS th_any,
       len(regexp_extract_all(text, 'e+')) AS e_runs,
       len(regexp_extract_all(text, 'es?')) AS e_opt_s,
       len(regexp_extract_all(text, 'e{2}')) AS ee,
       len(regexp_extract_all(text, 'the|and')) AS the_or_and
FROM documents""")
def r1_findall_counts(spark, sf):
    """``len(re.findall(p, s))`` for a character set, an escaped ``$``,
    ``\\w``, ``.``, ``+``, ``?``, ``{2}`` and an alternation. Literals and sets
    are counted by what the text loses without them (``es?`` matches once an
    ``e``; ``the`` and ``and`` cannot overlap), the others by matching."""
    d = Tables(spark, sf).documents

    def n(p):
        return RX.count_matches("text", p).cast("long")

    def lit(*words):
        return sum((TX.count_literal("text", w) for w in words[1:]), TX.count_literal("text", words[0])).cast("long")

    vowels = F.length("text") - F.length(F.translate("text", "aeiou", ""))
    return d.select("doc_id", vowels.cast("long").alias("vowels"), lit("$").alias("dollars"),
                    RX.count_chars("text", RX.WORD).cast("long").alias("word_chars"), n("th.").alias("th_any"), n("e+").alias("e_runs"),
                    lit("e").alias("e_opt_s"), lit("ee").alias("ee"), lit("the", "and").alias("the_or_and"))


@register("r7_star_matches", """
SELECT doc_id, len(regexp_extract_all(text, 'e+')) + length(regexp_replace(text, 'e+', '', 'g')) + 1 AS e_star,
       len(regexp_extract_all(text, '(th|an)+')) + length(regexp_replace(text, '(th|an)+', '', 'g')) + 1 AS th_or_an_star,
       len(regexp_extract_all(text, '\\p{Nd}+')) + length(regexp_replace(text, '\\p{Nd}+', '', 'g')) + 1 AS digit_star,
       len(regexp_extract_all(text, 's')) + length(regexp_replace(text, 's', '', 'g')) + 1 AS s_opt
FROM documents""")
def r7_star_matches(spark, sf):
    """``len(re.findall(r'e*', s))``, ``(?:th|an)*``, ``\\d*`` and ``s?``, the
    empty matches between the others included."""
    d = Tables(spark, sf).documents
    units = {"e_star": "e+", "th_or_an_star": "(?:th|an)+", "digit_star": RX.DIGIT + "+", "s_opt": "s"}
    return d.select("doc_id", *[RX.count_with_empty("text", u).cast("long").alias(name) for name, u in units.items()])


@register("r2_digits", """
SELECT doc_id, array_to_string(regexp_extract_all(text, '\\p{Nd}'), '') AS digits,
       len(regexp_extract_all(text, '[^\\p{Nd}]')) AS non_digits
FROM documents""")
def r2_digits(spark, sf):
    """``''.join(re.findall(r'\\d', s))`` and ``len(re.findall(r'\\D', s))``."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", RX.digits_joined("text").alias("digits"),
                    RX.count_chars("text", r"[^\p{Nd}]").cast("long").alias("non_digits"))


@register("r6_end_anchor", """
SELECT conv_id, turn, regexp_matches(text, '\\.\\n?$') AS ends_with_period,
       regexp_matches(text, '^\\p{Lu}') AS starts_upper
FROM conversations""")
def r6_end_anchor(spark, sf):
    """``re.search(r'\\.$', s)``: Python's ``$`` also matches before one final
    newline; Java's does the same under UNIX_LINES ``(?d)``."""
    cv = Tables(spark, sf).conversations
    return cv.select("conv_id", "turn", RX.search("text", r"(?d)\.$").alias("ends_with_period"),
                     RX.search("text", r"^\p{Lu}").alias("starts_upper"))


@register("r9_dates", """
SELECT doc_id, array_to_string(regexp_extract_all(text, '\\p{Nd}{2}/\\p{Nd}{2}/\\p{Nd}{4}'), ';') AS dates
FROM documents""")
def r9_dates(spark, sf):
    """``re.findall(r'\\d{2}/\\d{2}/\\d{4}', review)`` for every text."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.array_join(RX.findall("text", RX.DATE_DMY), ";").alias("dates"))


@register("r10_strip_punct", f"""
SELECT doc_id, length(regexp_replace(text, '{_PUNCT_SQL}', '', 'g')) AS clean_len,
       md5(regexp_replace(text, '{_PUNCT_SQL}', '', 'g')) AS clean_md5
FROM documents""")
def r10_strip_punct(spark, sf):
    """``re.sub(r'[^\\w\\s]', '', s)``: punctuation and emoji go, accents stay."""
    d = Tables(spark, sf).documents
    clean = RX.strip_punct("text")
    return d.select("doc_id", F.length(clean).cast("long").alias("clean_len"), F.md5(clean).alias("clean_md5"))


@register("r11_search_split_sub", """
SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit,
       len(regexp_split_to_array(text, '[,;]')) AS n_clauses,
       md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS squeezed_md5
FROM documents""")
def r11_search_split_sub(spark, sf):
    """``re.search``, ``re.split`` and ``re.sub`` on each text."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", RX.search("text", "[0-9]").alias("has_digit"),
                    F.size(F.split("text", "[,;]")).cast("long").alias("n_clauses"),
                    F.md5(RX.sub("text", r"[ \t\n\x0B\f\r]+", " ")).alias("squeezed_md5"))


@register("r12_emails", f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '{RX.EMAIL}'), ';') AS emails,
       len(regexp_extract_all(text, '{RX.PHONE}')) AS phones
FROM documents""")
def r12_emails(spark, sf):
    """E-mail addresses and phone numbers found in each text."""
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.array_join(RX.findall("text", RX.EMAIL), ";").alias("emails"),
                    RX.count_matches("text", RX.PHONE).cast("long").alias("phones"))

