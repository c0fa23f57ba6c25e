"""Chat formatting by prefix-target expansion: every assistant turn becomes an
example of its own, with all turns before it as context and only that reply
trainable. DataFrame functions only.

A turn is written ``### role:`` and a line end, the text, ``</turn>`` and a
line end. Inside texts and roles the characters that control strings are made
of are escaped (backslash: two of them; ``<``: backslash l; ``#``: backslash
h; in roles also ``:`` as backslash c and the line end as backslash n), so no
text can end a turn or begin one, and the texts are read back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Undo :func:`escape`: between doubled backslashes every backslash begins
    one of the other sequences."""
    def plain(x: Column) -> Column:
        out = F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
        return F.replace(F.replace(out, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n")) if role else out
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _header(turn: Column) -> Column:
    return F.concat(F.lit("### "), escape(turn["role"], role=True), F.lit(":\n"))


def _written(turn: Column) -> Column:
    return F.concat(_header(turn), escape(turn["text"]), F.lit(END))


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Examples: conv_id, example (position of the reply among the turns),
    text, loss_start, loss_end (code points of the text, end exclusive: the
    reply alone), is_last (this row's text holds the whole conversation).

    A conversation that does not end with a reply gets one more row with the
    whole of it and an empty loss span, so nothing is lost; so does one
    without replies. Null text or role: empty. Turns are ordered by turn (null
    first), ties by role and text; repeated rows stay. A null conv_id is a
    conversation of its own. Other columns are not read. Empty table: empty
    result."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    conv = conv.select("conv_id", "turns", F.transform("turns", _written).alias("written"), F.size("turns").alias("n"))
    at = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.get("turns", i)["role"] == ASSISTANT) | (i == F.col("n") - 1))
    one = conv.withColumn("example", F.explode(at))
    turn = F.get("turns", F.col("example"))
    one = one.select("conv_id", "example", (F.col("example") == F.col("n") - 1).alias("is_last"), turn.alias("turn"),
                     F.array_join(F.slice("written", F.lit(1), F.col("example")), "").alias("context"))
    is_reply = F.col("turn.role") == ASSISTANT
    head, reply = _header(F.col("turn")), escape(F.col("turn.text"))
    text = F.concat("context", head, reply, F.lit(END))
    start = F.when(is_reply, F.length("context") + F.length(head)).otherwise(F.length(text))
    stop = F.when(is_reply, F.length("context") + F.length(head) + F.length(reply)).otherwise(F.length(text))
    return one.select("conv_id", F.col("example").cast("long").alias("example"), text.alias("text"),
                      start.cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"), "is_last")


def parse(text: Column) -> Column:
    """The turns of a formatted text: array of struct (role, text)."""
    parts = F.split(text, "</turn>\n")
    def one(x: Column) -> Column:
        colon = F.instr(x, ":\n")
        return F.struct(unescape(F.substring(x, F.lit(5), colon - 5), role=True).alias("role"),
                        unescape(F.substring(x, colon + 2, F.length(x))).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def trainable(text: Column, start: Column, end: Column) -> Column:
    """The text under the loss span, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from formatted examples: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (code points of all its
    examples)."""
    whole = F.when(F.col("is_last"), parse(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select("conv_id", "example", "is_last", whole.alias("turns"), F.length("text").alias("chars"),
                           F.when(F.col("loss_end") > F.col("loss_start"), trainable(F.col("text"), F.col("loss_start"), F.col("loss_end"))).otherwise(F.lit("")).alias("reply"))
    rows = rows.select("conv_id", "example", F.when(F.col("is_last"), F.size("turns").cast("long")).alias("n"),
                       F.when(F.col("is_last"), F.sha2(said, 256)).alias("sha"), "chars", "reply")
    out = rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
                                      F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"))
    loss = F.array_join(F.col("replies.reply"), "")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
