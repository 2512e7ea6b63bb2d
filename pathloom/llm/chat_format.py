"""Operator 3, chat formatting: typed content parts through a visitor, native.

A turn's content is a list of typed parts, or plain text, which is one text part.  The
visitor (`visit`) has one case a type: text is escaped; image, audio and document parts
become placeholders in their order, and record an attachment (position, type, reference)
and the number of tokens the placeholder expands to.  Turns are marked as

    <|im_start|>role\\ntext<|im_end|>\\n

and no text can imitate a mark: escaping adds a backslash in every `<|`, `<\\|`, `<\\\\|`
..., so that no `<|` is left, and unescaping removes that one again.  In roles, which end at
the newline, `%`, newlines and `<|` are percent-encoded.

The loss mask is kept as segments: a conversation is a list of (text, loss) whose texts
joined are the formatted string, and loss is true on assistant texts alone.

Turns are escaped and measured before they are grouped; a conversation itself must be one
string, so its turns do meet in one row.

Defined results: null text or parts are an empty text; a null role is an empty role; a
null turn comes first; rows with equal turns are ordered by role, then text; repeated
rows are turns of their own; null conv_id is one conversation; parts of an unknown type
are placeholders of that type with no tokens; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import columns

START, END = "<|im_start|>", "<|im_end|>"
PART = "array<struct<type:string,text:string,ref:string,amount:double>>"
#: Tokens of one unit of a part's `amount`: image tiles, seconds of audio, document pages.
TOKENS = {"image": 256, "audio": 25, "document": 1024}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<|", "%3C|")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("<|", "%3C|"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def visit(part: Column) -> Column:
    """A part's struct(text, attachment type, reference, tokens)."""
    kind, text = F.coalesce(part["type"], F.lit("text")), F.coalesce(part["text"], F.lit(""))
    tokens = F.lit(0)
    for name, each in TOKENS.items():
        tokens = F.when(kind == name, F.ceil(F.coalesce(part["amount"], F.lit(1.0)) * each)).otherwise(tokens)
    mark = F.concat(F.lit("<|"), F.regexp_replace(kind, "[^a-z_]", "_"), F.lit("|>"))
    return F.struct(
        F.when(kind == "text", escape(text)).otherwise(mark).alias("text"),
        F.when(kind != "text", kind).alias("type"),
        F.when(kind != "text", part["ref"]).alias("ref"),
        F.when(kind == "text", F.lit(0)).otherwise(tokens).cast("long").alias("tokens"),
    )


def chat_format(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """Returns conv_id, formatted, segments (text, loss), attachments (turn, type, ref),
    n_tokens (that placeholders expand to)."""
    turns = columns(turns, conv_id=conv_col, turn=turn_col, role=role_col, **({"parts": parts_col} if parts_col else {"text": text_col}))
    if not parts_col:
        turns = turns.withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"))))
    seen = F.transform(F.coalesce("parts", F.array().cast(PART)), visit)
    rows = turns.select("conv_id", F.struct("turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), F.array_join(F.transform(seen, lambda p: p["text"]), "").alias("text"), F.filter(seen, lambda p: p["type"].isNotNull()).alias("attached")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.array(F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")), F.struct(t["text"].alias("text"), (t["role"] == "assistant").alias("loss")), F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = grouped.select("conv_id", F.flatten(pieces).alias("segments"), attached.alias("attachments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read from the output alone: conv_id, turns (role, text), loss_text,
    n_tokens, formatted. Placeholders stay as they are."""
    bodies = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    turns = F.transform(bodies, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "n_tokens", "formatted")
