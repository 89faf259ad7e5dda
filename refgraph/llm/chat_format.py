"""Chat formatting: typed content parts, flattened by a visitor into text with placeholders, in a template that can be read back.

A turn is written TURN role newline content END newline. Texts are escaped: a control string in them gets a backslash after its
first character, one more than it may have there already, so nothing in a text can open or close a turn or pass for a placeholder,
and taking one backslash away gives the text back. Roles are escaped in the same way, and keep their own line.

Attachments (image, audio, document) leave a placeholder of their kind; what they stood for is recorded in order beside the text,
with the number of tokens that the placeholder expands to.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

TURN, END = "<|turn|>", "<|end|>"
#: Tokens of one unit of each kind of attachment: an image's tile, an audio's second, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
#: Strings that templates give a meaning to, this one and others.
CONTROL = [TURN, END, *(f"<|{kind}|>" for kind in UNIT_TOKENS), "<s>", "</s>", "[INST]", "[/INST]"]

#: An attachment in plain text, ![note](address), and what its address ends in, by kind; anything else is a document.
ATTACHED = r"!\[[^\]\[]*\]\([^()\s]+\)"
ENDINGS = {"image": "png|jpe?g|gif|webp", "audio": "wav|mp3|ogg|flac"}

PART = "struct<kind: string, value: string, units: bigint>"
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLACEHOLDER = "|".join(re.escape(f"<|{kind}|>") for kind in UNIT_TOKENS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def text_parts(text: Column) -> Column:
    """The parts of a plain text, an array of PART: its attachments, and the texts before, between and after them. units is null."""
    part = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"), F.lit(None).cast("long").alias("units"))

    def attached(x: Column) -> Column:
        kind = F.lit("document")
        for name, ends in ENDINGS.items():
            kind = F.when(F.regexp_like(x, F.lit(rf"(?i)\.(?:{ends})\)$")), name).otherwise(kind)
        return part(kind, x)

    texts = F.transform(F.split(text, ATTACHED, -1), lambda x: F.array(part(F.lit("text"), x)))
    found = F.transform(F.regexp_extract_all(text, F.lit(ATTACHED), F.lit(0)), lambda x: F.array(attached(x)))
    mixed = F.flatten(F.zip_with(texts, found, lambda t, a: F.concat(t, F.coalesce(a, F.array().cast(f"array<{PART}>")))))
    return F.when(F.contains(text, F.lit("![")), mixed).otherwise(F.array(part(F.lit("text"), text)))


def _text(part: Column) -> tuple[Column, Column]:
    return escape(F.coalesce(part["value"], F.lit(""))), F.lit(0).cast("long")


def _attachment(kind: str, each: int) -> Callable[[Column], tuple[Column, Column]]:
    return lambda part: (F.lit(f"<|{kind}|>"), F.coalesce(part["units"], F.lit(1)) * each)


#: What each kind of part shows as, and how many tokens its placeholder expands to. Other kinds are texts.
VISITORS = {kind: _attachment(kind, each) for kind, each in UNIT_TOKENS.items()}


def flatten_parts(parts: Column) -> Column:
    """struct(content, attachments): the parts in order, as one text with placeholders; attachments, array<struct<kind, ref,
    tokens>>, are what its placeholders stand for. Null parts and null values are empty texts, null units are one."""

    def visit(p: Column) -> Column:
        shown, tokens = _text(p)
        for kind, visitor in VISITORS.items():
            its_shown, its_tokens = visitor(p)
            shown, tokens = F.when(p["kind"] == kind, its_shown).otherwise(shown), F.when(p["kind"] == kind, its_tokens).otherwise(tokens)
        return F.struct(F.coalesce(shown, F.lit("")).alias("shown"), p["kind"].alias("kind"), F.coalesce(p["value"], F.lit("")).alias("ref"), tokens.alias("tokens"))

    def made(visited: Column) -> Column:
        kept = F.filter(visited, lambda v: F.coalesce(v["kind"].isin(*VISITORS), F.lit(False)))
        attachments = F.transform(kept, lambda v: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens")))
        return F.struct(F.array_join(F.transform(visited, lambda v: v["shown"]), "").alias("content"), attachments.alias("attachments"))

    return let(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), made)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", learned_role: str = "assistant") -> DataFrame:
    """(conv_col, place, piece, start, loss_start, loss_length, attachments): the written form of every row, where it starts in
    its conversation, and the stretch of it that is learned (length 0 for other roles), in code points.

    One shuffle, by conversation, in which rows are sorted and their lengths summed as they pass; nothing is gathered. Rows are in
    the order of turn (nulls first), then role, then text. Null texts and roles are empty, repeated rows are turns of their own,
    rows with a null conversation are one, an empty table gives an empty one, and other columns are left out whatever their names.
    parts: the content of a row, array<PART>; by default what text_parts finds in its text."""
    content = text_parts(F.coalesce(rows[f"`{text_col}`"], F.lit(""))) if parts is None else parts
    one = rows.select(rows[f"`{conv_col}`"], rows[f"`{turn_col}`"].alias("__turn"), F.coalesce(rows[f"`{role_col}`"], F.lit("")).alias("__role"), content.alias("__parts"))
    flat = one.withColumns({"__head": F.concat(F.lit(TURN), escape_role(F.col("__role")), F.lit("\n")), "__flat": flatten_parts(F.col("__parts"))})
    written = flat.withColumn("piece", F.concat("__head", "__flat.content", F.lit(END + "\n"))).withColumn("__chars", F.char_length("piece").cast("long"))
    w = Window.partitionBy(f"`{conv_col}`").orderBy(F.asc_nulls_first("__turn"), "__role", "piece")
    return written.select(
        f"`{conv_col}`", F.row_number().over(w).alias("place"), "piece", (F.sum("__chars").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__chars")).alias("start"),
        F.char_length("__head").alias("loss_start"), F.when(F.col("__role") == learned_role, F.char_length("__flat.content")).otherwise(0).alias("loss_length"), "__flat.attachments",
    )


def format_chats(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, formatted, turns): the text of each conversation, and of its turns, in order, start, loss_start and loss_length
    (loss_start from the turn's start) and attachments. turns: of format_turns, whose shuffle serves again. A conversation becomes
    one string, so it must be below 2 GB; where it may be longer, work on the rows of format_turns."""
    rows = F.sort_array(F.collect_list(F.struct("place", "piece", "start", "loss_start", "loss_length", "attachments")))
    got = turns.groupBy(f"`{conv_col}`").agg(rows.alias("__rows"))
    spans = F.transform("__rows", lambda x: F.struct(*(x[k].alias(k) for k in ("start", "loss_start", "loss_length", "attachments"))))
    return got.select(f"`{conv_col}`", F.array_join(F.transform("__rows", lambda x: x["piece"]), "").alias("formatted"), spans.alias("turns"))


def _restored(content: Column, attachments: Column) -> Column:
    """The text of a turn's content: attachments are put back where placeholders stand, then escapes go."""
    texts = F.split(content, _PLACEHOLDER, -1)
    mixed = F.array_join(F.zip_with(texts, attachments, lambda t, a: F.concat(unescape(F.coalesce(t, F.lit(""))), F.coalesce(a["ref"], F.lit("")))), "")
    return F.when(F.size(attachments) > 0, mixed).otherwise(unescape(content))


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turns array<struct<role, text>>, learned, formatted): what formatted says, and all text under the loss mask, with
    nothing between. Only formatted, the spans and the attachments are looked at."""

    def cut(formatted: Column) -> Column:
        pieces = F.split(formatted, re.escape(END) + "\n", -1)
        return F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x["piece"], "\n", 1)
        role = unescape_role(F.substring(head, F.lit(len(TURN) + 1), F.char_length(head)))
        content = F.substring(x["piece"], F.char_length(head) + 2, F.char_length(x["piece"]))
        mask = F.substring(x["piece"], x["span"]["loss_start"] + 1, x["span"]["loss_length"])
        return F.struct(role.alias("role"), _restored(content, x["span"]["attachments"]).alias("text"), F.when(x["span"]["loss_length"] > 0, _restored(mask, x["span"]["attachments"])).otherwise("").alias("learned"))

    paired = F.zip_with(let(F.col("formatted"), cut), F.col("turns"), lambda p, s: F.struct(p.alias("piece"), s.alias("span")))
    got = chats.select(f"`{conv_col}`", "formatted", F.transform(paired, turn).alias("__read"))
    turns = F.transform("__read", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return got.select(f"`{conv_col}`", turns.alias("turns"), F.array_join(F.transform("__read", lambda x: x["learned"]), "").alias("learned"), "formatted")
