"""Chat formatting (operator 6, DataFrame functions only): typed content parts.

A turn's content is a list of typed parts. One visitor for each kind turns a part into
its piece of the text: text is escaped, every attachment becomes a placeholder in its
place. References, kinds and expanded token counts of attachments are recorded in the
order of their placeholders. ``format_conversations`` writes each conversation as

    <s>(<|im_start|>ROLE<|im_sep|>CONTENT<|im_end|>)*</s>

with a loss mask of runs (chars, loss) that cover the string: three runs a turn (up to
its content, its content, its end), so the mask needs no position arithmetic. ``parse``
reads turns and mask back.

Escaping is reversible: a backslash is doubled, and one is put behind the first
character of every control string, so no control string is left in an escaped text.

Defined cases: a null text is empty, a null role is the empty role, null turns come
first; rows that repeat stay, in order of (turn, role, parts); a part of a kind without a visitor
becomes ``<|attachment|>`` with no tokens, a null part nothing; a null conversation id is
a conversation of its own; an empty table gives no rows; other columns are ignored. One
conversation is one output row, so its text must fit a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

BEGIN, END = "<s>", "</s>"
TURN, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character of a control string: template marks, instruction marks and placeholders.
_CONTROL = r"\\|(?<=<)(?=/?s>)|(?<=<)(?=\|)|(?<=\[)(?=/?INST\])|(?<=<)(?=/?SYS>)|(?<=<)(?=<SYS>>)"
LOSS_ROLES = ("assistant",)
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class Visitor:
    """How parts of one kind are written, and how many tokens they expand to."""

    def __init__(self, placeholder: str | None, tokens: Callable[[Column], Column] | None = None):
        self.placeholder, self._tokens = placeholder, tokens

    def write(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit(""))) if self.placeholder is None else F.lit(f"<|{self.placeholder}|>")

    def tokens(self, part: Column) -> Column:
        if self._tokens is None:
            return F.lit(0).cast("long")
        return F.coalesce(self._tokens(F.greatest(part["units"], F.lit(0))).cast("long"), F.lit(0).cast("long"))


#: units: pixels of an image, milliseconds of audio, characters of a document.
VISITORS: dict[str, Visitor] = {
    "text": Visitor(None),
    "image": Visitor("image", lambda n: 85 + 170 * F.ceil(n / (512 * 512))),
    "audio": Visitor("audio", lambda n: F.ceil(n / 40)),
    "document": Visitor("document", lambda n: F.ceil(n / 4)),
}
OTHER = Visitor("attachment")


def _visit(part: Column, what: Callable[[Visitor], Column], visitors: dict[str, Visitor]) -> Column:
    out: Column | None = None
    for kind, visitor in visitors.items():
        hit = part["kind"] == kind
        out = F.when(hit, what(visitor)) if out is None else out.when(hit, what(visitor))
    return out.otherwise(what(OTHER))


def text_parts(text: Column) -> Column:
    """Plain text as a list of one part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return F.array(part).cast(PARTS)


def flatten_parts(parts: Column, visitors: dict[str, Visitor] | None = None) -> tuple[Column, Column]:
    """(content, attachments): the text with placeholders, and (kind, ref, tokens) of each placeholder in order."""
    visitors = visitors or VISITORS
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    content = F.array_join(F.transform(parts, lambda p: _visit(p, lambda v: v.write(p), visitors)), "")
    written = [k for k, v in visitors.items() if v.placeholder is None]
    attached = F.filter(parts, lambda p: ~F.coalesce(p["kind"].isin(written), F.lit(False)))
    entries = F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _visit(p, lambda v: v.tokens(p), visitors).alias("tokens")))
    return content, entries


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, visitors: dict[str, Visitor] | None = None) -> DataFrame:
    """(conv_id, formatted, mask, attachments, attachment_tokens) from turns (conv_id, turn, role, parts)."""
    content, attached = flatten_parts(F.col("parts"), visitors)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"), content.alias("content"),
            attached.alias("attached"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(SEP), t["content"], F.lit(STOP))), "")
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    runs = F.flatten(F.transform("turns", lambda t: F.array(
        run(F.length(t["role"]) + len(TURN) + len(SEP), F.lit(False)), run(F.length(t["content"]), t["loss"]), run(F.lit(len(STOP)), F.lit(False)),
    )))
    edge = lambda s: F.array(run(F.lit(len(s)), F.lit(False)))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return grouped.select(
        "conv_id", F.concat(F.lit(BEGIN), text, F.lit(END)).alias("formatted"), F.concat(edge(BEGIN), runs, edge(END)).alias("mask"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Adds ``parsed``: (role, content, loss) of each turn, unescaped, from the string and its mask alone."""
    body = F.substring("formatted", F.lit(len(BEGIN) + 1), F.length("formatted") - len(BEGIN) - len(END))
    pieces = F.split(body, r"<\|im_end\|>")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column, i: Column) -> Column:
        halves = F.split(piece, r"<\|im_sep\|>", 2)
        return F.struct(
            unescape(F.substring(halves[0], F.lit(len(TURN) + 1), F.length(halves[0]))).alias("role"), unescape(halves[1]).alias("content"),
            F.get("mask", i * 3 + 2)["loss"].alias("loss"),
        )

    return formatted.withColumn("parsed", F.transform(turns, turn))


#: A conversation whose texts are control strings, to show that they come back unharmed.
PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    turns = rows.unionByName(probe).withColumn("parts", text_parts(F.col("text")))
    # written and read back, which also ends the plan here
    back = parse(tables.store(format_conversations(turns), "chat"))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("parsed", lambda t: t["loss"]), lambda t: t["content"]), "")
    out = back.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
