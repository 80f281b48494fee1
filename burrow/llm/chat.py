"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame expressions.

Cases: a null text or role counts as empty; a null turn comes first; rows of one turn are ordered by role and
text, so ties and repeated rows have a fixed order and are all kept; a conversation whose roles break the
machine's rules is formatted all the same and marked ``valid = false`` with the index of its first bad turn; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each turn, which roles bear loss, and which role may follow which."""

    opening: str = "<|im_start|>"
    header_end: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


#: Escapes, applied in this order; every control string begins with "<|", which no escaped text holds.
ESCAPES = (("\\", "\\0"), ("\n", "\\1"), ("<|", "<\\2"))


def escape(text: Column, *, header: bool = False) -> Column:
    """Reversible: afterwards each backslash starts a two-character code and "<|" does not occur. Line ends are escaped in headers only."""
    for plain, code in ESCAPES:
        if header or plain != "\n":
            text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("<\\2"), F.lit("<|"))
    text = F.replace(text, F.lit("\\1"), F.lit("\n"))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, valid, bad_turn, segments, formatted``.

    ``segments`` is an array of (text, loss); joined, its texts are ``formatted``.
    """
    template = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\0{role}", to)])
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\0"), t["role"]))
        bad = F.when((acc["bad"] < 0) & to.isNull(), acc["at"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(to, t["role"]).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    def emit(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.opening), escape(t["role"], header=True), F.lit(template.header_end)), F.lit(False)),
            part(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.closing), F.lit(False)),
        )

    out = grouped.select("conv_id", F.aggregate("turns", first, step).alias("run"), F.flatten(F.transform("turns", emit)).alias("segments"))
    return out.select(
        "conv_id",
        ((F.col("run.bad") < 0) & F.col("run.state").isin(*template.accept)).alias("valid"),
        F.col("run.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    template = template or Template()
    parts = F.split(formatted, "\\Q" + template.opening + "\\E", -1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, template.header_end, 1)
        skip = F.length(head) + len(template.header_end)
        body = F.substring(part, skip + 1, F.length(part) - skip - len(template.closing))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, 2, F.size(parts) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
