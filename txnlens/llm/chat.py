"""Chat formatting by a finite-state machine over roles, with DataFrame functions only.

A template says which strings mark a turn, which roles carry loss, and which role may follow which.
Texts are written between the marks with control strings broken up by an escape character, so the
formatted string can be read back without loss whatever the texts contain.

Defined results: null texts and null roles count as empty; turns are taken by (turn, role, text), so
ties and repeated rows have one order; a conversation that breaks the turn order, holds an unknown
role or doesn't end in an accepting state is formatted all the same and marked ``valid = false``;
rows without ``conv_id`` form one conversation; an empty table gives an empty result; further columns
are not read. A conversation is one record of the output, so it has to fit into memory; the work is
proportional to its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    """``transitions`` maps (state, role) to the next state; what it lacks leads to the error state."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    escape: str = "␛"
    loss_roles: tuple[str, ...] = ("assistant",)
    # fixed values: control strings of common chat formats, which texts may not contain unescaped
    controls: tuple[str, ...] = (
        "<s>",
        "</s>",
        "[INST]",
        "[/INST]",
        "<<SYS>>",
        "<</SYS>>",
        "<|im_start|>",
        "<|im_end|>",
        "<|endoftext|>",
    )
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "system",
            (START, "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def escaped(self, text: Column) -> Column:
        """Double the escape character and put one behind the first character of each control."""
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        marks = (self.turn, self.text, self.end, *self.controls)
        return reduce(
            lambda c, m: F.replace(c, F.lit(m), F.lit(m[0] + self.escape + m[1:])), marks, doubled
        )

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"(?s){self.escape}(.)", "$1")

    def state_after(self, state: Column, role: Column) -> Column:
        pairs = [
            F.lit(x) for (s, r), to in self.transitions.items() for x in (f"{s}\n{r}", to)
        ]
        key = F.concat(state, F.lit("\n"), role)
        return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(ERROR))


def format_chats(conversations: DataFrame, template: Template) -> DataFrame:
    """conv_id, valid, segments (text, loss), formatted, loss_spans (start, length in code points).

    ``segments`` joined give ``formatted``; spans cover the segments with loss.
    """
    empty = F.lit("")
    head = lambda role: F.concat(F.lit(template.turn), template.escaped(role), F.lit(template.text))
    tail = template.end + "\n"
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    rows = rows.withColumn("body", template.escaped(F.col("text")))
    # where a turn begins is a running sum over the turns before it; the grouping reuses the window's shuffle
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length(head(F.col("role"))) + F.length("body") + len(tail)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)).cast("int")
    turns = (
        rows.select("conv_id", start.alias("start"), "role", "body")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "role", "body"))).alias("turns"))
    )
    final = F.aggregate(
        "turns", F.lit(START), lambda s, t: template.state_after(s, t["role"])
    )
    loss = lambda t: t["role"].isin(*template.loss_roles)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(segment(head(t["role"]), no), segment(t["body"], loss(t)), segment(F.lit(tail), no)),
        )
    )
    spans = F.transform(
        F.filter("turns", loss),
        lambda t: F.struct(
            (t["start"] + F.length(head(t["role"]))).alias("start"), F.length(t["body"]).alias("length")
        ),
    )
    return turns.select(
        "conv_id",
        final.isin(*template.accepting).alias("valid"),
        segments.alias("segments"),
        spans.alias("loss_spans"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))


def read_turns(formatted: Column, template: Template) -> Column:
    """The (role, text) turns of a formatted string."""

    def quoted(mark: str) -> str:
        return "\\Q" + mark + "\\E"

    parts = F.split(formatted, quoted(template.end) + "\n", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    start = len(template.turn) + 1

    def turn(part: Column) -> Column:
        fields = F.split(part, quoted(template.text), 2)
        return F.struct(
            template.unescaped(F.substring(F.get(fields, F.lit(0)), start, 2**31 - 1)).alias("role"),
            template.unescaped(F.get(fields, F.lit(1))).alias("text"),
        )

    return F.transform(whole, turn)


def loss_text(template: Template) -> Column:
    """All text under the loss mask of a formatted row, unescaped."""
    masked = F.filter("segments", lambda x: x["loss"])
    return F.array_join(F.transform(masked, lambda x: template.unescaped(x["text"])), "")
