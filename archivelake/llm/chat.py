"""Chat formatting from a declarative template.

A template names the control strings around a turn, the roles whose text is learned
from, and which role may follow which. The last is a finite-state machine: its state
is the role spoken last, its start a state of its own.

Formatting gives text segments, each with a loss flag. Control strings inside a text
are made harmless by replacing every first character of a control string, and the
escape character itself, with the escape character and a letter. An escaped text
holds no such first character at all, so control strings stand only where the template
put them, and unescaping gives the text back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "<start>"


@dataclass(frozen=True)
class Template:
    """`open` + role + `middle` + text + `close` make one turn.

    `follows` maps a state to the roles that may come next, `ends` holds the states a
    conversation may end in.
    """

    open: str = "### "
    middle: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("assistant",)

    def codes(self) -> list[tuple[str, str]]:
        """(character, its escaped form), the escape character first."""
        firsts = dict.fromkeys([self.escape, self.open[0], self.middle[0], self.close[0]])
        if len(self.escape) != 1 or len(firsts) > 20 or self.escape in (self.open[0], self.middle[0], self.close[0]):
            raise ValueError("the escape must be a character of its own")
        letters = (c for c in "abcdefghijklmnopqrstuvwxyz" if c not in firsts)
        return [(c, self.escape + next(letters)) for c in firsts]


def escaped(text: Column, template: Template) -> Column:
    for plain, code in template.codes():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    # No code arises from another: the escape character itself comes last.
    for plain, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


#: Turns of one conversation handled in one task while their order is checked.
SPAN_TURNS = 4096


def ordered_turns(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, place, start, role, head, body, state_before) of every turn.

    `turns` has conv_id, turn, role and text. `place` counts a conversation's turns from
    0 by turn, then role, then text, nulls first; repeated rows are turns of their own.
    `start` is the character at which a turn begins in the formatted conversation, `head`
    and `body` are its escaped strings and `state_before` is the role of the turn before.
    A long conversation is cut into spans of turn numbers: windows run inside a span,
    and one row per span carries count, length and last role onward. Null ids make one
    conversation; a null role is an empty one, a null text an empty one.
    """
    rows = turns.select(
        "conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("text", F.lit("")), template).alias("body"),
        F.floor(F.coalesce("turn", F.lit(-1)) / SPAN_TURNS).alias("_span"),
    ).withColumn("head", F.concat(F.lit(template.open), escaped(F.col("role"), template), F.lit(template.middle)))
    rows = rows.withColumn("_chars", F.length("head") + F.length("body") + len(template.close))
    order = [F.col("_turn").asc_nulls_first(), "role", "body"]
    inside = Window.partitionBy("conv_id", "_span").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        rows.withColumn("_n", F.row_number().over(inside)).withColumn("_before", F.lag("role").over(inside))
        .withColumn("_end", F.sum("_chars").over(so_far))
    )
    spans = rows.groupBy("conv_id", "_span").agg(
        F.count("*").alias("_size"), F.sum("_chars").alias("_long"),
        F.max_by("role", F.struct(F.col("_turn").isNotNull(), "_turn", "role", "body")).alias("_last"),
    )
    across = Window.partitionBy("conv_id").orderBy("_span")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        F.col("conv_id").alias("_conv"), F.col("_span").alias("_at"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_skip"),
        F.coalesce(F.sum("_long").over(earlier), F.lit(0)).alias("_offset"),
        F.lag("_last").over(across).alias("_carried"),
    )
    met = local.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_span") == F.col("_at")))
    return met.select(
        "conv_id", (F.col("_n") + F.col("_skip") - 1).cast("long").alias("place"),
        (F.col("_offset") + F.col("_end") - F.col("_chars")).cast("long").alias("start"),
        "role", "head", "body", F.coalesce("_before", "_carried", F.lit(START)).alias("state_before"),
    )


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Text segments: conv_id, place, part (0 to 2), start, segment, loss, allowed.

    Concatenated by place and part they are the formatted conversation, in which
    `segment` begins at character `start`. `loss` is true for the texts of learned roles
    only. `allowed` is false for the turns that the machine refuses; every turn is
    formatted all the same, and dropping such conversations is the caller's choice.
    """
    template = template or Template()
    steps = F.create_map(*[
        F.lit(x) for state, roles in template.follows.items() for role in roles for x in (f"{state}\u0000{role}", True)
    ])
    step = F.concat_ws("\u0000", "state_before", "role")
    learned = F.col("role").isin(*template.learned)
    body_start = F.col("start") + F.length("head")
    parts = F.array(*[
        F.struct(
            F.lit(part).alias("part"), start.cast("long").alias("start"), text.alias("segment"), loss.alias("loss")
        ) for part, start, text, loss in (
            (0, F.col("start"), F.col("head"), F.lit(False)),
            (1, body_start, F.col("body"), learned),
            (2, body_start + F.length("body"), F.lit(template.close), F.lit(False)),
        )
    ])
    return ordered_turns(turns, template).select(
        "conv_id", "place", F.coalesce(F.try_element_at(steps, step), F.lit(False)).alias("allowed"), F.inline(parts)
    ).select("conv_id", "place", "part", "start", "segment", "loss", "allowed")


def render(found: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, valid.

    `loss_spans` holds (start, length) in characters of `formatted`. `valid` says that
    the machine allows every turn and ends in an end state. A training example is one
    string, so a conversation is gathered whole here.
    """
    template = template or Template()
    row = F.struct("place", "part", "start", "segment", "loss")
    final = [template.open + role + template.middle for role in template.ends]
    head = F.when(F.col("part") == 0, F.col("segment"))
    gathered = found.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.min("allowed").alias("allowed"),
        F.max_by(head, F.when(F.col("part") == 0, F.col("place"))).alias("last_head"),
    )
    spans = F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(
        r["start"].alias("start"), F.length(r["segment"]).alias("length")
    ))
    return gathered.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("formatted"),
        spans.alias("loss_spans"), (F.col("allowed") & F.col("last_head").isin(*final)).alias("valid"),
    )


def read_back(rendered: DataFrame, template: Template | None = None) -> DataFrame:
    """Add `turns`, the (role, text) pairs read from `formatted` alone, and
    `loss_texts`, the texts under its loss spans, all unescaped."""
    template = template or Template()
    chunks = F.split("formatted", "\\Q" + template.close + "\\E")  # the last one is empty

    def turn(chunk: Column) -> Column:
        inner = F.substr(chunk, F.lit(len(template.open) + 1))
        role = F.substring_index(inner, template.middle, 1)
        text = F.substr(inner, F.length(role) + len(template.middle) + 1)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    under = F.transform("loss_spans", lambda s: unescaped(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]), template
    ))
    return rendered.withColumn("turns", F.transform(F.slice(chunks, 1, F.size(chunks) - 1), turn)).withColumn(
        "loss_texts", under
    )
