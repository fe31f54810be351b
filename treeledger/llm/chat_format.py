"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template names the control strings around a turn and says, by role, whether the turn's text counts in the loss.
``format_chats`` gives one row a conversation: the formatted text, the segments with their loss flags and whether
the roles follow the machine. ``parse_chats`` reads the turns and the loss text back from these outputs.

Cases: a null text is empty, a null role is the empty role (no transition accepts it), null turns come first, rows
that tie on turn are ordered by role and text, repeated rows stay, a null conv_id is a conversation of its own, an
empty table gives no rows; columns besides the four named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings and loss flags. A turn is written head + role + mid + text + tail."""

    head: str = "### "
    mid: str = ": "
    tail: str = "</turn>\n"
    #: A text must not hold these; each is written as the escape sign and a letter of its own.
    controls: dict = field(default_factory=lambda: {"### ": "h", "</turn>": "e"})
    escape: str = "\\"
    loss: dict = field(default_factory=lambda: {"assistant": True})
    #: (state, role) -> state; a missing pair leads to the error state, from which nothing leads away.
    transitions: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    accepting: tuple = ("assistant",)


DEFAULT = ChatTemplate()


def _escape(text: Column, t: ChatTemplate, more: dict | None = None) -> Column:
    """Write the escape sign as sign + b, then each control string as sign + its letter. The sign thus always starts
    a pair, so that undoing the pairs, the sign's own last, gives the text back."""
    text = F.replace(text, F.lit(t.escape), F.lit(t.escape + "b"))
    for control, letter in {**t.controls, **(more or {})}.items():
        text = F.replace(text, F.lit(control), F.lit(t.escape + letter))
    return text


def _unescape(text: Column, t: ChatTemplate, more: dict | None = None) -> Column:
    for control, letter in {**t.controls, **(more or {})}.items():
        text = F.replace(text, F.lit(t.escape + letter), F.lit(control))
    return F.replace(text, F.lit(t.escape + "b"), F.lit(t.escape))


def _role_controls(t: ChatTemplate) -> dict:
    return {t.mid: "m"}


def _state(roles: Column, t: ChatTemplate) -> Column:
    table = F.create_map(*[F.lit(x) for (s, r), to in t.transitions.items() for x in (f"{s}>{r}", to)])
    step = lambda s, r: F.coalesce(F.element_at(table, F.concat(s, F.lit(">"), r)), F.lit("error"))
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, n_turns, valid, formatted, segments array<struct<text, role, loss>>. Concatenated, the segments'
    texts are the formatted text."""
    t = template
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    counted = [r for r, on in t.loss.items() if on]

    def segments(x: Column) -> Column:
        none = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(t.head), _escape(x.role, t, _role_controls(t)), F.lit(t.mid)).alias("text"), x.role.alias("role"), none.alias("loss")),
            F.struct(_escape(x.text, t).alias("text"), x.role.alias("role"), x.role.isin(counted).alias("loss")),
            F.struct(F.lit(t.tail).alias("text"), x.role.alias("role"), none.alias("loss")),
        )

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _state(F.transform("turns", lambda x: x.role), t).isin(list(t.accepting)).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def parse_chats(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Read back: turns array<struct<role, text>> from the formatted text, loss_text from the segments' flags."""
    t = template
    pieces = F.filter(F.split("formatted", r"\Q" + t.tail + r"\E", -1), lambda p: p != "")

    def read(p: Column) -> Column:
        body = p.substr(F.lit(len(t.head) + 1), F.length(p))
        at = F.instr(body, t.mid)
        return F.struct(
            _unescape(body.substr(F.lit(1), at - 1), t, _role_controls(t)).alias("role"),
            _unescape(body.substr(at + len(t.mid), F.length(body)), t).alias("text"),
        )

    under = F.filter("segments", lambda s: s.loss)
    return formatted.withColumn("turns", F.transform(pieces, read)).withColumn(
        "loss_text", F.array_join(F.transform(under, lambda s: _unescape(s.text, t)), "")
    )
