"""Chat formatting with Spark's own functions: a finite-state machine over roles, and a template that marks turns.

Turns of a conversation are taken by (turn, role, text), nulls first; repeated rows are repeated turns. A null text is
empty, a null role is the empty role. Roles that the template does not know are written with its generic marks, and the
state machine reports them; every conversation is formatted. Other columns are ignored; an empty table gives no rows. A
conversation becomes one row, as its output is one string; only its own turns meet in a task. Very long texts are escaped and
read back whole. Turns equal in turn, role and text are interchangeable, so ties have one result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The character that, put inside a control string, keeps a text from holding one.
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before and after each role's text, which roles are under the loss, and which turn may follow which.

    `other` holds the marks of unknown roles: before the role's name, between name and text, after the text. `moves` maps
    (state, role) to the next state; what is missing is an error. Control strings start with a character of `heads`, and
    none is the beginning of another.
    """

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>\n"), "user": ("[INST]", "[/INST]\n"), "assistant": ("<s>", "</s>\n")})
    other: tuple = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>\n")
    loss_roles: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    ends: tuple = ("answered",)

    def controls(self) -> list[str]:
        found = [x.strip() for pair in self.marks.values() for x in pair] + [x.strip() for x in self.other]
        return list(dict.fromkeys(found))


LLAMA = Template()


def _literal(s: str) -> str:
    return re.sub(r"([\\\[\](){}.*+?^$|/<>])", r"\\\1", s)


def escaped(text: Column, template: Template = LLAMA) -> Column:
    """text with every escape character doubled and one put after the first character of each control string."""
    heads = "|".join(f"{_literal(c[0])}(?={_literal(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), f"({heads})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _machine(roles: Column, template: Template) -> Column:
    """The state after the last turn, or error:<number of the turn that may not stand there, from 1>."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)])
    step = lambda acc, role: F.struct((acc.at + 1).alias("at"), F.when(acc.state.startswith("error"), acc.state).otherwise(F.coalesce(F.try_element_at(moves, F.concat(acc.state, F.lit(">"), role)), F.concat(F.lit("error:"), (acc.at + 1).cast("string")))).alias("state"))
    return F.aggregate(roles, F.struct(F.lit(0).alias("at"), F.lit("start").alias("state")), step, lambda acc: acc.state)


def format_chats(turns: DataFrame, template: Template = LLAMA) -> DataFrame:
    """conv_id, segments (array of role, text, loss), formatted (their texts joined), state and valid."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_turns"))

    def mark(role: Column, side: int) -> Column:
        out = F.lit(template.other[2]) if side else F.concat(F.lit(template.other[0]), escaped(role, template), F.lit(template.other[1]))
        for name, pair in template.marks.items():
            out = F.when(role == name, F.lit(pair[side])).otherwise(out)
        return out

    def segment(x: Column, text: Column, loss: Column) -> Column:
        return F.struct(x.role.alias("role"), text.alias("text"), loss.alias("loss"))

    def segments(x: Column) -> Column:
        no = F.lit(False)
        return F.array(segment(x, mark(x.role, 0), no), segment(x, escaped(x.text, template), x.role.isin(*template.loss_roles)), segment(x, mark(x.role, 1), no))

    chats = chats.select(
        "conv_id",
        F.flatten(F.transform("_turns", segments)).alias("segments"),
        _machine(F.transform("_turns", lambda x: x.role), template).alias("state"),
    )
    return chats.select("conv_id", "segments", F.array_join(F.transform("segments", lambda x: x.text), "").alias("formatted"), "state", F.col("state").isin(*template.ends).alias("valid"))


def read_back(formatted: Column, template: Template = LLAMA) -> Column:
    """The turns (array of role, text) that a formatted string holds: what `format_chats` was given."""
    opens = "|".join(_literal(a) for a, _ in template.marks.values())
    closes = "|".join([_literal(b) for _, b in template.marks.values()] + [_literal(template.other[2])])
    turn = f"(?s)(?:({opens})|{_literal(template.other[0])}(.*?){_literal(template.other[1])})(.*?)(?:{closes})"
    names = F.create_map(*[F.lit(x) for name, (a, _) in template.marks.items() for x in (a, name)])
    role = lambda x: F.coalesce(F.try_element_at(names, F.regexp_extract(x, turn, 1)), unescaped(F.regexp_extract(x, turn, 2)))
    return F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(0)), lambda x: F.struct(role(x).alias("role"), unescaped(F.regexp_extract(x, turn, 3)).alias("text")))


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x.loss), lambda x: unescaped(x.text)), "")
