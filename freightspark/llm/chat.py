"""Chat formatting: a finite-state machine over roles, a declarative template, reversible escapes, a loss mask.

DataFrame functions only. One output record per conversation, as the format demands: a conversation's turns
are gathered into one row, so the longest conversation must fit in memory.

Defined cases: a null text is an empty text and a null role an empty role; rows with a null conv_id form one
conversation; turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns;
an unknown role is formatted like a user's turn, without loss, and makes the conversation invalid; an empty
table gives an empty result. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written: open + escaped role + opened, escaped text, close. Texts of `loss` roles are trained on."""

    open: str = "<|"
    opened: str = "|>\n"
    close: str = "<|end|>\n"
    escape: str = "\\"
    #: Two-character control strings that may not stand inside a text: the escape goes between the two.
    control: tuple[str, ...] = ("<|", "|>")
    loss: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; a conversation may stop in any state but the first.
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


DEFAULT = Template()


def escaped(c: Column, t: Template = DEFAULT) -> Column:
    """Reversible: the escape character is doubled and no control string is left."""
    out = F.replace(c, F.lit(t.escape), F.lit(t.escape * 2))
    for x in t.control:
        out = F.replace(out, F.lit(x), F.lit(x[0] + t.escape + x[1]))
    return out


def unescaped(c: Column, t: Template = DEFAULT) -> Column:
    return F.regexp_replace(c, f"(?s)\\{t.escape}(.)", "$1")


def format_chats(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation.

    formatted: the text; segments: array of (text, loss) whose texts joined give formatted; loss_spans: array of
    (start, length) in code points of the segments under the loss mask; valid: the roles follow the machine;
    last_state: where it stopped, or 'bad'.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    legal = F.create_map(*[F.lit(x) for s, roles in t.moves.items() for r in roles for x in (f"{s}>{r}", r)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.element_at(legal, F.concat(s, F.lit(">"), x["role"])), F.lit("bad")))

    def pieces(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.opened)), F.lit(False)),
            part(escaped(x["text"], t), x["role"].isin(*t.loss)),
            part(F.lit(t.close), F.lit(False)),
        )

    out = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), state.alias("last_state"))
    at = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def walk(acc: Column, s: Column) -> Column:
        n = F.length(s["text"]).cast("long")
        here = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return out.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.aggregate("segments", at, walk)["spans"].alias("loss_spans"),
        (~F.col("last_state").isin("bad", "start")).alias("valid"),
        "last_state",
    )


def read_chats(formatted: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """The turns (array of role and text) and the text under the loss mask, from formatted and loss_spans alone."""
    quote = lambda x: f"\\Q{x}\\E"
    shape = F.lit(f"(?s){quote(t.open)}(.*?){quote(t.opened)}(.*?){quote(t.close)}")
    roles, texts = (F.regexp_extract_all("formatted", shape, F.lit(k)) for k in (1, 2))
    turn = lambda r, x: F.struct(unescaped(r, t).alias("role"), unescaped(x, t).alias("text"))
    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")), t))
    return formatted.select("conv_id", "formatted", "valid", F.zip_with(roles, texts, turn).alias("turns"), F.array_join(under, "").alias("loss_text"))
