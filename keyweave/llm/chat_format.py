"""Chat formatting by a declarative template (operator 1); DataFrame functions only.

A finite-state machine over roles checks the order of turns and names the first turn that breaks it. The template says
how a turn opens by its role, how every turn closes, and which roles' texts are learned. Its control strings are
escaped inside texts: a backslash becomes ``\\s`` and control string k a backslash and the k-th letter of CODES, so a text
never holds a control string and unescaping is exact. Output is the formatted conversation, and its loss mask as spans
of code points within turns, so that writing and reading it take time in proportion to the conversation;
``read_back`` parses roles and texts from the formatted string alone and the learned text by the mask.

A conversation is one row of the output, so its turns meet in one task; conversations are otherwise independent, and
rows of a conversation are few beside those of the table.

Defined results: a null text is empty, a null role the empty string; turns order by (turn, role, text), null turns
first, so ties and repeated rows have one order and all stay; a conversation in wrong order is formatted all the same,
with ``valid`` false; a null conv_id is a conversation of its own; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that stand for control strings after a backslash; s is the backslash itself.
CODES = "abcdefghijklmnopqrtuvwxyz"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns look, which are learned, and which may follow which."""

    opens: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"})
    other: tuple[str, str] = ("<<ROLE>>", "<</ROLE>>")  # around the name of any other role
    close: str = "</s>"
    glue: str = " "  # between an opening and the text, and between the text and the closing
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("asked", "answered")

    @property
    def controls(self) -> list[str]:
        """Longest first, so that one that holds another is escaped whole."""
        return sorted({*self.opens.values(), *self.other, self.close}, key=lambda c: (-len(c), c))

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}s"))
        for control, code in zip(self.controls, CODES, strict=False):
            text = F.replace(text, F.lit(control), F.lit(ESCAPE + code))
        return text

    def unescaped(self, text: Column) -> Column:
        for control, code in zip(self.controls, CODES, strict=False):
            text = F.replace(text, F.lit(ESCAPE + code), F.lit(control))
        return F.replace(text, F.lit(f"{ESCAPE}s"), F.lit(ESCAPE))

    def opening(self, role: Column) -> Column:
        found = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1]))
        for name, control in self.opens.items():
            found = F.when(role == name, F.lit(control)).otherwise(found)
        return found

    def order(self, turns: Column) -> Column:
        """The machine run over turns: (state, number of the first wrong turn or null)."""
        moves = F.create_map(*(F.lit(x) for state, by in self.moves.items() for role, to in by.items() for x in (f"{state}>{role}", to)))
        begin = F.struct(F.lit(self.start).alias("state"), F.lit(None).cast("int").alias("wrong"), F.lit(0).alias("n"))

        def step(at: Column, turn: Column) -> Column:
            to = F.try_element_at(moves, F.concat(at["state"], F.lit(">"), turn["role"]))
            wrong = F.coalesce(at["wrong"], F.when(to.isNull(), at["n"]))
            return F.struct(F.coalesce(to, at["state"]).alias("state"), wrong.alias("wrong"), (at["n"] + 1).alias("n"))

        return F.aggregate(turns, begin, step)


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) from a row for each turn."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(talks: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, loss spans, valid, wrong_turn): the segments of every turn laid end to end.

    A turn is three segments: opening and glue, the escaped text, glue and closing. Only the text of a learned role has
    the loss flag; its span is (turn, start, length): the turn's number from 0, and code points from the turn's opening on.
    """
    t = template or Template()
    glue = F.lit(t.glue)

    def segments(turn: Column) -> Column:
        head = F.concat(t.opening(turn["role"]), glue)
        return F.struct(head.alias("head"), t.escaped(turn["text"]).alias("body"), turn["role"].isin(*t.learned).alias("loss"))

    def span(s: Column, turn: Column) -> Column:
        return F.when(s["loss"], F.struct(turn.alias("turn"), F.length(s["head"]).alias("start"), F.length(s["body"]).alias("length")))

    parts = talks.select("conv_id", F.transform("turns", segments).alias("segments"), t.order(F.col("turns")).alias("order"))
    good = F.col("order.wrong").isNull() & F.col("order.state").isin(*t.ends)
    return parts.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], glue, F.lit(t.close))), "").alias("formatted"),
        F.filter(F.transform("segments", span), lambda x: x.isNotNull()).alias("loss"),
        good.alias("valid"),
        F.col("order.wrong").alias("wrong_turn"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turns of role and text, loss_text, formatted, valid) from the formatted strings and their masks."""
    t = template or Template()
    pieces = F.split("formatted", _quoted(t.close))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands behind the last closing

    def turn(piece: Column) -> Column:
        """``piece`` is opening, glue, text, glue."""
        end = 2147483647
        role = t.unescaped(F.substring_index(F.substring(piece, len(t.other[0]) + 1, end), t.other[1], 1))
        rest = F.regexp_replace(piece, f"^{_quoted(t.other[0])}(?s:.*?){_quoted(t.other[1])}", "")
        for name, control in t.opens.items():
            own = F.startswith(piece, F.lit(control))
            role = F.when(own, F.lit(name)).otherwise(role)
            rest = F.when(own, F.substring(piece, len(control) + 1, end)).otherwise(rest)
        return F.struct(role.alias("role"), rest.alias("text"))

    g = len(t.glue)
    turns = F.transform("pieces", turn)
    trimmed = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), t.unescaped(x["text"].substr(F.lit(g + 1), F.length(x["text"]) - 2 * g)).alias("text")))
    learned = F.transform("loss", lambda s: t.unescaped(F.get("pieces", s["turn"]).substr(s["start"] + 1, s["length"])))
    return formatted.withColumn("pieces", pieces).select("conv_id", trimmed.alias("turns"), F.array_join(learned, "").alias("loss_text"), "formatted", "valid", "wrong_turn")


def _quoted(text: str) -> str:
    """A Java pattern for the text itself."""
    return r"\Q" + text + r"\E"


def digests(back: DataFrame) -> DataFrame:
    """What identifies the turns and the learned text."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "wrong_turn",
    )
