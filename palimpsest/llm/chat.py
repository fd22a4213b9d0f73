"""Chat formatting by a declarative template; DataFrame functions only.

A finite-state machine over roles checks the order of turns. Each turn becomes segments: the opening mark, the text with
control strings escaped, the closing mark; the template says by role whether the text bears loss. Escaping puts one
more `~` behind the first character of what reads as a control string (with or without such marks already), so it can be
undone exactly and no text holds a control string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Mark:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """marks by role; other: how a role without marks is written, between the first two strings and then the text.
    order: the machine's transitions, from a state and a role to a state; a missing one is an error. final: states in
    which a conversation is complete."""

    marks: dict[str, Mark] = field(default_factory=lambda: {
        "system": Mark("<<SYS>>", "<</SYS>>"),
        "user": Mark("[INST]", "[/INST]"),
        "assistant": Mark("<s>", "</s>", loss=True),
    })
    role: Mark = Mark("<<ROLE>>", "<</ROLE>>")
    other: Mark = Mark("[TEXT]", "[/TEXT]")
    order: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        tails = {c[1:] for c in self.controls()}
        heads = {c[0] for c in self.controls()}
        for c in self.controls():
            for i in range(1, len(c)):
                if c[i] in heads and any(c[i + 1 :].startswith(t[: len(c) - i - 1]) and t.startswith(c[i + 1 :][: len(t)]) for t in tails):
                    raise ValueError(f"control strings overlap within {c!r}")
        if "~" in "".join(self.controls()):
            raise ValueError("control strings may not hold ~")

    def controls(self) -> list[str]:
        return [x for m in (*self.marks.values(), self.role, self.other) for x in (m.open, m.close)]

    def tails(self) -> str:
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls()}))
        tails = "|".join(sorted({re.escape(c[1:]) for c in self.controls()}))
        return f"[{heads}]", f"({tails})"

    def escape(self, text: Column) -> Column:
        head, tail = self.tails()
        return F.regexp_replace(text, f"({head})(~*){tail}", "$1~$2$3")

    def unescape(self, text: Column) -> Column:
        head, tail = self.tails()
        return F.regexp_replace(text, f"({head})~(~*){tail}", "$1$2$3")

    def turn_pattern(self) -> str:
        q = lambda m: f"{re.escape(m.open)} .*? {re.escape(m.close)}"
        role = f"{re.escape(self.role.open)}.*?{re.escape(self.role.close)}"
        return "(?s)" + "|".join([*map(q, self.marks.values()), role + q(self.other)])


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid (the order of roles), complete (ends in a final state), error_turn
    (position of the first turn out of order, or null), formatted, loss_spans (start and length in code points).

    Rows go by turn, then role and text. Null texts count as empty, null roles as the role ''; a null conv_id is one
    conversation, null turns come first, and repeated rows are turns of their own. Conversations out of order are
    formatted too. An empty table gives an empty result; other columns are ignored. A conversation is one row of the
    result, so its turns, of any length and number, meet in one task: they, and no others.
    """
    t = template or Template()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def by_role(mark, other: Column) -> Column:
        out = F
        for role, m in t.marks.items():
            out = out.when(F.col("role") == role, F.lit(mark(m)))
        return out.otherwise(other)

    opening = by_role(lambda m: m.open + " ", F.concat(F.lit(t.role.open), t.escape(F.col("role")), F.lit(t.role.close + t.other.open + " ")))
    closing = by_role(lambda m: " " + m.close, F.lit(" " + t.other.close))
    bears = F.col("role").isin([r for r, m in t.marks.items() if m.loss] or [None])
    cut = rows.withColumn("open", opening).withColumn("close", closing).withColumn("body", t.escape(F.col("text")))
    # where a segment begins is a running sum over the turns before it
    so_far = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    size = F.char_length("open").cast("long") + F.char_length("body") + F.char_length("close")
    cut = cut.withColumn("end", F.sum(size).over(so_far)).withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    span = F.struct((F.col("end") - F.char_length("body") - F.char_length("close")).cast("int").alias("start"), F.char_length("body").alias("length"))
    segment = F.struct("at", "role", F.concat("open", "body", "close").alias("text"), F.when(bears, span).alias("span"))
    whole = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"))

    def step(a: Column, x: Column) -> Column:
        state = None
        for (at, role), to in t.order.items():
            state = (F if state is None else state).when((a["state"] == at) & (x["role"] == role), F.lit(to))
        state = state.otherwise(F.lit("error"))
        return F.struct(F.when(a["state"] == "error", a["state"]).otherwise(state).alias("state"), (a["n"] + F.when(a["state"] == "error", 0).otherwise(1)).alias("n"))

    machine = F.aggregate("segments", F.struct(F.lit("start").alias("state"), F.lit(0).alias("n")), step)
    spans = F.filter(F.transform("segments", lambda s: s["span"]), lambda s: s.isNotNull())
    return whole.withColumn("machine", machine).select(
        "conv_id", F.size("segments").cast("long").alias("n_turns"),
        (F.col("machine.state") != "error").alias("valid"), F.col("machine.state").isin(list(t.final)).alias("complete"),
        F.when(F.col("machine.state") == "error", F.col("machine.n") - 1).alias("error_turn"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns (role, text: parsed from the formatted text), loss_texts (what lies under the loss mask, unescaped),
    with the other columns of format_conversations()."""
    t = template or Template()

    def inner(x: Column, m: Mark, skip: Column | int = 0) -> Column:
        begin = F.lit(len(m.open) + 2) + skip
        return t.unescape(F.substring(x, begin, F.char_length(x) - begin - len(m.close)))

    def role_end(x: Column) -> Column:
        return F.instr(x, t.role.close)

    def parsed(x: Column) -> Column:
        out = None
        for role, m in t.marks.items():
            out = (F if out is None else out).when(F.startswith(x, F.lit(m.open + " ")), F.struct(F.lit(role).alias("role"), inner(x, m).alias("text")))
        n = len(t.role.open)
        name = t.unescape(F.substring(x, F.lit(n + 1), role_end(x) - n - 1))
        return out.otherwise(F.struct(name.alias("role"), inner(x, t.other, role_end(x) + len(t.role.close) - 1).alias("text")))

    found = F.regexp_extract_all("formatted", F.lit(t.turn_pattern()), F.lit(0))
    loss = F.transform("loss_spans", lambda s: t.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("found", found).withColumn("turns", F.transform("found", parsed)).withColumn("loss_texts", loss).drop("found")


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and SHA-256 digests of what read_back() finds."""
    loss = F.array_join("loss_texts", "")
    return read_back(formatted, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
