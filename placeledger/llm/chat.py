"""Chat formatting: conversations become one text each, by a declarative template, with a loss flag for each segment.

Only built-in functions are used. A finite-state machine over the roles checks the order of the turns; control strings
inside texts are escaped in a way that can be undone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are learned from, and which role may follow which state."""

    turn_open: str = "<s>"
    turn_close: str = "</s>\n"
    #: Strings that must not occur in a text; none may contain the escape character or begin inside another.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: The state after a turn is its role.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for mark in (self.turn_open, self.turn_close.rstrip("\n")):
            if mark not in self.controls:
                raise ValueError(f"{mark} marks a turn and must be one of the controls")
        if any(ESCAPE in c or len(c) < 2 for c in self.controls):
            raise ValueError("a control has two characters at least and no escape character")


def escape(text: Column, template: Template) -> Column:
    """The escape character is doubled, and put after the first character of each control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    pattern = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(doubled, pattern, re.escape(ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, segments, first_error): one row for each conversation, whatever the order of its roles.

    ``segments`` are texts with a loss flag whose concatenation is ``formatted``; the flag is set on the texts of the roles
    to learn from, without their marks. ``first_error`` is the number (from 0) of the first turn whose role may not follow
    what was before, the number of turns if the conversation ends early, null if it is in order.

    Turns are ordered by ``turn`` (null first), equal ones by role and text; repeated rows are turns of their own. A null text
    or role is empty. Rows with a null conv_id are one conversation. Other columns are not read.
    """
    t = template or Template()
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # What a turn becomes depends on it alone, so it is made before the shuffle.
    header = F.replace(escape(F.col("role"), t), F.lit("\n"), F.lit(ESCAPE + "\n"))
    made = rows.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(t.turn_open), header, F.lit("\n")).alias("head"), escape(F.col("text"), t).alias("body"),
    )
    grouped = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    allowed = F.array(*[F.lit(f"{state}\n{role}") for state, roles in t.follows.items() for role in roles])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error"))
    walked = F.aggregate("turns", start, lambda s, x: F.struct(
        x["role"].alias("state"), (s["n"] + 1).alias("n"),
        F.when(s["error"].isNull() & ~F.array_contains(allowed, F.concat(s["state"], F.lit("\n"), x["role"])), s["n"]).otherwise(s["error"]).alias("error"),
    ))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(x["body"].alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.turn_close).alias("text"), F.lit(False).alias("loss")),
    )))
    return (
        grouped.select("conv_id", segments.alias("segments"), walked.alias("walked"))
        .select(
            "conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments",
            F.coalesce(F.col("walked.error"), F.when(~F.col("walked.state").isin(*t.ends), F.col("walked.n"))).cast("long").alias("first_error"),
        )
    )


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    t = template or Template()
    parts = F.split(formatted, re.escape(t.turn_close.rstrip("\n")) + r"\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    head = rf"(?s)\A{re.escape(t.turn_open)}([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text"),
    ))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and digests of the turns and of the text to learn from, read from the formatted texts and their segments."""
    turns = parse_formatted(F.col("formatted"), template)
    learned = unescape(F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: x["text"]), ""))
    read = formatted.select("conv_id", "first_error", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "first_error",
    )
