"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame expressions only.

The template gives each role the control strings around its text and says whether the text is trained on. A role
that the template doesn't list is written with its name. Control strings inside texts (and role names) are
escaped: ``\\`` becomes ``\\0`` and the i-th control string ``\\i``; every backslash of an escaped text starts such
a code and no control string is left in it, so the formatted string splits at control strings without doubt and
unescapes exactly. No control string starts inside another, so none forms across the border of two pieces.

The state machine: its states are the classes of the last role (start, system, user, assistant, tool, other), and
``ALLOWED`` holds the transitions. A violation does not drop the conversation: ``valid`` is false and ``bad_turn``
is the position of the first violation. A conversation must end with an assistant turn to be valid.

The unit of the result is one conversation, whose turns meet in one row; that is what the result is.

Defined cases: a null text is empty; a null role is the role ``""``; null turns sort first; equal turn numbers are
ordered by role, then text; repeated rows are repeated turns; a null conv_id is a conversation of its own; an
empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import quoted, table


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: what stands around each role's text; other: around an unlisted role's name and text, with a middle."""

    roles: dict[str, Turn]
    other: tuple[str, str, str]
    control: tuple[str, ...]

    def __post_init__(self) -> None:
        for a in self.control:
            if "\\" in a or any(a[i:].startswith(b[: len(a) - i]) for b in self.control for i in range(1, len(a))):
                raise ValueError(f"control string {a!r} has a backslash or overlaps another")
        if len(self.control) > 9:
            raise ValueError("nine control strings at most")


TEMPLATE = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=("[ROLE]", "[SAYS]", "[/ROLE]"),
    control=("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE]", "[SAYS]", "[/ROLE]"),
)

#: Last role's class -> classes that may follow.
ALLOWED = {
    "start": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user", "tool"),
    "tool": ("assistant", "tool"),
}


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for i, c in enumerate(template.control, 1):
        out = F.replace(out, F.lit(c), F.lit(f"\\{i}"))
    return out


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    out = text
    for i, c in enumerate(template.control, 1):
        out = F.replace(out, F.lit(f"\\{i}"), F.lit(c))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def _segments(role: Column, text: Column, template: Template) -> Column:
    """The turn's pieces, each with its loss flag."""
    piece = lambda s, loss: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
    a, b, c = template.other
    out = F.array(piece(F.concat(F.lit(a), escape(role, template), F.lit(b)), False), piece(escape(text, template), False), piece(F.lit(c), False))
    for name, t in template.roles.items():
        own = F.array(piece(F.lit(t.before), False), piece(escape(text, template), t.loss), piece(F.lit(t.after), False))
        out = F.when(role == name, own).otherwise(out)
    return out


def _first_violation(roles: Column) -> Column:
    """0-based position of the first turn the machine refuses; the number of turns if it doesn't end on an assistant; else null."""
    known = [k for k in ALLOWED if k != "start"]
    state = F.transform(roles, lambda r: F.when(r.isin(*known), r).otherwise(F.lit("other")))
    before = F.concat(F.array(F.lit("start")), state)
    pairs = F.zip_with(state, F.slice(before, F.lit(1), F.size(state)), lambda now, last: F.concat(last, F.lit(">"), now).isin(*[f"{a}>{b}" for a, to in ALLOWED.items() for b in to]))
    at = F.array_position(pairs, F.lit(False))
    return F.when(at > 0, at - 1).when(F.element_at(state, -1) != "assistant", F.size(state).cast("long"))


def format_conversations(turns: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss), valid, bad_turn."""
    rows = turns.select(quoted(conv).alias("conv_id"), F.struct(quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    talks = talks.withColumn("segments", F.flatten(F.transform("ts", lambda t: _segments(t["role"], t["text"], template))))
    bad = _first_violation(F.transform("ts", lambda t: t["role"]))
    return talks.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", bad.isNull().alias("valid"), bad.alias("bad_turn"))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array of (role, text, loss), parsed from the formatted string alone."""
    esc = lambda s: re.sub(r"([\\\[\](){}.*+?^$|<>/-])", r"\\\1", s)
    a, b, c = template.other
    shapes = [esc(t.before) + ".*?" + esc(t.after) for t in template.roles.values()] + [esc(a) + ".*?" + esc(c)]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def turn(s: Column) -> Column:
        made = lambda role, text, loss: F.struct(role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"))
        inner = F.substring(s, F.lit(len(a) + 1), F.length(s) - len(a) - len(c))
        cut = F.instr(inner, b)
        out = made(unescape(F.substring(inner, F.lit(1), cut - 1), template), unescape(F.substring(inner, cut + len(b), F.length(inner)), template), False)
        for name, t in template.roles.items():
            text = unescape(F.substring(s, F.lit(len(t.before) + 1), F.length(s) - len(t.before) - len(t.after)), template)
            out = F.when(s.startswith(t.before), made(F.lit(name), text, t.loss)).otherwise(out)
        return out

    return F.transform(found, turn)


def with_escape_case(turns: DataFrame) -> DataFrame:
    """conversations and conversation -7, both of whose turns say control strings of the template."""
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from what was written."""
    back = formatted.withColumn("turns", read_back(F.col("formatted"), template))
    trained = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).withColumn("trained", trained).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_conversations(with_escape_case(table(spark, sf_dir, "conversations"))))


def _oracle() -> str:
    esc = "replace(text, '\\', '\\0')"
    for i, c in enumerate(TEMPLATE.control, 1):
        esc = f"replace({esc}, '{c}', '\\{i}')"
    around = " ".join(f"WHEN '{r}' THEN {len(t.before) + len(t.after)}" for r, t in TEMPLATE.roles.items())
    allowed = ", ".join(f"'{a}>{b}'" for a, to in ALLOWED.items() for b in to)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role AS step,
         length({esc}) + CASE role {around} END AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(step IN ({allowed})) AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM f GROUP BY conv_id
"""


ORACLE = _oracle()
