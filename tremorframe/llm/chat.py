"""Chat formatting by a finite-state machine over roles and a declarative template (operator 6).

The template names, for each role, the strings that open and close a turn, and the roles whose text
is learned. Any other role is written out between generic marks. Inside texts the first character of
every control string, and the escape character itself, are written as escapes, so the marks of the
output are only the template's own and a reader gets every role and text back. The output is an
array of segments, each with its loss flag; their texts joined are the formatted conversation. A
finite-state machine reads the roles in order and reports the first turn that the order forbids;
such conversations are formatted all the same.

Only built-in functions are used. A conversation is gathered in one row, as its result is one text.

Defined cases: NULL text and role count as empty. Turns are ordered by turn (NULL first), then role,
then text; repeated rows are turns of their own. NULL conv_id is a conversation of its own. An empty
table gives no rows. Columns other than conv_id, turn, role and text are never read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common


class Template(NamedTuple):
    marks: dict  # role -> (opening, closing)
    other: tuple  # (opening, between role and text, closing) of all other roles
    learned: tuple  # roles under the loss mask
    order: tuple  # "state>role" steps that the machine allows; a role is the state after it


TEMPLATE = Template(
    marks={
        "system": ("<<SYS>>", "<</SYS>>"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("<s>", "</s>"),
    },
    other=("<|role|>", "<|text|>", "<|end|>"),
    learned=("assistant",),
    order=(
        "start>system",
        "start>user",
        "system>user",
        "user>assistant",
        "assistant>user",
        "assistant>tool",
        "tool>assistant",
    ),
)
# The first characters of control strings, and the escape character, with what stands for them.
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def control_strings(template: Template) -> list[str]:
    found = [s for pair in template.marks.values() for s in pair] + list(template.other)
    if any(s[0] not in "<[" for s in found):
        raise ValueError("control strings begin with < or [")
    return found


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\[](){}|^$.*+?<>/" else c for c in text)


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for first, code in _ESCAPES[1:]:
        rest = [_quoted(s[1:]) for s in control_strings(template) if s[0] == first]
        if rest:
            text = F.regexp_replace(text, f"{_quoted(first)}(?=(?:{'|'.join(rest)}))", "\\" + code)
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _segments(turn: Column, template: Template) -> Column:
    """Segments of one turn (role, text): opening, text, closing."""

    def three(opening: Column, text: Column, closing: Column, learned: bool) -> Column:
        parts = ((opening, False), (text, learned), (closing, False))
        return F.array(*[F.struct(t.alias("text"), F.lit(flag).alias("loss")) for t, flag in parts])

    text = escape(turn["text"], template)
    opening, between, closing = template.other
    head = F.concat(F.lit(opening), escape(turn["role"], template), F.lit(between))
    out = three(head, text, F.lit(closing), False)
    for role, (begin, end) in template.marks.items():
        out = F.when(turn["role"] == role, three(F.lit(begin), text, F.lit(end), role in template.learned)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments, formatted, bad_turn of ``rows`` (conv_id, turn, role, text).

    ``bad_turn`` is the number (from 1) of the first turn that the machine rejects, else NULL.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    steps = F.array(*[F.lit(s) for s in template.order])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(at: Column, turn: Column) -> Column:
        allowed = F.array_contains(steps, F.concat(at["state"], F.lit(">"), turn["role"]))
        here = F.when(at["bad"].isNull() & ~allowed, at["n"] + 1).otherwise(at["bad"])
        return F.struct(turn["role"].alias("state"), (at["n"] + 1).alias("n"), here.alias("bad"))

    bad = F.aggregate("turns", start, step, lambda at: at["bad"])
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    out = chats.select("conv_id", segments.alias("segments"), bad.alias("bad_turn"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "segments", formatted.alias("formatted"), "bad_turn")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text) read back from formatted text by its marks alone."""
    opening, between, closing = template.other
    begins = [b for b, _ in template.marks.values()] + [opening]
    ends = [e for _, e in template.marks.values()] + [closing]
    pattern = f"(?s)(?:{'|'.join(map(_quoted, begins))}).*?(?:{'|'.join(map(_quoted, ends))})"
    found = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def one(turn: Column) -> Column:
        inner = F.substring(turn, F.lit(len(opening) + 1), F.length(turn) - len(opening) - len(closing))
        cut = F.instr(inner, between)
        role, text = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + len(between), F.length(inner))
        for name, (begin, end) in template.marks.items():
            here = turn.startswith(begin)
            own = F.substring(turn, F.lit(len(begin) + 1), F.length(turn) - len(begin) - len(end))
            role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, own).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(found, one)


_PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_PROBE}'), (-7L, 1L, 'assistant', '{_PROBE}') AS t(conv_id, turn, role, text)"
    )
    chats = format_chats(rows.unionByName(probe))
    turns = read_turns(F.col("formatted"))
    parts = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    out = chats.select("conv_id", "formatted", "bad_turn", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(parts, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("bad_turn"),
    )


QUERIES = {"op6_chat": op6_chat}


def _oracle(template: Template = TEMPLATE) -> str:
    def escaped(column: str) -> str:
        text = f"replace({column}, '\\', '\\e')"
        for first, code in _ESCAPES[1:]:
            rest = "|".join(_quoted(s[1:]) for s in control_strings(template) if s[0] == first)
            text = f"regexp_replace({text}, '{_quoted(first)}({rest})', '\\{code}\\1', 'g')"
        return text

    marks = " ".join(f"WHEN '{r}' THEN {len(b) + len(e)}" for r, (b, e) in template.marks.items())
    other = sum(map(len, template.other))
    steps = ", ".join(f"'{s}'" for s in template.order)
    learned = ", ".join(f"'{r}'" for r in template.learned)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
steps AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w, 'start') || '>' || role AS step,
         CASE role {marks} ELSE {other} + length({escaped("role")}) END + length({escaped("text")}) AS chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id {order}))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role IN ({learned})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({learned})), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       CAST(min(n) FILTER (step NOT IN ({steps})) AS INTEGER) AS bad_turn
FROM steps GROUP BY conv_id
"""


ORACLES = {"op6_chat": _oracle()}
