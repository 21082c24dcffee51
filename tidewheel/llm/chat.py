r"""Chat formatting from a declarative template, with DataFrame functions only.

A template names the control strings, the roles under the loss and a finite-state machine over
roles. Inside roles and texts, ``<``, any number of backslashes and ``|`` get one more backslash,
so no control string (all begin with ``<|``) can occur there, and taking one away restores them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import literal_rows, read_table


@dataclass(frozen=True)
class Template:
    """Control strings must begin with ``<|``. ``moves``: (state, role, next state); a role without a move leads to ``error``."""

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accept: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for mark in (self.turn, self.body, self.close):
            if not mark.startswith("<|") or mark.count("<|") > 1:
                raise ValueError(f"a control string begins with <| and has no other: {mark!r}")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _step(t: Template, state: Column, role: Column) -> Column:
    out = F.lit("error")
    for was, by, then in t.moves:
        out = F.when((state == was) & (role == by), then).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: segments array<struct<text, loss>>, formatted (their concatenation), valid, state.

    A null role or text counts as empty. Turns go by turn (null first), then role, then text, so
    repeated rows are kept in a defined order. A null conv_id is a conversation of its own.
    A conversation that the state machine refuses is formatted all the same, with valid = false.
    An empty table gives an empty result; other columns are ignored. A conversation is one row of
    output, so its turns meet in one task; different conversations are spread by conv_id.
    """
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.turn), escape(x["role"]), F.lit(t.body))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    state = F.aggregate("turns", F.lit(t.start), lambda s, x: _step(t, s, x["role"]))
    return (
        chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("state"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("valid", F.col("state").isin(*t.accept))
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    mark = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    parts = F.filter(F.split(formatted, mark(template.turn)), lambda part, i: i > 0)

    def turn(part: Column) -> Column:
        two = F.split(part, mark(template.body))
        text = F.substring_index(two[1], template.close, 1)
        return F.struct(unescape(two[0]).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -7, read back from their formatted form."""
    odd = r"\### Assistant: </turn> ok"
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = literal_rows(spark, "conv_id long, turn long, role string, text string", [(-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    chats = format_chats(table.unionByName(extra))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", "valid", loss.alias("loss_text"), read_turns(F.col("formatted")).alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN role = 'system' THEN before IS NULL AND after IS NOT NULL
                WHEN role = 'user' THEN (before IS NULL OR before IN ('system', 'assistant')) AND after IS NOT NULL
                WHEN role = 'assistant' THEN before IS NOT NULL AND before = 'user'
                ELSE false END) AS valid
FROM p GROUP BY conv_id
"""
