"""Chat formatting: a finite-state machine over roles validates turn order; a declarative template emits segments with loss flags. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """Strings around a role's text, and whether the text itself is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turn marks by role, the other roles' marks, and the allowed steps from role to role ("" is the start)."""

    marks: dict[str, Mark] = field(
        default_factory=lambda: {
            "system": Mark("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Mark("[INST] ", " [/INST]"),
            "assistant": Mark("<s>", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("<|", "|>", "<|end|>")
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")


LLAMA = Template()


def escape(text: Column, template: Template = LLAMA) -> Column:
    """Put a backslash inside each control string and double every backslash; `unescape` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Segments of every turn: conv_id, turn, n (turn's place in its conversation), part, role, text, loss, step_ok.

    Parts are 0 the mark before, 1 the escaped text (under the loss mask where the role is trained on),
    2 the mark after. step_ok says whether the machine allows the role after the one before it; a role
    without marks gets the marks of `other` and is never allowed.

    Null text and null role are empty strings. Turns are ordered by turn, ties by role, then text; a null
    turn comes first. Repeated rows are turns of their own. A null conv_id is one conversation. An empty
    table gives no segments. Other columns are ignored.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.withColumns({"n": F.row_number().over(w).cast("long"), "previous": F.lag("role", 1, "").over(w)})
    allowed = F.lit(False)
    for before, after in template.steps.items():
        at = (F.col("n") == 1) if before == "" else (F.col("n") > 1) & (F.col("previous") == before)
        allowed = allowed | (at & F.col("role").isin(*after))
    opening = F.concat(F.lit(template.other[0]), escape(F.col("role"), template), F.lit(template.other[1]))
    closing, loss = F.lit(template.other[2]), F.lit(False)
    for role, mark in template.marks.items():
        opening = F.when(F.col("role") == role, mark.before).otherwise(opening)
        closing = F.when(F.col("role") == role, mark.after).otherwise(closing)
        loss = F.when(F.col("role") == role, mark.loss).otherwise(loss)
    parts = F.array(
        F.struct(F.lit(0).alias("part"), opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text"), template).alias("text"), loss.alias("loss")),
        F.struct(F.lit(2).alias("part"), closing.alias("text"), F.lit(False).alias("loss")),
    )
    return c.select("conv_id", "turn", "n", "role", allowed.alias("step_ok"), F.inline(parts)).select("conv_id", "turn", "n", "part", "role", "text", "loss", "step_ok")


def conversations_of(segments: DataFrame, template: Template = LLAMA) -> DataFrame:
    """One row per conversation: formatted text, the text under the loss mask, and whether the machine accepts it."""
    got = F.sort_array(F.collect_list(F.struct("n", "part", "text", "loss")))
    by = segments.groupBy("conv_id").agg(got.alias("segments"), F.min(F.col("step_ok")).alias("steps_ok"), F.max_by("role", "n").alias("last_role"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return by.select("conv_id", text.alias("formatted"), trained.alias("trained"), (F.col("steps_ok") & F.col("last_role").isin(*template.last)).alias("valid"))


def turns_of(formatted: Column, template: Template = LLAMA) -> Column:
    """Turns read back from formatted text: array of struct(role, text)."""
    o = template.other
    ways = [f"{re.escape(m.before)}.*?{re.escape(m.after)}" for m in template.marks.values()] + [f"{re.escape(o[0])}.*?{re.escape(o[1])}.*?{re.escape(o[2])}"]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(ways)), F.lit(0))

    def turn(t: Column) -> Column:
        name = F.substring_index(F.substr(t, F.lit(len(o[0]) + 1)), o[1], 1)
        role, start, end = unescape(name), F.length(name) + len(o[0]) + len(o[1]), F.lit(len(o[2]))
        for r, m in template.marks.items():
            here = F.startswith(t, F.lit(m.before))
            role, start, end = F.when(here, r).otherwise(role), F.when(here, len(m.before)).otherwise(start), F.when(here, len(m.after)).otherwise(end)
        return F.struct(role.alias("role"), unescape(F.substr(t, start + 1, F.length(t) - start - end)).alias("text"))

    return F.transform(found, turn)


def op5(spark, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{own}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{own}'")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), "turn", "role", "text").unionByName(extra)
    c = conversations_of(format_chat(rows)).withColumn("turns", turns_of(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
           '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '<|', '<\|'), '|>', '|\>') AS safe,
         lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE length(role) + 11 END)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN previous IN ('system', 'assistant') THEN role = 'user'
                     WHEN previous = 'user' THEN role = 'assistant' ELSE false END) AND arg_max(role, n) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""
