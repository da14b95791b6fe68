"""Preference formatting: one prompt, two masked completions.

A pair is two conversations, chosen and rejected. Their longest common prefix of
turns is rendered once as the prompt; what follows in each is its completion.
Only assistant turns are learned from: the mask lists their spans, in
characters of the rendered completion.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One rendered turn: role line, text, end line.
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order. ``turns``: conv_id, turn, role, text.

    Turns go by ``turn`` (null first), equal ones by role and text; null roles
    count as "user", null texts as empty; rows with a null conv_id belong to no
    conversation and are left out. The list is the conversation itself, so it is
    as long as the record that is asked for.
    """
    clean = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("listed")).select("conv_id", F.transform("listed", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def answers_to_compare(chats: DataFrame) -> DataFrame:
    """Pairs from plain conversations: conv_id, chosen, rejected.

    Chosen is the conversation up to its last assistant turn. Rejected answers
    the same turns with the last earlier assistant turn of another text - an
    answer to another question - or, if there is none, with an empty text.
    Conversations without an assistant turn make no pair.
    """
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t.role == "assistant", i)))
    before = F.slice("turns", F.lit(1), F.col("last"))
    answer = F.element_at("turns", (F.col("last") + 1).cast("int"))
    others = F.filter(before, lambda t: (t.role == "assistant") & (t.text != answer.text))
    other = F.when(F.size(others) > 0, F.get(others, F.size(others) - 1).text).otherwise(F.lit(""))
    found = chats.withColumn("last", last).where("last is not null")
    return found.select("conv_id", F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"), F.concat(before, F.array(F.struct(F.lit("assistant").alias("role"), other.alias("text")))).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that both lists begin with (role and text equal)."""
    most = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.array_min(differ)


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t.role, t.text)), "")


def _mask(turns: Column, part: int = 256) -> Column:
    """Spans of what assistants say, with the end mark: "from-to from-to".

    One pass that carries the length so far. What has been said is added to a
    list of its part of the turns, and those lists to the whole, so no long
    string is copied for every turn.
    """

    def add(held: Column, t: Column) -> Column:
        said = held["at"] + len(START) + 1 + F.length(t.role)
        end = said + F.length(t.text) + len(END)
        span = F.concat(F.lit(" "), said.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t.role == "assistant", F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    def add_part(held: Column, i: Column) -> Column:
        some = F.slice(turns, i * part + 1, F.lit(part))
        start = F.struct(held["at"].alias("at"), F.lit("").alias("spans"))
        return F.aggregate(some, start, add, lambda x: F.struct(x["at"].alias("at"), F.concat(held["spans"], x["spans"]).alias("spans")))

    parts = F.sequence(F.lit(0), F.floor(F.size(turns) / part).cast("int"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), add_part, lambda x: F.ltrim(x["spans"]))


def preferences(pairs: DataFrame) -> DataFrame:
    """conv_id, prompt_turns, prompt, and for each side completion and mask.

    ``pairs``: conv_id, chosen, rejected (arrays of struct<role, text>; null
    counts as an empty list). If one conversation begins the other its
    completion is empty. An empty table gives no rows; other columns are
    ignored.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("conv_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    cut = both.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    for side in ("chosen", "rejected"):
        cut = cut.withColumn(f"{side}_rest", F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0))))
    return cut.select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"),
        _text(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        *[c for side in ("chosen", "rejected") for c in (_text(F.col(f"{side}_rest")).alias(f"{side}_completion"), _mask(F.col(f"{side}_rest")).alias(f"{side}_mask"))],
    )


#: The same for DuckDB, over table ``conversations``.
SQL = f"""
WITH clean AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM clean),
last AS (SELECT conv_id, max(i) AS n FROM placed WHERE role = 'assistant' GROUP BY conv_id),
answer AS (SELECT p.conv_id, l.n, p.text FROM placed p JOIN last l ON p.conv_id = l.conv_id AND p.i = l.n),
other AS (
  SELECT a.conv_id, a.n, a.text, coalesce(arg_max(p.text, p.i), '') AS other
  FROM answer a LEFT JOIN placed p ON p.conv_id = a.conv_id AND p.i < a.n AND p.role = 'assistant' AND p.text <> a.text
  GROUP BY a.conv_id, a.n, a.text),
prompts AS (
  SELECT o.conv_id, string_agg('{START}' || p.role || chr(10) || p.text || '{END}' || chr(10), '' ORDER BY p.i) AS prompt
  FROM other o JOIN placed p ON p.conv_id = o.conv_id AND (p.i < o.n OR o.other = o.text AND p.i = o.n)
  GROUP BY o.conv_id)
SELECT o.conv_id, CAST(CASE WHEN other = text THEN n ELSE n - 1 END AS BIGINT) AS prompt_turns, coalesce(prompt, '') AS prompt,
  CASE WHEN other = text THEN '' ELSE '{START}assistant' || chr(10) || text || '{END}' || chr(10) END AS chosen_completion,
  CASE WHEN other = text THEN '' ELSE '{len(START) + 10}-' || CAST({len(START) + 10 + len(END)} + length(text) AS VARCHAR) END AS chosen_mask,
  CASE WHEN other = text THEN '' ELSE '{START}assistant' || chr(10) || other || '{END}' || chr(10) END AS rejected_completion,
  CASE WHEN other = text THEN '' ELSE '{len(START) + 10}-' || CAST({len(START) + 10 + len(END)} + length(other) AS VARCHAR) END AS rejected_mask
FROM other o LEFT JOIN prompts p ON o.conv_id = p.conv_id
"""
