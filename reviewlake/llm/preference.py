"""Preference formatting in DataFrame functions alone.

The chosen and the rejected conversation of a pair share their first turns up to the first that differs. This longest
common prefix is rendered once as the prompt; what follows it on each side becomes a completion, in segments that say
whether they are trained on: the words of the assistant and the mark that ends its turn are, all else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, BETWEEN, END = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns``, an array of (turn, role, text) in order.

    Null turn numbers come first, equal ones are ordered by role and text, repeated rows stay. Null roles and texts are
    empty. Rows without ``conv_id`` belong to no conversation and are left out. Other columns are not looked at.
    """
    row = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    known = turns.where(F.col("conv_id").isNotNull()).select("conv_id", row.alias("row"))
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns, equal in role and text, that both arrays begin with."""
    n = F.least(F.size(chosen), F.size(rejected))
    said = lambda t: F.struct(t["role"], t["text"])
    same = F.zip_with(F.slice(chosen, 1, n), F.slice(rejected, 1, n), lambda a, b: said(a).eqNullSafe(said(b)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n.cast("long")).otherwise(first - 1).cast("int")


def rendered(turns: Column, start: str = START, between: str = BETWEEN, end: str = END) -> Column:
    """One text for all turns."""
    role, text = (lambda t, k=k: F.coalesce(t[k], F.lit("")) for k in ("role", "text"))
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(start), role(t), F.lit(between), text(t), F.lit(end))), ""
    )


def segments(turns: Column, start: str = START, between: str = BETWEEN, end: str = END) -> Column:
    """Two segments (text, trained) for each turn: its head, and its words with the end mark."""
    role, text = (lambda t, k=k: F.coalesce(t[k], F.lit("")) for k in ("role", "text"))
    part = lambda words, trained: F.struct(words.alias("text"), trained.alias("trained"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                part(F.concat(F.lit(start), role(t), F.lit(between)), F.lit(False)),
                part(F.concat(text(t), F.lit(end)), role(t) == "assistant"),
            ),
        )
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, prompt_turns, prompt, chosen, rejected`` for rows of ``pair_id`` and two arrays of turns.

    ``chosen`` and ``rejected`` of ``pairs`` hold structs with ``role`` and ``text``; the results of these names hold
    segments (text, trained). A null conversation is empty. Equal sides, and a side that is a beginning of the other,
    leave an empty completion. Null ``pair_id`` and repeated rows give a row each; other columns are not looked at.
    """
    kind = "array<struct<role:string,text:string>>"
    said = lambda c: F.coalesce(F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.from_json(F.lit("[]"), kind))
    both = pairs.select("pair_id", said(F.col("chosen")).alias("c"), said(F.col("rejected")).alias("r"))
    counted = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return counted.select(
        "pair_id", F.col("n").alias("prompt_turns"), rendered(F.slice(F.col("c"), 1, F.col("n"))).alias("prompt"),
        segments(rest(F.col("c"))).alias("chosen"), segments(rest(F.col("r"))).alias("rejected"),
    )


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """A pair from each conversation: as it is up to its last reply, against the same with a stale reply in its place.

    The stale reply is the assistant's one before, or empty where there is none. A conversation without a reply is
    paired with itself.
    """
    convs = conversations(turns).withColumn("said", F.filter("turns", lambda t: t["role"] == "assistant"))
    places = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))
    last = F.when(F.size("said") == 0, F.size("turns")).otherwise(F.array_max(places))
    stale = F.when(F.size("said") > 1, F.element_at("said", -2)["text"]).otherwise("")
    cut = convs.withColumn("chosen", F.slice("turns", F.lit(1), last))
    reply = F.struct(F.lit(None).cast("long").alias("turn"), F.lit("assistant").alias("role"), stale.alias("text"))
    other = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(reply))
    return cut.select(
        F.col("conv_id").alias("pair_id"), "chosen", F.when(F.size("said") == 0, F.col("chosen")).otherwise(other).alias("rejected")
    )


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    pairs = format_preferences(stale_reply_pairs(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.when(s["trained"], "+").otherwise("-"), F.length(s["text"]).cast("string"))), " ")
    return pairs.select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", text(F.col("chosen")).alias("chosen"),
        mask(F.col("chosen")).alias("chosen_mask"), text(F.col("rejected")).alias("rejected"),
        mask(F.col("rejected")).alias("rejected_mask"),
    )


OP7_SQL = """
WITH convs AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), said AS (
  SELECT conv_id, turns, list_filter(turns, lambda t: t.role = 'assistant') AS replies,
         coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), len(turns)) AS last
  FROM convs
), pairs AS (
  SELECT conv_id, turns[:last] AS c,
         CASE WHEN len(replies) = 0 THEN turns
              ELSE list_append(turns[:last - 1], {'role': 'assistant',
                   'text': CASE WHEN len(replies) > 1 THEN replies[-2].text ELSE '' END}) END AS r
  FROM said
), counted AS (
  SELECT conv_id, c, r, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i] <> r[i])) - 1, len(c)) AS n FROM pairs
)
SELECT conv_id, n::INTEGER AS prompt_turns,
  array_to_string(list_transform(c[:n], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(c[n + 1:], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS chosen,
  array_to_string(list_transform(c[n + 1:], lambda t: '-' || (length(t.role) + 13) || ' ' || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END || (length(t.text) + 11)), ' ') AS chosen_mask,
  array_to_string(list_transform(r[n + 1:], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS rejected,
  array_to_string(list_transform(r[n + 1:], lambda t: '-' || (length(t.role) + 13) || ' ' || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END || (length(t.text) + 11)), ' ') AS rejected_mask
FROM counted
"""
