"""Preference pairs: a shared prompt and two masked completions (operator 2). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _spans(turns: Column, target: str) -> Column:
    """Where the loss counts in the rendered turns: [start, end) of each target turn's text and end mark, in characters."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        size = F.length(_turn(t)).cast("long")
        head = F.length(F.coalesce(t["role"], F.lit(""))).cast("long") + 5
        span = F.struct((acc["at"] + head).alias("start"), (acc["at"] + size).alias("end"))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["role"] == target, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, target: str = "assistant") -> DataFrame:
    """Per pair: pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``turns`` (turn, role, text) are those of both conversations of a pair; ``pair`` names the pair
    (null: dropped, as such a row belongs to none), ``chosen`` says which of the two a row is of.
    The prompt is the longest common prefix of turns (equal role and text, nulls equal to nulls),
    rendered once; a completion is the rest of its conversation, and its spans mark the ``target``
    turns in it; nothing in the prompt counts. A missing side is an empty conversation; equal
    conversations have empty completions. Turns with one number are ordered by role and text.

    Repeated rows are turns like any other; texts of any length are taken whole; other columns are
    ignored, whatever their names; no turns: no rows. One shuffle, by pair; what a task must hold is
    one pair, which is also one row of the result.
    """
    turn = F.struct("turn", "role", "text")
    side = lambda which: F.array_sort(F.collect_list(F.when(which, turn)))
    both = turns.select("turn", "role", "text", pair.cast("long").alias("pair_id"), chosen.alias("_chosen")).where("pair_id is not null").groupBy("pair_id").agg(side(F.col("_chosen")).alias("c"), side(~F.col("_chosen")).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    at = F.array_position(same, F.lit(False))
    both = both.withColumn("n", F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select("pair_id", "prompt_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _spans(F.col("c"), target).alias("chosen_spans"), _spans(F.col("r"), target).alias("rejected_spans"))


#: Two neighbouring conversations are a pair: the even one is the chosen one.
SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i,
         c.i IS NOT NULL AND r.i IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM (SELECT * FROM t WHERE is_chosen) c FULL JOIN (SELECT * FROM t WHERE NOT is_chosen) r ON c.pair_id = r.pair_id AND c.i = r.i),
n AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS n FROM m GROUP BY pair_id),
w AS (SELECT *, sum(CASE WHEN i > n THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, is_chosen ORDER BY i) AS upto FROM t JOIN n USING (pair_id))
SELECT pair_id, any_value(n)::BIGINT AS prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE is_chosen AND i <= n), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE is_chosen AND i > n), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > n), '') AS rejected,
       coalesce(string_agg((upto - length(shown) + length(role) + 5)::BIGINT || '-' || upto::BIGINT, ',' ORDER BY i) FILTER (WHERE is_chosen AND i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((upto - length(shown) + length(role) + 5)::BIGINT || '-' || upto::BIGINT, ',' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM w GROUP BY pair_id
"""
