"""Preference pairs from chosen and rejected conversations.

The longest common turn prefix of the two conversations is rendered once, as
the prompt; what is left of each is its completion, with the character spans
that a loss may look at (the assistant's text and its end marker).  All of it
is Spark SQL on arrays of turns; conversations meet by two equi-joins, so no
group of conversations is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its turns in order (ties by role, then text; nulls first)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long"), text("role"), text("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _common(a: str, b: str) -> Column:
    """Number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def _header(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    """The turns' text, each with its header and end marker."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def mask(turns: Column, role: str = "assistant") -> Column:
    """``start-end`` character spans of that role's text and end marker, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(_header(t))
        end = body + F.length(t["text"]) + len(END)
        span = F.concat_ws("-", body.cast("string"), end.cast("string"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair whose two conversations exist.

    Takes ``turns(conv_id, turn, role, text)`` and ``pairs(pair_id, chosen_id,
    rejected_id)``; other columns are ignored.  Returns ``pair_id, chosen_id,
    rejected_id, n_common, prompt, chosen, rejected, chosen_mask,
    rejected_mask``.  Null roles and texts are empty; turns without a
    conversation are left out, and so are pairs with a null or unknown side.
    Equal conversations have empty completions and masks; without a common turn
    the prompt is empty.  Repeated turns stay, each in its place.
    """
    convs = conversations(turns)
    side = lambda name: convs.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id")
    both = both.withColumn("n_common", _common("chosen", "rejected"))
    rest = {c: F.slice(c, F.col("n_common") + 1, F.size(c)) for c in ("chosen", "rejected")}
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *(render(rest[c]).alias(c) for c in rest), *(mask(rest[c]).alias(f"{c}_mask") for c in rest),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs each even ``conv_id`` (chosen) with the next odd one (rejected)."""
    pair = turns.where("conv_id is not null").select(F.floor(F.col("conv_id").cast("long") / 2).alias("pair_id")).distinct()
    return pair.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))


SQL = """
WITH convs AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), both_sides AS (
  SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.t AS ta, b.t AS tb
  FROM convs a JOIN convs b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1
), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(ta), len(tb)) + 1), lambda i: ta[i] IS DISTINCT FROM tb[i])) - 1, len(ta)) AS n
  FROM both_sides
), sides AS (
  SELECT *, ta[1:n] AS tp, ta[n + 1:] AS ca, tb[n + 1:] AS cb FROM cut
), shown AS (
  SELECT *, list_transform(tp, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rp,
    list_transform(ca, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS ra,
    list_transform(cb, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rb
  FROM sides
), placed AS (
  SELECT *, list_transform(range(1, len(ra) + 1), lambda i: coalesce(list_sum(list_transform(ra[1:i], lambda s: length(s))), 0)::BIGINT) AS ea,
    list_transform(range(1, len(rb) + 1), lambda i: coalesce(list_sum(list_transform(rb[1:i], lambda s: length(s))), 0)::BIGINT) AS eb
  FROM shown
)
SELECT pair_id, chosen_id, rejected_id, n::INT AS n_common, array_to_string(rp, '') AS prompt,
  array_to_string(ra, '') AS chosen, array_to_string(rb, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(ca) + 1), lambda i: ca[i].role = 'assistant'), lambda i: (ea[i] - length(ca[i].text) - 8)::BIGINT || '-' || ea[i]), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(cb) + 1), lambda i: cb[i].role = 'assistant'), lambda i: (eb[i] - length(cb[i].text) - 8)::BIGINT || '-' || eb[i]), ',') AS rejected_mask
FROM placed
"""
