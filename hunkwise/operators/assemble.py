"""Tables of text blocks as whole texts, without gathering the blocks of a group in one task.

Blocks are joined in runs of RUN neighbours, wherever the runs lie, and the runs of a text are joined at the end. A text beyond
``part_chars`` characters comes as several parts, cut between runs and put together independently: a window only sees run lengths
of such texts. Nothing is dropped; parts in order, joined by the separator, are the text. Ordinary texts are one part.

A text of one run is finished with it: only texts of several runs move a second time, and none meets the cuts where no text is long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.operators.ranking import hot_groups, split_hot
from hunkwise.session import stage

RUN = 64
#: Texts of several runs whose keys are broadcast to tell them from the others; beyond it all runs are grouped again.
SEVERAL_ROWS = 1_000_000
PART_CHARS = 1 << 24


def _in_order(order: str, text: str, separator: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(text, F.lit("")).alias("text"))))
    return F.array_join(F.transform(pieces, lambda p: p["text"]), separator)


def assemble(blocks: DataFrame, keys: list[str], order: str, text: str, separator: str = "\n", part_chars: int = PART_CHARS) -> DataFrame:
    """``keys``, ``part`` (from 0), ``n_parts`` and ``text``. ``order`` numbers the blocks of a group from 0 without gaps; a null text
    counts as an empty block."""
    runs = blocks.select(*keys, F.floor(F.col(order) / RUN).alias("run"), F.col(order).alias("at"), F.col(text).alias("text"))
    runs = runs.groupBy(*keys, "run").agg(_in_order("at", "text", separator).alias("text"))
    runs = stage(runs.withColumn("chars", F.length("text") + len(separator)), "text-runs")
    sizes = runs.select(*keys, "run", "chars")
    per_text = sizes.groupBy(*keys).agg(F.sum("chars").alias("n_chars"), F.count(F.lit(1)).alias("n_runs")).where("n_runs > 1")
    n_several, n_long = per_text.agg(F.count(F.lit(1)), F.count_if(F.col("n_chars") > part_chars)).first()
    if 0 < n_several <= SEVERAL_ROWS:
        several = hot_groups(sizes, keys, 1)
        single, runs = split_hot(runs, several, keys, "left_anti"), split_hot(runs, several, keys, "inner")
    elif not n_several:
        single, runs = runs, None
    else:
        single = None
    parts = []
    if single is not None:
        parts.append(single.select(*keys, F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.col("text").alias(text)))
    if runs is not None:
        placed = _placed(runs, sizes, per_text, keys, part_chars) if n_long else runs.withColumns({"part": F.lit(0), "n_parts": F.lit(1)})
        parts.append(placed.groupBy(*keys, "part", "n_parts").agg(_in_order("run", "text", separator).alias(text)))
    return reduce(DataFrame.unionByName, parts)


def _placed(runs: DataFrame, sizes: DataFrame, per_text: DataFrame, keys: list[str], part_chars: int) -> DataFrame:
    """Runs with the part they belong to; those of ordinary texts are part 0 of 1."""
    long = per_text.where(F.col("n_chars") > part_chars).select(*keys)
    before = F.coalesce(F.sum("chars").over(W.partitionBy(*keys).orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = sizes.join(long, keys, "left_semi").select(*keys, "run", F.floor(before / part_chars).alias("share"))
    cuts = cuts.withColumn("part", F.dense_rank().over(W.partitionBy(*keys).orderBy("share")) - 1)
    cuts = cuts.withColumn("n_parts", F.max("part").over(W.partitionBy(*keys)) + 1).drop("share")
    return runs.join(cuts, [*keys, "run"], "left").withColumns({"part": F.coalesce("part", F.lit(0)), "n_parts": F.coalesce("n_parts", F.lit(1))})
