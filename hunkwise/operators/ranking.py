"""Row numbers inside groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a group that one task numbers as a whole; a larger group is numbered bucket by bucket.
HOT_ROWS = 65_536


def rank_in_group(df: DataFrame, group: list[str], buckets: dict[str, Column], order: list, out: str, hot_rows: int = HOT_ROWS,
                  keep_unranked: bool = False) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without gathering a large group in one task.

    ``buckets`` cut a group into ordered pieces: the order by (bucket columns, ``order``) must be the wanted
    order. Groups of up to ``hot_rows`` rows are numbered whole. Those of a larger group are numbered inside their bucket; bucket
    sizes come from a pre-aggregation, and a running sum over the group's bucket rows gives each bucket its offset. The list of
    large groups is broadcast: it has at most one row per ``hot_rows`` rows of ``df``. Rows move once, with no column but a group's
    bucket beside their own. ``df`` is read twice, so one that is costly should be staged.

    Rows with a null in the group or in a bucket are counted in the order and left out of the result, or, with
    ``keep_unranked``, kept without a number.
    """
    names = list(buckets)
    hot = hot_groups(df, group, hot_rows)
    rows = split_hot(df, hot, group, "left").withColumns({n: F.when(F.col("group_hot"), b) for n, b in buckets.items()}).drop("group_hot")
    sizes = split_hot(df, hot, group, "inner").withColumns(buckets).groupBy(*group, *names).agg(F.count(F.lit(1)).alias("bucket_rows"))
    before = W.partitionBy(*group).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, *names, F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("bucket_offset")
    )
    inside = W.partitionBy(*group, *names).orderBy(*buckets.values(), *order)
    local = rows.withColumn("bucket_rank", F.row_number().over(inside))
    numbered = local.join(offsets, [*group, *names], "left").withColumn(
        out, (F.col("bucket_rank") + F.coalesce("bucket_offset", F.lit(0))).cast("int")).drop("bucket_rank", "bucket_offset", *names)
    return ranked_only(numbered, group, buckets, out, keep_unranked)


def number_whole(df: DataFrame, group: list[str], buckets: dict[str, Column], order: list, out: str, keep_unranked: bool = False) -> DataFrame:
    """The same number, for groups that are known to be small: one window over the group."""
    numbered = df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*buckets.values(), *order)).cast("int"))
    return ranked_only(numbered, group, buckets, out, keep_unranked)


def ranked_only(numbered: DataFrame, group: list[str], buckets: dict[str, Column], out: str, keep_unranked: bool) -> DataFrame:
    known = reduce(and_, (c.isNotNull() for c in [*map(F.col, group), *buckets.values()]))
    return numbered.withColumn(out, F.when(known, F.col(out))) if keep_unranked else numbered.where(known)


def hot_groups(df: DataFrame, group: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups of more than ``hot_rows`` rows, with a broadcast hint: at most one per ``hot_rows`` rows of ``df``."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows")).where(F.col("group_rows") > hot_rows)
    return F.broadcast(counts.select(*(F.col(g).alias(f"hot_{g}") for g in group), F.lit(True).alias("group_hot")))


def split_hot(df: DataFrame, hot: DataFrame, group: list[str], how: str) -> DataFrame:
    """``how``: ``left`` marks rows of hot groups (``group_hot``, else null), ``inner`` keeps them, ``left_anti`` the others."""
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"hot_{g}")) for g in group))
    out = df.join(hot, same, how)
    return out if how == "left_anti" else out.drop(*(f"hot_{g}" for g in group), *(["group_hot"] if how == "inner" else []))
