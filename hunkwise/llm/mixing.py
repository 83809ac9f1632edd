"""Mixing sources to target weights, with built-in functions only.

Every row gets a hash-random key of 60 bits, md5 of its doc_id. Within a source the rows stand in the order of their keys, and
the mix takes them from the front until the source's budget of words is used up: whole rounds (epochs) over the source first, then a
front part of the order, cut exactly at the budget. The cut is found by distributed prefix sums over key ranges: a source is 4,096
ranges, the range where the running sum passes the budget is 256 finer ones, and so on. No window ever holds more than 4,096
pre-aggregated rows of a source, however many rows the source has; rows themselves are never sorted or shuffled, they meet a
cut table of one row a source.

Targets: with sources by code point (null last) the weights repeat in turn; ``share`` of all words is shared out by weight, no
source gets more than ``most`` times its size, and what is above is reshared by weight until no source is above. That is the
water level L with sum(min(weight * L, most * size)) = share * total; it has a closed form over sources sorted by size / weight.

Defined results: null and wordless texts have size 0 and are taken 0 words. A null source is a source of its own. Rows with one
key (repeated doc_ids; null doc_ids) are at one place of the order: if the cut falls on them, each takes its share of what is
left, rounded down. A source of size 0 has target 0. Reruns and other partitionings give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import WORD, Staged, small_side, word_count

WEIGHTS = (5, 2, 1)
#: In hundredths: the words of the mix against all words, and the most of one source against its size.
SHARE, MOST = 150, 200
#: Hexadecimal digits of a key, and of one level of ranges.
KEY_DIGITS, LEVEL_DIGITS = 15, 3
#: Sources up to which the cut table (about 100 bytes a source) is broadcast; with more of them it is joined by shuffling.
PLAN_ROWS = 200_000

_RESULT = ("size", "source_size", "target", "taken")


def random_key(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix "), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, KEY_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``target``; one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    shared = (sizes.withColumn("weight", weight).withColumn("level", F.col("source_size").cast("double") / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("open_weight", F.sum("weight").over(rest))
              # all in hundredths of words: what is left when the sources below this one have all they may have
              .withColumn("left", share * F.col("total") - most * F.col("capped"))
              .withColumn("fits", F.col("left").cast("decimal(38,0)") * F.col("weight") <= F.col("source_size").cast("decimal(38,0)") * F.col("open_weight") * most))
    first = F.min(F.when(F.col("fits"), F.struct("level", F.col("source").isNull().alias("last"), "source", "left", "open_weight"))).over(everything)
    shared = (shared.withColumn("first", first)
              .withColumn("free", F.max("fits").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    even = (F.col("first.left") * F.col("weight")).cast("double") / (100 * F.col("first.open_weight")).cast("double")
    full = (most * F.col("source_size")).cast("double") / 100
    return shared.select("source", "source_size", F.when(F.col("free"), even).otherwise(full).alias("target"))


def _cuts(sizes: DataFrame, goals: DataFrame, staged: Staged) -> DataFrame:
    """(source, cut_key, cut_left, cut_size) for sources with a part of a round: rows below cut_key are in, rows at it share
    ``cut_left`` of their ``cut_size`` words."""
    at = goals.where("source_size > 0").select("source", (F.col("budget") % F.col("source_size")).alias("left")).where("left > 0")
    rows, digits = sizes, 0
    while digits < KEY_DIGITS:
        digits += min(LEVEL_DIGITS, KEY_DIGITS - digits)
        spot = F.expr(f"key div {16 ** (KEY_DIGITS - digits)}")
        ranges = rows.groupBy(F.col("source").alias("s"), spot.alias("range")).agg(F.sum("size").alias("words"))
        ranges = ranges.join(at, F.col("s").eqNullSafe(F.col("source"))).withColumn(
            "until", F.sum("words").over(Window.partitionBy("source").orderBy("range")))
        passed = staged.put(ranges.where("until >= left AND until - words < left")
                            .select("source", (F.col("left") - F.col("until") + F.col("words")).alias("left"), "range", "words"), "cut")
        here = passed.select(F.col("source").alias("s"), "range")
        inside = staged.put(rows.join(here, F.col("source").eqNullSafe(F.col("s")) & (spot == F.col("range"))).select("source", "key", "size"), "inside")
        if rows is not sizes:
            staged.drop(rows)
        rows, at = inside, passed.select("source", "left")
    return passed.select("source", F.col("range").alias("cut_key"), F.col("left").alias("cut_left"), F.col("words").alias("cut_size"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target (words, of the row's source) and taken (words of the row that the mix has, repeats
    counted). Columns of these names are replaced, other columns stay."""
    staged = Staged(docs.sparkSession)
    base = docs.drop(*_RESULT)
    sizes = staged.put(base.select("source", random_key(F.col("doc_id")).alias("key"), word_count(F.col("text")).alias("size")), "sizes")
    totals = staged.put(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    goals = staged.put(targets(totals, weights, share, most).withColumn("budget", F.floor("target").cast("long")), "targets")
    cuts = _cuts(sizes.where("size > 0"), goals, staged)
    plan = (goals.withColumnRenamed("source", "g").join(cuts.withColumnRenamed("source", "c"), F.col("g").eqNullSafe(F.col("c")), "left")
            .select(F.struct("g", "source_size", "target", "budget", "cut_key", "cut_left", "cut_size").alias("plan")))
    plan = small_side(staged.put(plan, "plan"), PLAN_ROWS)
    names = {c: f"c{i}" for i, c in enumerate(base.columns)}
    source, doc_id, text = (F.col(names[c]) for c in ("source", "doc_id", "text"))
    rows = base.toDF(*names.values()).join(plan, F.col("plan.g").eqNullSafe(source), "left")
    rows = rows.withColumn("size", word_count(text)).withColumn("key", random_key(doc_id))
    whole = F.when(F.col("plan.source_size") > 0, F.expr("plan.budget div plan.source_size")).otherwise(0)
    part = (F.when(F.col("key") < F.col("plan.cut_key"), F.col("size"))
            .when(F.col("key") == F.col("plan.cut_key"), F.floor(F.col("plan.cut_left").cast("decimal(19,0)") * F.col("size") / F.col("plan.cut_size")))
            .otherwise(0).cast("long"))
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()), "size", "plan.source_size", "plan.target",
                       (whole * F.col("size") + part).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: a row per copy of a row that it takes, with ``copy`` (from 0), ``copy_words`` and ``text`` (the first
    ``copy_words`` words where the cut falls on the row), and the columns of ``mix_sources``."""
    plan = mix_sources(docs.drop("copy", "copy_words"), weights, share, most).where("taken > 0")
    copies = F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))
    rows = plan.withColumn("copy", F.explode(copies)).withColumn("copy_words", F.least("size", F.expr("taken - copy * size")))
    gap = r"[\x20\x09-\x0D]*+"
    front = F.concat(F.lit(rf"\A({gap}(?:{WORD}+{gap}){{"), F.col("copy_words").cast("string"), F.lit(r"}+)[\s\S]*+\z"))
    cut = F.regexp_replace("text", front, F.lit("$1"))
    return rows.withColumn("text", F.when(F.col("copy_words") < F.col("size"), cut).otherwise(F.col("text")))
