"""Changed lines against scopes: interval join, class residual, unscoped lines.

The interval join hashes on (file, bin of 256 lines), so a giant file is spread over many partitions and
each line meets only the scopes of its own bin. A scope is repeated once per bin it touches and a line lives
in exactly one bin, so no pair comes out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_LINES = 256
BIN = "line_bin"


def _bin(line: str) -> Column:
    return F.floor(F.col(line) / BIN_LINES).cast("int")


def dealt(df: DataFrame, tasks: int | None, *columns: str) -> DataFrame:
    """``df`` hashed on ``columns`` to ``tasks`` partitions, whatever number the session has and however well rows compress; as it is
    without ``tasks``. What needs the rows by just these columns then moves them no further, unless one is a literal."""
    return df if tasks is None else df.repartition(tasks, *columns)


def interval_join(lines: DataFrame, spans: DataFrame, keys: list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Lines (``line``) with the spans (``start_line``..``end_line``, inclusive) of the same keys around them.

    Besides the keys the two tables share no column names.

    ``how`` is ``inner``, ``left`` or ``left_anti`` (lines in no span). ``tasks``, if given, is the number of partitions. The bin column stays in the result: it is part of the partitioning.
    """
    left = dealt(lines.withColumn(BIN, _bin("line")), tasks, *keys, BIN)
    right = spans.where(F.col("start_line") <= F.col("end_line")).withColumn(
        BIN, F.explode(F.sequence(_bin("start_line"), _bin("end_line")))
    ).withColumnsRenamed({k: f"span_{k}" for k in [*keys, BIN]})
    right = dealt(right, tasks, *(f"span_{k}" for k in [*keys, BIN]))
    match = F.col("line").between(F.col("start_line"), F.col("end_line"))
    for k in [*keys, BIN]:
        match = (F.col(k) == F.col(f"span_{k}")) & match
    return left.join(right, match, how).drop(*[f"span_{k}" for k in [*keys, BIN]])


def cover(lines: DataFrame, symbols: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Each changed line with each scope around it; a line in no scope has a null ``visit``.

    ``modified`` tells whether the scope counts the line as its own: functions always, a class only when no
    scope visited earlier covers the line. ``kept`` tells whether the scope is reported at all, that is has any
    such line. The first window reuses the join's partitioning; the second moves narrow rows only.
    ``tasks``, if given, is the number of partitions of the join and of both windows.
    """
    joined = interval_join(lines, symbols, keys, "left", tasks)
    line_window = W.partitionBy(*keys, BIN, "line")
    scope_window = W.partitionBy(*keys, "visit")
    own = (
        joined.withColumn("first_visit", F.min("visit").over(line_window))
        .withColumn("modified", F.col("visit").isNotNull()
                    & (~F.col("is_class") | (F.col("visit") == F.col("first_visit"))))
        .drop("first_visit", BIN)
    )
    return dealt(own, tasks, *keys, "visit").withColumn("kept", F.max("modified").over(scope_window))


def unscoped_lines(covered: DataFrame, keys: list[str]) -> DataFrame:
    """Changed lines outside every scope."""
    return covered.where(F.col("visit").isNull()).select(*keys, "line")


def modified_lines(covered: DataFrame, keys: list[str]) -> DataFrame:
    """Kept scopes with their sorted own changed lines.

    One group is one scope of one file, so its list is bounded by that file's patch cell.
    """
    return covered.where("modified").groupBy(*keys, "visit").agg(
        F.first("name").alias("name"),
        F.first("start_line").alias("start_line"),
        F.first("end_line").alias("end_line"),
        F.sort_array(F.collect_set("line")).alias("modified_lines"),
    )


def symbol_order(kept: DataFrame, keys: list[str]) -> DataFrame:
    """``symbol_ord`` per file: by first line, ties in visit order."""
    return kept.withColumn(
        "symbol_ord", F.row_number().over(W.partitionBy(*keys).orderBy("start_line", "visit"))
    )


def symbols_modified(covered: DataFrame, keys: list[str]) -> DataFrame:
    """Number of kept scopes per review; counts distinct scopes with map-side combine."""
    return (
        covered.where("modified").groupBy(*keys, "filename", "visit").agg(F.lit(1).alias("one"))
        .groupBy(*keys).agg(F.count("one").alias("symbols_modified"))
    )
