"""URL filters: a temporal join of captures with dated list entries, with built-in functions only.

A list is a log of dated changes: at ``changed`` an entry (a host, listed with everything below it) is added to or removed
from a category. Per (entry, category) the changes become validity intervals: an addition holds until the next change that
removes it. A capture is blocked if, at the time of its fetch, an interval of its host or of a parent of its host is
active. Start is inclusive, end exclusive.

The join is an as-of join by time cells. Each interval is cut at the borders of cells of ``CELL_DAYS`` days and has one row a
cell it touches; an open end is bounded by the last fetch. A capture looks up its host's suffixes in its own cell, so
both sides meet by equality on (entry, cell) and only the borders remain to be compared. Distinct (host, fetched)
pairs are judged once, by pre-aggregation. Both joins are salted (``salted_join``): a platform's domain that is a
parent of a third of all hosts, and a host and time with a third of all captures, are spread over many tasks.

Times are dates or timestamps, of the captures and of the changes alike; a date counts as its midnight and nothing is rounded.

Defined results: a null or unusable url has no host and is never blocked; a null fetch time is never blocked; entries or
changes with a null host, category or time are ignored; of changes of one entry at one time a removal wins; repeated changes
change nothing. Host names compare in lower case without port, user, trailing dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import Staged, salted_join

CELL_DAYS = 32


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*+://(?:[^/?#@]*+@)?+([^/?#:@]++)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parents, the host first; a suffix has two labels or more unless the host has one."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to) from (entry, category, changed, action 'add' or 'remove'); valid_to is null while
    the entry is still listed. Spells of one entry do not overlap."""
    clean = (changes.where("entry IS NOT NULL AND category IS NOT NULL AND changed IS NOT NULL AND action IN ('add', 'remove')")
             .groupBy(F.lower("entry").alias("entry"), "category", "changed").agg(F.max("action").alias("action")))
    by_time = Window.partitionBy("entry", "category").orderBy("changed")
    turns = clean.withColumn("before", F.lag("action").over(by_time)).where(~F.col("action").eqNullSafe(F.col("before")))
    spells = turns.withColumn("valid_to", F.lead("changed").over(by_time))
    return spells.where("action = 'add'").select("entry", "category", F.col("changed").alias("valid_from"), "valid_to")


def cell(time: Column) -> Column:
    return F.floor(F.unix_date(time.cast("date")) / CELL_DAYS).cast("int")


def judge(captures: DataFrame, changes: DataFrame, key: str, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row a row of ``captures``: key, host, fetched, blocked, categories (sorted), entries (sorted) active at the fetch.
    ``fetched`` and ``changed`` are dates or timestamps."""
    staged = Staged(captures.sparkSession)
    rows = captures.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), F.col(fetched).alias("fetched"))
    asked = rows.where("host IS NOT NULL AND fetched IS NOT NULL").groupBy("host", "fetched").agg(F.count("*").alias("captures"))
    asked = staged.put(asked, "asked-urls")
    last = F.lit(asked.agg(F.max(F.col("fetched").cast("timestamp"))).first()[0]).cast("timestamp")
    spells = intervals(changes.withColumn("changed", F.col("changed").cast("timestamp"))).where(F.col("valid_from") <= last)
    until = F.greatest("valid_from", F.least("valid_to", last))
    spells = spells.withColumn("cell", F.explode(F.sequence(cell(F.col("valid_from")), cell(until))))
    looked = asked.select("host", "fetched", cell(F.col("fetched")).alias("cell"), F.explode(suffixes(F.col("host"))).alias("entry"))
    at = F.col("fetched").cast("timestamp")
    hits = salted_join(looked, spells, ["entry", "cell"]).where((at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    found = hits.groupBy("host", "fetched").agg(F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_set("entry")).alias("entries"))
    none = F.array().cast("array<string>")
    return salted_join(rows, found, ["host", "fetched"], "left", counted=asked.withColumnRenamed("captures", "n")).select(
        key, "host", "fetched", F.col("categories").isNotNull().alias("blocked"),
        F.coalesce("categories", none).alias("categories"), F.coalesce("entries", none).alias("entries"))
