"""Sharding by a keyed permutation of the row numbers, with built-in functions only.

Every row of a stored table has a global number without any shuffle: the rows of the files before its own (files by name), plus its
place in its file. A Feistel network turns the number into a place of a random order, and the place gives the shard (place modulo
shards) and the slot in it (place over shards): shard counts differ by one at most and slots have no gaps. Nothing is sorted or
grouped, so copies, hot keys and repeated rows cost nothing; only the table of files (one row each, as in the driver's own listing)
is summed up in order.

The network works on pairs (number modulo a, number over a): ``a`` is near the root of the row count and ``a * b`` exceeds it by at
most SLACK, so that a walk that leaves the rows (cycle walking: permute again until the place is one of a row) is back after
SLACK + 1 steps at the latest. Everything is a function of (number, rows, seed): ``row_number`` turns (shard, slot) back into the
row's number, so a reader can find any slot without an index.

Defined results: a row counts whatever its columns hold (nulls, empty and very long texts, repeated rows are numbered like any other).
An empty table gives no rows. The same files give the same shards; a frame that is not a plain scan is written to the shared
folder first, and its numbers are those of the written files. Columns named shard and slot are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.llm.common import Staged, small_side

SHARDS, SEED, ROUNDS = 16, 42, 6
#: How many numbers the network's domain may have beyond the rows: the longest walk.
SLACK = 16
#: Files up to which the table of first numbers (about 200 bytes a file) is broadcast; with more it is joined by shuffling.
FILES = 300_000
#: Rows of one written file of a shard.
FILE_ROWS = 100_000

_MASK = (1 << 31) - 1


def domain(rows: int) -> tuple[int, int]:
    """(a, b) with rows <= a * b <= rows + SLACK, as near to a square as there is."""
    for a in range(isqrt(rows), 0, -1):
        if -rows % a <= SLACK:
            return a, -(-rows // a)
    return 1, 1


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers of 28 bits a round."""
    return [tuple(int(hashlib.sha256(f"{seed}:{r}:{name}".encode()).hexdigest()[:7], 16) | 1 for name in "mcs") for r in range(ROUNDS)]


def _network(number: Column, rows: int, seed: int, back: bool) -> Column:
    """One pass of the network, or of its inverse. Halves are below 2^31 and keys below 2^28, so no product overflows."""
    a, b = domain(rows)
    keys = list(enumerate(round_keys(seed)))
    rounds = F.array(*[F.struct(F.lit(r % 2 == 0).alias("left"), *(F.lit(v).cast("long").alias(n) for v, n in zip(key, "mcs")))
                       for r, key in (reversed(keys) if back else keys)])

    def drawn(half: Column, key: Column) -> Column:
        spread = half * key["m"] + key["c"]
        value = F.shiftright(spread.bitwiseXOR(F.shiftright(spread, 14)).bitwiseAND(_MASK) * key["s"], 20)
        return -value if back else value

    def turn(state: Column, key: Column) -> Column:
        x, y = state["x"], state["y"]
        return F.struct(F.when(key["left"], F.pmod(x + drawn(y, key), F.lit(a))).otherwise(x).alias("x"),
                        F.when(key["left"], y).otherwise(F.pmod(y + drawn(x, key), F.lit(b))).alias("y"))

    start = F.struct((number % a).alias("x"), F.call_function("div", number, F.lit(a)).alias("y"))
    return F.aggregate(rounds, start, turn, lambda state: state["y"] * a + state["x"])


def _walk(number: Column, rows: int, seed: int, back: bool) -> Column:
    def step(place: Column, _: Column) -> Column:  # the place is null before the first pass
        return F.when(place < rows, place).otherwise(_network(F.coalesce(place, number), rows, seed, back))

    a, b = domain(rows)
    return F.aggregate(F.sequence(F.lit(0), F.lit(a * b - rows)), F.lit(None).cast("long"), step)


def place(number: Column, rows: int, seed: int = SEED) -> Column:
    """The place, from 0, of row ``number`` of ``rows`` in the random order."""
    return _walk(number.cast("long"), rows, seed, False)


def row_number(shard: Column, slot: Column, rows: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The number of the row that stands in a slot of a shard."""
    return _walk(slot.cast("long") * shards + shard.cast("long"), rows, seed, True)


def numbered(docs: DataFrame, stored: bool = False) -> tuple[DataFrame, list[str], int]:
    """``docs`` as columns c0, c1, ... and ``number``, with the columns' names and the number of rows. ``stored``: it is a plain scan
    of Parquet files, whose row places are read; anything else is written first."""
    staged = Staged(docs.sparkSession)
    scan = docs if stored else staged.put(docs, "rows")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = scan.metadataColumn("_metadata")
    rows = scan.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(scan.columns, inner)), at["file_path"].alias("file"), at["row_index"].alias("row"))
    name = F.element_at(F.split("file", "/"), -1)
    counts = staged.put(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows")), "files")
    before = F.sum("n_rows").over(W.orderBy(name, "file").rowsBetween(W.unboundedPreceding, -1))
    firsts = staged.put(counts.select(F.col("file").alias("of"), F.coalesce(before, F.lit(0)).alias("first")), "first-rows")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    staged.drop(counts)
    placed = rows.join(small_side(firsts, FILES), F.col("file") == F.col("of"))
    return placed.select(*inner, (F.col("first") + F.col("row")).alias("number")), docs.columns, total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stored: bool = False) -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 without gaps in each shard)."""
    rows, names, total = numbered(docs, stored)
    found = rows.withColumn("place", place(F.col("number"), total, seed))
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in ("shard", "slot")]
    return found.select(*kept, (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, stored: bool = False, file_rows: int = FILE_ROWS) -> None:
    """Writes a folder a shard (``shard=0`` and so on), its rows in the order of their slots in files of about ``file_rows``: the one
    step that moves texts. Ranges of (shard, slot) are even, as no key repeats."""
    rows = shard(docs, shards, seed, stored)
    files = max(shards, -(-rows.count() // file_rows))
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
