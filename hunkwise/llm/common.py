"""What the operators share: tables, word rules, staging, size-checked broadcasts."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.session import stage_path, unstage

#: A word of the mixing and near-duplicate contracts, and ASCII case folding.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one long column that a broadcast may hold (about 64 MB as a hash relation); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

#: Bytes of an Arrow batch on its way to a Python task, unless the session asks for less. A batch lives several times over: in the
#: JVM's buffers, in the task's, and as Python objects.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Tasks look for this package where the driver has it, too; on a cluster it comes with the job or is installed."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, known)))
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most BATCH_BYTES (or one row). Rows and results stay the same."""
    if not 0 < _bytes(spark.conf.get(_BATCH, None)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _bytes(setting: str | None) -> int:
    """A size setting as a number; 0 where it is not set or has a unit that is not known."""
    found = re.fullmatch(r"(\d+)([bkmg]?)b?", (setting or "").lower())
    return int(found[1]) << {"k": 10, "m": 20, "g": 30}.get(found[2], 0) if found else 0


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Staged:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``put`` writes and reads back; ``drop`` deletes one that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = stage_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def clear(self) -> None:
        for path in self.paths.values():
            unstage(self.spark, path)
        self.paths = {}

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                unstage(self.spark, path)


def small_side(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (one long column, already staged) with a broadcast hint if it has at most ``limit`` rows, as it is otherwise."""
    return F.broadcast(ids) if ids.count() <= limit else ids


#: Rows of one key that one task of a salted join takes, and keys that may count as hot (a broadcast of two longs each).
SALT_ROWS, HOT_KEYS = 65_536, 200_000


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counted: DataFrame | None = None,
                salt_rows: int = SALT_ROWS) -> DataFrame:
    """``left`` joined with ``right`` (``how`` is inner or left), a key with many left rows being spread over several tasks.

    Left rows are counted a key, with map-side combine (or given as ``counted``: the key columns and ``n``). A key with more than
    ``salt_rows`` is hot: its left rows are dealt over as many parts, and its right rows are repeated once a part. Keys are known by
    a hash, so hot ones are two longs each; there are at most as many as the rows divided by the limit, which rises with
    the table so that they stay below HOT_KEYS. Two keys of one hash share their parts, which changes no result. Keys
    with nulls match nothing.
    """
    key = F.xxhash64(*on).alias("_salt_key")
    counts = (left.groupBy(*on).agg(F.count("*").alias("n")) if counted is None else counted).select(key, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(salt_rows, -(-total // HOT_KEYS))
    hot = counts.groupBy("_salt_key").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select(
        "_salt_key", F.ceil(F.col("n") / limit).cast("int").alias("_salt_parts"))
    parts = F.coalesce("_salt_parts", F.lit(1))
    dealt = left.withColumn("_salt_key", key).join(F.broadcast(hot), "_salt_key", "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_salt_key", "_salt_parts")
    copied = right.withColumn("_salt_key", key).join(F.broadcast(hot), "_salt_key", "left")
    copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salt_key", "_salt_parts")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")
