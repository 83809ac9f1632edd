from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hunkwise.llm import shards
from tests.llm.helpers import awkward, docs_frame


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 60))
def test_domain_is_tight(rows):
    if rows > 1 << 44:
        rows >>= 16
    a, b = shards.domain(rows)
    assert rows <= a * b <= max(rows, 1) + shards.SLACK and max(a, b) < 1 << 31


@pytest.mark.parametrize("rows", [1, 2, 3, 16, 17, 271, 1000, 10_007])
def test_places_are_a_permutation_and_can_be_found_back(spark, rows):
    placed = spark.range(rows).select("id", shards.place(F.col("id"), rows).alias("p"))
    back = shards.row_number(F.col("p") % 7, F.expr("p div 7"), rows, shards=7)
    out = placed.withColumn("back", back).collect()
    assert sorted(r["p"] for r in out) == list(range(rows))
    assert all(r["back"] == r["id"] for r in out)


def test_order_is_mixed_and_depends_on_the_seed(spark):
    n = 10_000
    out = spark.range(n).select("id", shards.place(F.col("id"), n).alias("p"), shards.place(F.col("id"), n, seed=7).alias("q")).collect()
    assert sum(r["p"] == r["q"] for r in out) < 20
    cells = Counter((r["id"] * 10 // n, r["p"] * 10 // n) for r in out)  # 100 cells of 100 expected
    assert len(cells) == 100 and sum((c - 100) ** 2 / 100 for c in cells.values()) < 160
    steps = Counter(b["p"] - a["p"] for a, b in zip(out, out[1:]))
    assert max(steps.values()) < 60  # neighbours do not stay neighbours


def test_walks_out_of_the_domain_come_back(spark):
    rows = next(n for n in range(5000, 6000) if (lambda a, b: a * b - n)(*shards.domain(n)) == shards.SLACK)
    out = [r["p"] for r in spark.range(rows).select(shards.place(F.col("id"), rows).alias("p")).collect()]
    assert sorted(out) == list(range(rows))


def check(out, n, k):
    sizes = Counter(r["shard"] for r in out)
    assert sum(sizes.values()) == n and all(0 <= s < k for s in sizes)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == k else 0) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(c)) for s, c in sizes.items())


def test_awkward_rows_and_names(spark):
    rows = awkward()
    docs = docs_frame(spark, rows, extra=True).selectExpr("*", "'x' AS shard", "'y' AS SLOT", "'z' AS number", "'v' AS file", "'u' AS _metadata").repartition(5)
    found = shards.shard(docs, 16)
    out = found.collect()
    check(out, len(rows), 16)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((d, t) for d, t, _ in rows)
    assert {r["number"] for r in out} == {"z"} and {r["_metadata"] for r in out} == {"u"}
    assert "SLOT" not in found.columns and found.columns[-2:] == ["shard", "slot"]


def test_stored_table_is_numbered_by_files_and_reruns_agree(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(1000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, concat('t', id % 5)) AS text").repartition(6).write.parquet(path)
    one, two = (sorted(map(tuple, shards.shard(spark.read.parquet(path), 16, stored=True).collect()), key=str) for _ in range(2))
    assert one == two
    check(shards.shard(spark.read.parquet(path), 16, stored=True).collect(), 1000, 16)
    rows, names, total = shards.numbered(spark.read.parquet(path), stored=True)
    assert (names, total) == (["doc_id", "text"], 1000)
    assert sorted(r["number"] for r in rows.collect()) == list(range(1000))


def test_fewer_rows_than_shards_and_empty_table(spark):
    check(shards.shard(docs_frame(spark, awkward()[:3]), 16).collect(), 3, 16)
    empty = shards.shard(docs_frame(spark, []))
    assert empty.count() == 0 and [t for _, t in empty.dtypes[-2:]] == ["int", "bigint"]


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(docs_frame(spark, awkward()), path, shards=4, file_rows=10)
    out = spark.read.parquet(path).collect()
    check(out, len(awkward()), 4)
    for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f"), "shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect():
        assert r["b"] - r["a"] + 1 == r["n"]  # a file is a run of slots
