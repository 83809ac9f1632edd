"""Arrow batches on their way to Python tasks are bounded in bytes."""

import pyarrow as pa
import pytest

from hunkwise.llm import common, shingles

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def setting(spark):
    before = spark.conf.get(SETTING, None)
    spark.conf.unset(SETTING)
    yield SETTING
    spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def test_texts_reach_tasks_in_small_batches(spark, setting):
    common.Staged(spark)
    texts = spark.range(0, 3_000, 1, 1).selectExpr("id", "repeat(cast(id % 10 AS string), 4096) AS text")
    found = texts.mapInArrow(_sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 3_000
    assert max(r["size"] for r in found) <= 1.1 * common.BATCH_BYTES


@pytest.mark.parametrize("asked, used", [("1m", "1m"), ("65536", "65536"), ("64MB", str(common.BATCH_BYTES))])
def test_a_smaller_limit_stays(spark, setting, asked, used):
    spark.conf.set(setting, asked)
    common.bound_batches(spark)
    assert spark.conf.get(setting) == used


def test_chunk_size_changes_no_shingles(monkeypatch):
    texts = [f"w{i} x{i % 7} y z é{i}".encode() * (i % 40) for i in range(200)]
    whole = [s.tolist() for s in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 1 << 10)
    parts = [s.tolist() for _, part in shingles.chunks(texts) for s in shingles.shingle_sets(part)]
    assert parts == whole
