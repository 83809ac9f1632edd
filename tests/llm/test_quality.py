import itertools
import random
import zlib

import numpy as np
import pytest

from hunkwise.llm import quality
from tests.llm.helpers import awkward, docs_frame

SF = "/root/testdata/sf0.01"


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 5, 2]
    owner = np.repeat(np.arange(4), sizes)
    scores, change = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pairs, total = quality.marginals(scores, owner, change)
    want_good, want_pairs, want_total, at = [], np.zeros((2, 2)), 0.0, 0
    for k in sizes:
        own, z, g, p = scores[at : at + k], 0.0, np.zeros(k), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=k):
            w = np.exp(own @ np.array(ys) + sum(change[a, b] for a, b in zip(ys, ys[1:])))
            z += w
            g += w * np.array(ys)
            for a, b in zip(ys, ys[1:]):
                p[a, b] += w
        want_good += list(g / z)
        want_pairs += p / z
        want_total += np.log(z)
        at += k
    assert np.allclose(good, want_good) and np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def test_fit_learns_and_its_slope_is_right():
    rng = np.random.default_rng(2)
    owner = np.repeat(np.arange(200), 5)
    labels = np.repeat(rng.integers(0, 2, 200), 5)
    x = np.column_stack((labels + rng.normal(scale=1.0, size=1000), rng.normal(size=1000), np.ones(1000)))
    model = quality.fit(x, owner, labels)
    z = (x - model["mean"]) / model["spread"] @ model["weights"]
    good, _, _ = quality.marginals(z, owner, model["change"])
    assert ((good > 0.5) == labels).mean() > 0.8  # a line alone gives 0.7
    assert model["change"][0, 0] + model["change"][1, 1] > model["change"][0, 1] + model["change"][1, 0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels, "s").join(labels, "doc_id").select("doc_id", "s", "quality").collect()
    out = [(r["s"] >= quality.THRESHOLD, r["quality"] == 1) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(out) > 50 and np.mean([a == b for a, b in out]) >= 0.97


def test_scores_do_not_see_other_columns_and_ignore_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 300")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    plain = {r["doc_id"]: r["s"] for r in quality.score(docs, labels, "s").collect()}
    moved = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'other' AS source", "n_chars")
    assert {r["doc_id"]: r["s"] for r in quality.score(moved, flipped, "s").collect()} == pytest.approx(plain)


def test_awkward_rows(spark):
    rows = awkward()
    docs = docs_frame(spark, rows, extra=True)
    rng = random.Random(1)
    labels = spark.createDataFrame([(d, rng.choice([0, 1, None])) for d, _, _ in rows] + [(None, 1), (99999, 0), (3, 1)], "doc_id long, quality int")
    out = quality.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in out)
    blank = {r["quality_score"] for r in out if r["doc_id"] in (2000, 2001, 2002)}
    assert len(blank) == 1
    alone = quality.score(docs, labels.where("false")).collect()
    assert {r["quality_score"] for r in alone} == {1.0}
    assert quality.score(docs_frame(spark, []), labels).count() == 0
    kept = quality.keep_good(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == len(rows)
