import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hunkwise.llm import neardup, shingles
from hunkwise.llm.common import Staged
from hunkwise.llm.components import components
from tests.llm.helpers import awkward, docs_frame, near_duplicate_roots, shingle_set


def test_against_all_pairs(spark):
    rows = awkward()
    out = neardup.near_duplicates(docs_frame(spark, rows, extra=True)).collect()
    roots = near_duplicate_roots(rows)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (roots[r["doc_id"]], roots[r["doc_id"]] == r["doc_id"])
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in out) == sorted((d or -1, len(shingle_set(t))) for d, t, _ in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_need_more_rounds(spark, seed):
    """Neighbours of a chain link, its ends do not; unlinked texts share bands with it."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    rows, text = [], words[:]
    for i in range(40):
        rows.append((i, " ".join(text), "s"))
        for _ in range(2):
            text[rng.randrange(150)] = f"x{i}{rng.random()}"
    for i in range(25):  # about 60 % alike
        other = words[:]
        for j in range(0, 150, 16):
            other[j] = f"y{i}{j}"
        rows.append((100 + i, " ".join(other), "s"))
    rng.shuffle(rows)
    roots = near_duplicate_roots(rows)
    assert 1 < len(set(roots.values()))
    out = neardup.near_duplicates(docs_frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == roots


def test_large_groups(spark):
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base), "s") for i in range(300)]
    rows += [(300 + i, " ".join(base[:50] + [f"n{i}"] + base[51:]), "s") for i in range(300)]
    out = neardup.near_duplicates(docs_frame(spark, rows)).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_empty_table_and_filter(spark):
    assert neardup.near_duplicates(docs_frame(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(docs_frame(spark, [])).count() == 0
    rows = awkward()
    kept = neardup.drop_near_duplicates(docs_frame(spark, rows, extra=True))
    assert kept.columns == docs_frame(spark, rows, extra=True).columns
    roots = near_duplicate_roots(rows)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(roots.values()))
    assert kept.where("doc_id IS NULL").count() == 2


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = shingles.mix(np.arange(4000, dtype=np.uint64))
    for n in (3, 40, 1500):
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.sort(np.concatenate((a[: n // 2], rng.choice(np.setdiff1d(pool, a), n - n // 2, replace=False))))
        s = shingles.sketches([a, b, a.copy(), a[:0]], 1024)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - true) < 0.08
        assert (s[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_shingles_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    texts = [" ".join(f"w{i % 977}" for i in range(5000)).encode(), b"", None, b"x" * 5000, b"a b"]
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 700)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(texts)))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(5, 5)]
    up = {}
    for a, b in pairs:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    got = components(spark.createDataFrame(pairs, "a long, b long"), Staged(spark))
    assert {r["node"]: r["root"] for r in got.collect()} == up
    assert components(spark.createDataFrame([], "a long, b long"), Staged(spark)).select(F.col("root")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_paths_take_few_rounds(spark, shuffled):
    class Counted(Staged):
        rounds = 0

        def put(self, df, name):
            self.rounds += name == "inner"
            return super().put(df, name)

    names = list(range(1001))
    if shuffled:
        random.Random(6).shuffle(names)
    staged = Counted(spark)
    got = components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"), staged).collect()
    assert len(got) == 1001 and {r["root"] for r in got} == {0}
    assert staged.rounds <= 20
