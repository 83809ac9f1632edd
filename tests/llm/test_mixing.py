import random
from collections import Counter

import pytest

from hunkwise.llm import mixing
from tests.llm.helpers import WORD, awkward, docs_frame, mix_plan


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_targets_budgets_and_limits(spark, rows):
    out = mixing.mix_sources(docs_frame(spark, rows, extra=True)).collect()
    size, target = mix_plan(rows)
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        n = len(WORD.findall(r["text"] or ""))
        assert (r["size"], r["source_size"]) == (n, size[r["source"]])
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * n
        taken[r["source"]] += r["taken"]
    for s in size:
        assert int(target[s]) - 3 <= taken[s] <= int(target[s])  # rows at one key round down
    assert out[0]["rep"] == "x"


def test_reruns_and_partitionings_agree(spark, rows):
    frame = docs_frame(spark, rows).select("doc_id", "text", "source")
    one, two = (sorted(map(str, mixing.mix_sources(f).collect())) for f in (frame.coalesce(1), frame.repartition(7)))
    assert one == two


def test_empty_tables_and_no_words(spark):
    assert mixing.mix_sources(docs_frame(spark, [])).count() == 0
    out = mixing.mix_sources(docs_frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0), (0, 0.0, 0)]
    assert mixing.mixture(docs_frame(spark, [(1, None, "a")])).count() == 0


def test_mixture_cuts_at_words(spark, rows):
    plan = Counter()
    for r in mixing.mix_sources(docs_frame(spark, rows)).collect():
        plan[r["doc_id"], r["text"], r["source"]] += r["taken"]
    got = Counter()
    texts = {(d, s): t for d, t, s in rows}
    for r in mixing.mixture(docs_frame(spark, rows)).collect():
        words = WORD.findall(r["text"])
        assert len(words) == r["copy_words"] >= 1
        full = next(t for d, t, s in rows if (d, s) == (r["doc_id"], r["source"]) and t and t.startswith(r["text"]))
        got[r["doc_id"], full, r["source"]] += len(words)
    assert got == Counter({k: v for k, v in plan.items() if v}) and texts


def test_many_sources_water_level(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 400]), f"s{i % 23:02d}" if i % 29 else None) for i in range(300)]
    _, target = mix_plan(rows)
    for r in mixing.mix_sources(docs_frame(spark, rows)).collect():
        assert abs(r["target"] - target[r["source"]]) < 1e-6
