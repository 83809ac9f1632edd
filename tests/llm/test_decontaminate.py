import random

from hunkwise.llm import decontaminate
from tests.llm.helpers import TERM, awkward, docs_frame, hits, windows

ITEM = "What is the capital of the land beyond seven hills, seven seas and forests?"


def items():
    rng = random.Random(4)
    return [(1, ITEM), (2, " ".join(f"q{rng.randrange(9)}" for _ in range(60))), (3, "Short ITEM?"), (4, None), (5, "..."), (None, "null id"), (6, ITEM + " tail"), (6, "once more")]


def documents():
    extra = [(5000, f"<p>{ITEM.upper()}</p>", "s"), (5001, "x " * 2000 + ITEM + " é" * 300, "s"), (5002, "short-item short item SHORT_ITEM", "s"),
             (5003, " ".join(ITEM.split()[:12]), "s"), (5004, "onceX more null_id", "s"), (5005, items()[1][1] + " " + items()[1][1], "s")]
    return awkward() + extra


def check(spark, found, rows):
    expected = windows(items())
    got = {}
    for r in found.collect():
        got.setdefault((r["doc"]["doc_id"], r["doc"]["text"]), []).append((r["n_words"], r["n_hit"], tuple(r["item_ids"]), tuple(r["places"])))
    for d, t, _ in rows:
        n, hit, whose = hits(t, expected)
        assert (n, len(hit), tuple(sorted(whose)), tuple(sorted(hit))) in got[d, t]


def test_against_brute_force(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = documents()
    check(spark, decontaminate.scan(docs_frame(spark, rows, extra=True), bench), rows)


def test_many_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 900)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = documents()
    check(spark, decontaminate.scan(docs_frame(spark, rows), bench), rows)


def test_spans_and_filter(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = docs_frame(spark, documents(), extra=True)
    found = decontaminate.spans(decontaminate.scan(docs, bench))
    texts = {d: t for d, t, _ in documents()}
    spans = {r["doc_id"]: r["spans"] for r in found.where("doc_id IN (5000, 5001, 5003)").collect()}
    assert [TERM.findall(texts[5001][s["start"] : s["end"]]) for s in spans[5001]] == [TERM.findall(ITEM)]
    assert spans[5003] == [] and texts[5000][spans[5000][0]["start"] :].startswith("WHAT")
    kept = decontaminate.decontaminate(docs, bench)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert 5000 not in ids and 5002 not in ids and {5001, 5003, 2000, 2001} <= ids


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.scan(docs_frame(spark, []), bench).count() == 0
    rows = awkward()
    assert decontaminate.decontaminate(docs_frame(spark, rows), bench.where("false")).count() == len(rows)
