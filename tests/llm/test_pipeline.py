from collections import Counter

import corpus_pipeline
from hunkwise.llm import decontaminate, quality, secrets
from hunkwise.llm.queries import QUERIES
from hunkwise.llm.oracles import ORACLES
from tests.compare import differences, duck
from tests.llm.helpers import WORD, hits, mix_plan, near_duplicate_roots, windows

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "mix"]
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_run_against_plain_python(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    kept = quality.score(docs, labels, "s").where(f"s >= {quality.THRESHOLD}").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in kept]
    roots = near_duplicate_roots(rows)
    rows = [r for r in rows if roots[r[0]] == r[0]]
    items = windows([tuple(r) for r in bench.select("item_id", "text").collect()])
    judged = [(r, *hits(r[1], items)[:2]) for r in rows]
    rows = [r for r, n, hit in judged if not (hit and decontaminate.SHARE * len(hit) >= n)]
    left = docs.join(spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), "doc_id").select(docs.columns)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in secrets.redact_secrets(left).collect()]
    size, target = mix_plan(rows)

    taken, seen = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        words = len(WORD.findall(r["text"]))
        assert words == r["copy_words"] and r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        full = next(t for d, t, _ in rows if d == r["doc_id"])
        assert full.startswith(r["text"])
        taken[r["source"]] += words
        seen[r["doc_id"]] += words
    for s in size:
        assert taken[s] == int(target[s])
    assert all(seen[d] <= 2 * len(WORD.findall(t or "")) for d, t, _ in rows)
    assert set(seen) <= {d for d, _, _ in rows}


def test_sql_agrees(spark):
    con = duck(SF)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()) is None, name
