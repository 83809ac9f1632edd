import json

import pytest
from pyspark.sql import functions as F

from hunkwise.operators.assemble import assemble
from hunkwise.sources import commits
from hunkwise.streaming import reviews as streaming_reviews
from hunkwise.streaming.reviews import isolate, reviewing
from tests.conftest import rows
from tests.test_pipeline import BAD, RK, added, context, files, sources

KEYS = ["k"]


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v string")


def test_last_write_wins_and_a_repeated_batch_keeps_its_place(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.write_batch(spark, path, "1", {"a": table(spark, (1, "old"), (2, "two")), "b": table(spark, (9, "b1"))})
    commits.write_batch(spark, path, "2", {"a": table(spark, (1, "new"), (1, "new too"), (3, "three"))})
    assert rows(commits.read_committed(spark, path, "a", KEYS), "k", "v") == [(1, "new"), (1, "new too"), (2, "two"), (3, "three")]
    commits.write_batch(spark, path, "1", {"a": table(spark, (1, "again"), (2, "two again"))})
    assert rows(commits.read_committed(spark, path, "a", KEYS), "k", "v") == [(1, "new"), (1, "new too"), (2, "two again"), (3, "three")]
    with pytest.raises(FileNotFoundError):  # the repeated batch has no table b any more
        commits.read_committed(spark, path, "b", KEYS)
    assert commits.live_writes(spark, path)[0] == 3


def test_uncommitted_rows_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.write_batch(spark, path, "1", {"a": table(spark, (1, "x"))})
    commits.put(table(spark, (2, "lost")), path, "a", "2")
    assert rows(commits.read_committed(spark, path, "a", KEYS)) == [(1, "x")]
    assert commits.vacuum(spark, path, ["a", "none"]) == 0  # too young
    assert commits.vacuum(spark, path, ["a"], older_than_hours=-1) == 1
    assert rows(commits.read_committed(spark, path, "a", KEYS)) == [(1, "x")]


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.write_batch(spark, path, "1", {"a": table(spark, (1, "x"))})
    seen, first = commits.live_writes, []

    def stale_once(s, p):
        found = seen(s, p)
        if not first:
            first.append(1)
            commits._publish(s, p, found[0] + 1, [*found[1], {"batch": "other", "tables": {"a": [commits.put(table(s, (5, "other")), p, "a", "other")]}}])
        return found

    monkeypatch.setattr(commits, "live_writes", stale_once)
    assert commits.write_batch(spark, path, "2", {"a": table(spark, (2, "y"))}) == 3
    assert rows(commits.read_committed(spark, path, "a", KEYS), "k") == [(1, "x"), (2, "y"), (5, "other")]


def test_compaction_leaves_a_plain_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        commits.write_batch(spark, path, str(n), {"a": table(spark, (n, f"v{n}"), (7, f"seven {n}"))})
    before = rows(commits.read_committed(spark, path, "a", KEYS), "k")
    commits.compact(spark, path, {"a": KEYS})
    found = commits.read_committed(spark, path, "a", KEYS)
    assert rows(found, "k") == before == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "v3"), (7, "seven 3")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    commits.write_batch(spark, path, "4", {"a": table(spark, (7, "last"))})
    assert rows(commits.read_committed(spark, path, "a", KEYS), "k")[-1] == (7, "last")
    assert commits.vacuum(spark, path, ["a"], older_than_hours=-1) == 4


def test_a_write_reads_no_history(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(3):
        commits.write_batch(spark, path, str(n), {"a": table(spark, (n, "v"))})
    for part in (tmp_path / "t" / "a").glob("*/*.parquet"):
        part.write_bytes(b"broken")
    commits.write_batch(spark, path, "9", {"a": table(spark, (9, "v"))})  # would fail if it read


@pytest.mark.parametrize("part_chars", [1 << 24, 200])
def test_assembled_texts_equal_joined_blocks(spark, part_chars):
    sizes = {1: 1, 2: 63, 3: 64, 4: 65, 5: 1000}
    blocks = [(k, i, f"block {i} of {k}" if i % 7 else ("" if i % 2 else None)) for k, n in sizes.items() for i in range(n)]
    got = {}
    found = assemble(spark.createDataFrame(blocks, "k int, at long, body string").repartition(7), KEYS, "at", "body", part_chars=part_chars)
    for r in found.orderBy("k", "part").collect():
        got.setdefault(r.k, []).append(r)
    for k, n in sizes.items():
        assert [r.part for r in got[k]] == list(range(len(got[k]))) and {r.n_parts for r in got[k]} == {len(got[k])}
        assert "\n".join(r.body for r in got[k]) == "\n".join(t or "" for key, _, t in blocks if key == k)
    assert (len(got[5]) > 10) == (part_chars == 200) and len(got[1]) == 1


def test_isolation_finds_the_rows_that_fail(spark):
    good = []

    def work(part):
        ids = [r.id for r in part.collect()]
        if {13, 77} & set(ids):
            raise ValueError("poison")
        good.extend(ids)

    failed = isolate(spark.range(100), ["id"], work)
    assert sorted(good) == [i for i in range(100) if i not in (13, 77)]
    assert sorted(r.id for part, _ in failed for r in part.collect()) == [13, 77] and all("poison" in e for _, e in failed)
    with pytest.raises(ValueError):
        isolate(spark.range(100), ["id"], lambda part: work(spark.range(13, 14)), most=3)
    assert isolate(spark.range(0), ["id"], work) == []


def test_one_poisoned_review_leaves_the_others(spark, tmp_path, monkeypatch):
    keys = [("org/repo", n, f"s{n}") for n in (2, 3, 4)]
    real = streaming_reviews.review

    def review(contexts, *args, **options):
        if contexts.where("pr_number = 3").count():
            raise RuntimeError("cannot review 3")
        return real(contexts, *args, **options)

    monkeypatch.setattr(streaming_reviews, "review", review)
    out = str(tmp_path / "out")
    on_batch = reviewing(files(spark, *((k, 0, "a.py", "added", added(BAD)) for k in keys)), sources(spark, *((k, "a.py", BAD) for k in keys)), out)
    for _ in range(2):  # the second run stands for a retry of the batch
        on_batch(context(spark, *keys), 5)
    read = {t: commits.read_committed(spark, out, t, ["repo_full_name", "pr_number", "head_sha"]) for t in ("reviews", "inline_comments", "failed")}
    assert rows(read["reviews"].select("pr_number"), "pr_number") == [(n,) for n in (2, 4)]
    assert read["inline_comments"].groupBy("pr_number").count().select("count").distinct().count() == 1
    (r,) = read["failed"].collect()
    assert r.pr_number == 3 and "cannot review 3" in r.error
    assert json.loads((tmp_path / "out" / "_commits" / "2.json").read_text())[0]["batch"] == "5"


def test_review_rows_hold_verdict_and_body(spark):
    from hunkwise.plans.review import enrich, review

    out = review(context(spark, RK), files(spark, (RK, 0, "a.py", "added", added(BAD))), sources(spark, (RK, "a.py", BAD)))
    (r,) = out.reviews().collect()
    blocks = out.reports().orderBy("block_ord").collect()
    assert (r.verdict, r.n_parts) == ("REQUEST_CHANGES", 1) and r.body == "\n".join(b.body for b in blocks)
    context_tables = enrich(context(spark, RK), files(spark, (RK, 0, "a.py", "added", added(BAD))), sources(spark, (RK, "a.py", BAD)))
    text = "\n".join(b.text for b in context_tables.prompts().orderBy("block_ord").collect())
    pairs = context_tables.prompt_pairs({"security": "S", "own": "O"}).orderBy(F.desc("category")).collect()
    assert [(p.category, p.system_prompt, p.user_prompt) for p in pairs] == [("security", "S", text), ("own", "O", text)]
