"""How often rows move: shared findings, ranks, report texts, the sink's reads."""

import random

import pytest
from pyspark.sql import functions as F

from hunkwise.operators import cover, review, scopes
from hunkwise.operators.assemble import assemble
from hunkwise.plans.local import review_local
from hunkwise.schemas import SEVERITIES
from hunkwise.sources import commits
from hunkwise.session import stage
from registry import queries as registered
from registry.queries import QUERIES
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, column):
    """Scans of the given tables that read ``column``."""
    return sum("FileScan parquet" in line and f"{column}#" in line for line in plan(df).split("\n"))


@pytest.fixture
def found(spark):
    """Findings of small and large reviews with copies, nulls and unknown severities; ``seq`` is their number."""
    rng = random.Random(4)
    pick = lambda *values: rng.choice([*values, *values, None])
    data = [(rng.choice([0, 0, 0, 1, 2, None]), pick("a.py", "b/c.py"), pick(1, 2, 5000, 9000), pick("security", "quality"), pick("t", "u"),
             pick(*(s[0] for s in SEVERITIES), "odd"), f"m{i}", i) for i in range(3_000)]
    return spark.createDataFrame(data, "k int, file string, line_start int, category string, title string, severity string, message string, seq int")


@pytest.mark.parametrize("hot_rows", [65_536, 700, 3])
def test_unique_ranked_gives_the_rows_of_both_steps(spark, found, hot_rows):
    both = review.unique_ranked(found, ["k"], hot_rows)
    order = ["k", "seq"]
    columns = sorted(found.columns)
    assert rows(both.select(columns), *order) == rows(review.dedupe_findings(found, ["k"]).select(columns), *order)
    first = {}
    for r in found.orderBy("seq").collect():
        first.setdefault((r.k, r.file, r.line_start, r.category, r.title), r)
    level = {s[0]: s[1] for s in SEVERITIES}
    low = lambda v: (v is not None, v)  # nulls first
    want = {}
    for k in (0, 1, 2):
        mine = sorted((r for r in first.values() if r.k == k), key=lambda r: (level.get(r.severity, 5), low(r.file), low(r.line_start), r.seq))
        want |= {r.seq: n for n, r in enumerate(mine, 1) if None not in (r.file, r.line_start)}
    assert {r.seq: r.finding_ord for r in both.where("finding_ord IS NOT NULL").collect()} == want
    assert {r.seq: r.finding_ord for r in review.rank_findings(review.dedupe_findings(found, ["k"]), ["k"]).collect()} == want


def test_findings_of_small_reviews_move_once(spark, found):
    wide = [line for line in plan(review.unique_ranked(found, ["k"])).split("\n") if "REPARTITION_BY_COL" in line]
    assert len(wide) == 1 and "hashpartitioning(k" in wide[0]


@pytest.mark.parametrize("name", ["rank_findings", "inline_comments"])
def test_ranked_findings_are_joined_once(spark, name):
    assert scans(QUERIES[name](spark, SF), "l_linenumber") == 0  # read before, into a staged table


@pytest.mark.parametrize("name, rest", [
    ("inline_comments", {"severity", "symbol_name", "message", "suggested_fix", "confidence_score"}), ("rank_findings", {"severity", "message"})])
def test_findings_are_staged_without_columns_that_nobody_reads(spark, monkeypatch, name, rest):
    staged = []
    monkeypatch.setattr(registered, "stage", lambda df, _: staged.append(df.columns) or df)
    QUERIES[name](spark, SF)
    assert [set(columns) for columns in staged] == [{"review", "file", "line_start", "category", "title", "seq"} | rest]


def test_staged_tables_are_zstd(spark):
    assert all(".zstd." in name for name in stage(spark.range(10), "codec").inputFiles())


def test_report_reads_shared_findings(spark):
    assert scans(QUERIES["report_markdown"](spark, SF), "l_linenumber") == 0


def test_submission_joins_findings_once(spark):
    assert scans(QUERIES["submission_payload"](spark, SF), "l_linenumber") == 1  # of the diff's ranges


@pytest.mark.parametrize("several_rows", [1_000_000, 1])
@pytest.mark.parametrize("part_chars", [1 << 24, 300])
def test_texts_of_one_run_and_of_several(spark, monkeypatch, several_rows, part_chars):
    monkeypatch.setattr("hunkwise.operators.assemble.SEVERAL_ROWS", several_rows)
    numbers = {1: [0], 2: list(range(200)), 3: [70, 71], 4: [0, 0, 1, *range(90, 140)], None: list(range(100))}
    data = [(k, at, f"{k} {at}") for k, ats in numbers.items() for at in ats]
    found = assemble(spark.createDataFrame(data, "k int, at long, body string").repartition(5), ["k"], "at", "body", part_chars=part_chars)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.part):
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(numbers)
    for k, parts in got.items():
        assert "\n".join(r.body for r in parts) == "\n".join(f"{k} {at}" for at in numbers[k])
        assert [(r.part, r.n_parts) for r in parts] == [(n, len(parts)) for n in range(len(parts))]
    assert (len(got[2]) > 1) == (part_chars == 300)


def test_texts_of_one_run_do_not_move_again(spark):
    blocks = spark.range(300).selectExpr("id div 30 AS k", "id % 30 AS at", "'x' AS body")
    assert "Exchange" not in plan(assemble(blocks, ["k"], "at", "body"))


def test_replaced_and_current_writes_are_plain_scans(spark, tmp_path):
    path, table = str(tmp_path / "sink"), lambda *r: spark.createDataFrame(r, "k int, v string")
    commits.write_batch(spark, path, "a", {"t": table((1, "old"), (2, "old"))})
    commits.write_batch(spark, path, "b", {"t": table((1, "new"), (2, "new"), (2, "again"))})
    found = commits.read_committed(spark, path, "t", ["k"])
    assert "Exchange" not in plan(found) and rows(found, "k", "v") == [(1, "new"), (2, "again"), (2, "new")]
    commits.write_batch(spark, path, "c", {"t": table((2, "last"), (3, "last"))})
    assert rows(commits.read_committed(spark, path, "t", ["k"]), "k", "v") == [(1, "new"), (2, "last"), (3, "last")]


def test_scope_windows_are_dealt_by_lines(spark, monkeypatch):
    monkeypatch.setattr(scopes, "TASK_LINES", 100)
    text = "\n".join(f"class C{i}:\n    def f(self):\n        pass" for i in range(10))
    sources = spark.range(90).selectExpr("id", "'m.py' AS filename", "'python' AS language").withColumn("content", F.lit(text))
    assert scopes.line_tasks(sources) == 27 and scopes.line_tasks(sources.where("false")) == 1
    keys = ["id", "filename"]
    headers = scopes.scope_headers(scopes.code_lines(sources, keys), keys, 27)
    exchanges = [line for line in plan(headers).split("\n") if "Exchange" in line]
    assert len(exchanges) == 1 and ", 27)" in exchanges[0]  # a constant key makes no second one
    assert scopes.scopes(sources, keys).where("name = 'C3.f' AND start_line = 11 AND end_line = 12").count() == 90


def test_local_findings_are_ranked_where_they_are_staged(spark):
    files = spark.createDataFrame([("/a/m.py", "def f(x):\n    eval(x)\n    eval(x)\n")], "review_file string, content string")
    found = review_local(files)["findings"]
    assert "Exchange hashpartitioning" not in plan(found)
    got = found.orderBy("finding_ord").collect()
    assert [r.finding_ord for r in got] == list(range(1, len(got) + 1))
    assert [r.line_start for r in got if r.category == "security"] == [2, 3]


def test_lines_and_scopes_are_dealt_over_the_tasks(spark):
    lines = spark.range(1000).selectExpr("concat('f', id % 10) AS file", "cast(id AS int) AS line")
    scope = spark.range(100).selectExpr("concat('f', id % 10) AS file", "cast(id * 5 AS int) AS start_line", "cast(id * 5 + 4 AS int) AS end_line",
                                        "cast(id AS int) AS visit", "id % 2 = 0 AS is_class").hint("merge")
    dealt = cover.cover(lines, scope, ["file"], 7)
    exchanges = [line for line in plan(dealt).split("\n") if "Exchange" in line]
    assert len(exchanges) == 3 and all(", 7), REPARTITION_BY_NUM" in line for line in exchanges)
    columns = sorted(dealt.columns)
    assert rows(dealt.select(columns), "file", "line", "visit") == rows(cover.cover(lines, scope, ["file"]).select(columns), "file", "line", "visit")


def test_local_review_deals_by_lines(spark, monkeypatch):
    text = "class C:\n    def f(self, a=[]):\n        for x in a:\n            for y in x:\n                time.sleep(5)\n                eval(y)\n"
    files = spark.createDataFrame([(f"/a/m{i}.py", text * (i % 3 + 1)) for i in range(8)] + [("/a/none.py", None)], "review_file string, content string")
    few = review_local(files)["findings"]
    monkeypatch.setattr(scopes, "TASK_LINES", 30)
    seen = []
    deal = cover.dealt
    monkeypatch.setattr(cover, "dealt", lambda df, tasks, *columns: seen.append(tasks) or deal(df, tasks, *columns))
    many = review_local(files)["findings"]
    lines = sum(len((text * (i % 3 + 1)).split("\n")) for i in range(8))
    assert set(seen) == {None, -(-lines // 30)}  # headers meet classes without
    order = ["review_file", "finding_ord"]
    assert few.columns == many.columns and rows(few, *order) == rows(many, *order) and few.count() > 8
