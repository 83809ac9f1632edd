import json

import pytest
from pyspark.sql import functions as F

from hunkwise import schemas
from hunkwise.plans.local import review_local
from hunkwise.plans.review import enrich, review
from hunkwise.session import checkpoint_dir
from hunkwise.sources import tables
from tests.conftest import rows

RK = ("org/repo", 42, "abc1234567890")
CLEAN = 'def safe(a: int, b: int) -> int:\n    """Clean."""\n    return a + b\n'
BAD = ('def insecure_login(user, passw, cache=[]):\n    api_key = "secret_abcdef1234567890"\n'
       '    query = f"SELECT * FROM users WHERE username = \'{user}\'"\n    cursor.execute(query)\n    return True\n')


def added(text, start=1):
    body = text.rstrip("\n").split("\n")
    return f"@@ -0,0 +{start},{len(body)} @@\n" + "\n".join("+" + line for line in body)


def context(spark, *keys):
    return spark.createDataFrame(
        [(1, k[0], "https://example.org/r.git", k[1], "Title", k[2], "feature", "main", "octocat", 1, 0, 1) for k in keys], schemas.REVIEW_CONTEXT_DDL)


def files(spark, *items):
    return spark.createDataFrame([(*k, o, n, None, s, 1, 0, p) for k, o, n, s, p in items], schemas.PR_FILES_DDL)


def sources(spark, *items):
    return spark.createDataFrame([(k[0], k[2], n, c) for k, n, c in items], schemas.SOURCES_DDL)


def test_enrichment(spark):
    patch = '@@ -1,4 +1,6 @@\n def login(user, password):\n+    if not user:\n+        raise ValueError("Invalid user")\n     return True\n'
    content = 'def login(user, password):\n    if not user:\n        raise ValueError("Invalid user")\n    return True\n'
    got = enrich(
        context(spark, RK),
        files(spark, (RK, 0, "src/auth.py", "modified", patch), (RK, 1, "poetry.lock", "modified", "@@ -1,1 +1,1 @@\n-old\n+new")),
        sources(spark, (RK, "src/auth.py", content)))
    (f,) = got.files.collect()
    assert (f.filename, f.language, f.changed_lines, f.unscoped_lines) == ("src/auth.py", "python", [2, 3], [])
    (s,) = got.symbols.collect()
    assert (s.name, s.node_type, s.modified_lines) == ("login", "function_definition", [2, 3])
    size = got.sizes().first()
    assert (size.n_files, size.symbols_modified) == (1, 1)
    assert size.estimated_tokens == (len(patch) + len(content.rstrip("\n"))) // 4
    prompt = "\n".join(r.text for r in got.prompts().orderBy("block_ord").collect())
    assert "```symbol:login (Type: function_definition, Lines 1-4, Modified Lines: [2, 3])\ndef login" in prompt


@pytest.fixture(scope="module")
def reviewed(spark):
    clean, bad, gone = ("org/repo", 1, "s1"), ("org/repo", 2, "s2"), ("org/repo", 3, "s3")
    pr_files = files(
        spark, (clean, 0, "src/math.py", "added", added(CLEAN)), (bad, 0, "src/auth.py", "added", added(BAD)),
        (bad, 1, "notes.txt", "added", added('password = "hunter2hunter2"')),
        (bad, 2, "vendor/x.py", "added", added("eval(x)")),
        (gone, 0, "src/old.py", "removed", "@@ -1 +1 @@\n+eval(x)"), (gone, 1, "src/lost.py", "modified", added("print(1)\neval(y)")))
    texts = sources(spark, (clean, "src/math.py", CLEAN), (bad, "src/auth.py", BAD), (gone, "src/old.py", "eval(x)"))
    item = {"file": "src/auth.py", "line_start": 2, "severity": "low", "title": "Same place", "message": "m", "confidence_score": 0.9}
    replies = spark.createDataFrame(
        [(*bad, "security", json.dumps({"summary": "s", "findings": [item, {**item, "line_start": 5, "title": "New"}]})),
         (*clean, "security", json.dumps({"summary": "model fine", "findings": []})), (*clean, "bug_risk", "oops")],
        schemas.MODEL_RESPONSES_DDL)
    return review(context(spark, clean, bad, gone), pr_files, texts, replies)


def test_verdicts(reviewed):
    assert rows(reviewed.verdicts.select("pr_number", "verdict", "total_findings"), "pr_number") == [
        (1, "APPROVE", 0), (2, "REQUEST_CHANGES", 6), (3, "REQUEST_CHANGES", 2)]


def test_findings_in_rank_order(reviewed):
    got = reviewed.findings.where("pr_number = 2").orderBy("finding_ord").select("file", "line_start", "symbol_name", "severity", "title", "origin")
    assert [tuple(r) for r in got.collect()] == [
        ("notes.txt", 1, None, "critical", "Hardcoded Secret / API Token Detected", "rule"),
        ("src/auth.py", 2, "insecure_login", "critical", "Hardcoded Secret / API Token Detected", "rule"),
        ("src/auth.py", 1, "insecure_login", "high", "Mutable Default Argument in Function Definition", "rule"),
        ("src/auth.py", 3, "insecure_login", "high", "SQL Injection Risk via Dynamic String Interpolation", "rule"),
        ("src/auth.py", 5, None, "low", "New", "model"),
        ("src/auth.py", 1, "insecure_login", "info", "Missing Docstring on Public Symbol", "rule"),
    ]
    titles = [r.title for r in got.collect()]
    assert "Same place" not in titles and "New" in titles


def test_unscoped_lines_of_files_without_source(reviewed):
    got = reviewed.findings.where("pr_number = 3").orderBy("file")
    assert [(r.file, r.line_start, r.symbol_name, r.title) for r in got.collect()] == [
        ("src/lost.py", 2, None, "Dangerous `eval` / `exec` Execution"), ("src/old.py", 1, None, "Dangerous `eval` / `exec` Execution")]


def test_agents_and_quarantine(reviewed):
    agents = {(r.pr_number, r.category): r for r in reviewed.agent_results.collect()}
    assert len(agents) == 12
    assert agents[1, "security"].summary == "model fine"
    assert agents[1, "bug_risk"].summary == "Failed to parse LLM response."
    assert agents[2, "security"].n_findings == 4 and not agents[2, "security"].passed
    assert [(r.pr_number, r.category, r.reply_status) for r in reviewed.quarantine.collect()] == [(1, "bug_risk", "not_json")]


def test_texts(reviewed):
    reports = {}
    for r in reviewed.reports().orderBy("block_ord").collect():
        reports[r.pr_number] = reports.get(r.pr_number, "") + r.body
    assert "APPROVED" in reports[1] and "All checks passed!" in reports[1]
    assert "CHANGES REQUESTED" in reports[2]
    subs = {r.pr_number: (r.status, r.event, r.inline_comments_posted) for r in reviewed.submissions().collect()}
    assert subs == {1: ("success", "APPROVE", 0), 2: ("success", "REQUEST_CHANGES", 6), 3: ("success", "REQUEST_CHANGES", 2)}
    assert reviewed.inline_comments().where("pr_number = 2").count() == 6


def test_local_review(spark, tmp_path):
    path = tmp_path / "auth.py"
    path.write_text('SECRET = 1\npassword = "topsecret99"\n' + BAD)
    out = review_local(tables.local_files(spark, str(path)))
    assert rows(out["symbols"].select("name", "start_line", "end_line")) == [("insecure_login", 3, 7)]
    found = out["findings"].collect()
    assert 2 not in [r.line_start for r in found]  # no patch, so nothing outside scopes is scanned
    assert {r.line_start for r in found} == {3, 4, 5}
    assert "Local Simulation Review of auth.py" in out["reports"].first().body and "`00000000`" in out["reports"].first().body
    some = review_local(tables.local_files(spark, str(path)), F.array(F.lit(5)))
    assert {r.line_start for r in some["findings"].collect()} == {5}


def test_whole_tree_diff(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n a\n+b\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-c\n+d\n"
    df = spark.createDataFrame([(1, text)], "k int, diff string")
    assert rows(tables.diff_summary(df, ["k"])) == [(1, 2, 2)]


def test_sink_reads_the_last_write(spark, reviewed, tmp_path):
    path, blocks = str(tmp_path / "reviews"), str(tmp_path / "reports")
    tables.write_reviews(reviewed.verdicts.where("pr_number < 3").withColumn("verdict", F.lit("old")), path)
    for _ in range(2):
        tables.write_reviews(reviewed.verdicts, path)
        tables.write_reviews(reviewed.reports(), blocks)
    got = tables.read_reviews(spark, path)
    assert rows(got.select("pr_number"), "pr_number") == [(1,), (2,), (3,)] and got.where("verdict = 'old'").count() == 0
    assert tables.read_reviews(spark, blocks).count() == reviewed.reports().count()
    assert tables.read_reviews(spark, path, since="2999-01-01").count() == 0


def test_tables_read_with_declared_schema(spark, tmp_path):
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        files(spark, (RK, 0, "a.py", "added", "@@ -1 +1 @@\n+x")).withColumn("extra", F.lit(1)).write.format(fmt).save(path)
        (r,) = tables.read_table(spark, "pr_files", path, fmt).collect()
        assert (r.filename, r.file_ord, r.patch) == ("a.py", 0, "@@ -1 +1 @@\n+x") and "extra" not in r.asDict()


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_custom_agents_and_extra_findings(spark):
    from hunkwise.rules import Rule

    rule = Rule("X-1", "licensing", "high", "Own rule", r"\bGPL\b", "m", None, 0.9, ("GPL",))
    agent = schemas.Agent("LicenseAgent", "licensing", "License", "License", "Fine.", "Flagged ", " item(s).")
    extra = spark.createDataFrame(
        [(*RK, "a.py", 1, 1, None, "licensing", "low", "Elsewhere", "m", None, 0.8, 0)],
        "repo_full_name string, pr_number bigint, head_sha string, file string, line_start int, line_end int, symbol_name string, "
        "category string, severity string, title string, message string, suggested_fix string, confidence_score double, item_ord int")
    src = "def f():\n    x = 1  # GPL\n"
    out = review(context(spark, RK), files(spark, (RK, 0, "a.py", "added", added(src))), sources(spark, (RK, "a.py", src)),
                 rules=[rule], agents=[agent], extra_findings=extra)
    assert sorted(r.title for r in out.findings.collect()) == ["Elsewhere", "Own rule"]
    (a,) = out.agent_results.collect()
    assert (a.agent_name, a.n_findings, a.summary, a.passed) == ("LicenseAgent", 2, "Flagged 2 item(s).", False)
    assert "| **LicenseAgent** | licensing | 2 | Issues Found |" in out.reports().where("block_ord = 0").first().body
    assert out.reviews().count() == 1
    assert out.dry_run().first().inline_comments_count == 2


def test_given_symbols_replace_parsed_ones(spark):
    symbols = spark.createDataFrame([(*RK, "a.go", 1, "Run", "function", None, 1, 2, "doc", False, False)], schemas.SYMBOLS_DDL)
    src = "func Run() {\n eval(x)\n}"
    out = review(context(spark, RK), files(spark, (RK, 0, "a.go", "added", added(src))), sources(spark, (RK, "a.go", src)), symbols=symbols)
    assert [(r.line_start, r.symbol_name) for r in out.findings.collect()] == [(2, "Run")]


def test_stream_to_reviews(spark, tmp_path):
    from hunkwise.streaming.intake import start_intake
    from hunkwise.streaming.reviews import reviewing
    from tests.test_events import PAYLOAD, SECRET, sign

    body = json.dumps(PAYLOAD).encode()
    key = ("shop/till", 731, "77aa10c2e94b5d31")
    landed = str(tmp_path / "in")
    spark.createDataFrame([("1", "pull_request", sign(body), bytearray(body), None), ("2", "pull_request", sign(body), bytearray(body), None)],
                          schemas.PR_EVENTS_DDL).write.parquet(landed)
    stream = tables.read_table_stream(spark, "pr_events", landed)
    on_batch = reviewing(files(spark, (key, 0, "src/auth.py", "added", added(BAD)), (RK, 0, "x.py", "added", added(BAD))),
                         sources(spark, (key, "src/auth.py", BAD)), str(tmp_path / "out"))
    start_intake(stream, SECRET, str(tmp_path / "judged"), str(tmp_path / "ckpt"), on_batch).awaitTermination()
    (r,) = spark.read.parquet(str(tmp_path / "out/reviews")).collect()
    assert (r.pr_number, r.verdict) == (731, "REQUEST_CHANGES")
    blocks = spark.read.parquet(str(tmp_path / "out/reports")).orderBy("block_ord").collect()
    assert len(blocks) == r.total_findings + 2 and "CHANGES REQUESTED" in blocks[0].body
    assert spark.read.parquet(str(tmp_path / "out/inline_comments")).count() == r.total_findings
