import random

import pytest
from pyspark.sql import functions as F

from hunkwise.operators import review
from hunkwise.operators.ranking import rank_in_group
from hunkwise.plans import prompts, report
from hunkwise.schemas import SEVERITIES
from tests.conftest import rows

KEYS = ["review"]
FINDING = ("review int, file string, line_start int, symbol_name string, category string, severity string, title string, message string, "
           "suggested_fix string, confidence_score double, origin string, seq int")


def findings(spark, *items):
    return spark.createDataFrame(list(items), FINDING)


def contexts(spark, *reviews):
    return spark.createDataFrame(
        [(r, r, f"Title {r}", "octocat", "deadbeef9999", "12.5") for r in reviews],
        "review int, pr_number int, pr_title string, author_login string, head_sha string, elapsed_ms string")


A = (1, "b.py", 5, "f", "security", "high", "T1", "M1", "fix", 0.95, "rule", 1)
B = (1, "a.py", 9, None, "code_quality", "low", "T2", "M2", None, 0.88, "rule", 2)
C = (2, "a.py", 1, "", "bug_risk", "medium", "T3", "M3", " ", 0.92, "model", 1)


def test_verdict_and_counts(spark):
    f = findings(spark, A, B, C)
    got = rows(review.verdicts(contexts(spark, 1, 2, 3), f, KEYS), "review")
    assert got == [(1, "REQUEST_CHANGES", 2), (2, "COMMENT", 1), (3, "APPROVE", 0)]


def test_agents(spark):
    summaries = spark.createDataFrame(
        [(1, "security", "s"), (2, "bug_risk", "model text"), (3, "security", ""), (3, "performance", "fine")],
        "review int, category string, summary string")
    got = {(r.review, r.category): r for r in review.agent_results(contexts(spark, 1, 2, 3), findings(spark, A, B, C), KEYS, summaries).collect()}
    assert len(got) == 12
    assert got[1, "security"].summary == "Security Audit flagged 1 potential vulnerability(ies)." and not got[1, "security"].passed
    assert got[1, "code_quality"].summary == "Quality Audit passed with no critical concerns." and got[1, "code_quality"].passed
    assert got[2, "bug_risk"].summary == "model text" and got[2, "bug_risk"].n_findings == 1
    assert got[3, "security"].summary == "Security Audit passed with no critical issues."
    assert got[3, "performance"].summary == "fine"


def test_dedupe_keeps_first_of_many(spark):
    same = spark.range(40_000).selectExpr(
        "1 AS review", "'a' AS file", "1 AS line_start", "'security' AS category", "'t' AS title", "cast(id AS string) AS message",
        "cast(39999 - id AS int) AS seq")
    assert [r.message for r in review.dedupe_findings(same, KEYS).collect()] == ["39999"]


def test_rank_like_a_sort_with_one_hot_review(spark):
    rng = random.Random(2)
    data = [
        (0 if rng.random() < 0.7 else rng.randint(1, 9), rng.choice(["a.py", "a/b.py", "a-b.py", "é.py", "z"]), rng.randint(1, 20_000), None,
         "security", rng.choice([s[0] for s in SEVERITIES]), "t", "m", None, 1.0, "rule", i)
        for i in range(5_000)
    ]
    got = {r.seq: r.finding_ord for r in review.rank_findings(findings(spark, *data), KEYS).collect()}
    order = {s[0]: s[1] for s in SEVERITIES}
    for r in range(10):
        mine = sorted((d for d in data if d[0] == r), key=lambda d: (order[d[5]], d[1], d[2], d[11]))
        assert [got[d[11]] for d in mine] == list(range(1, len(mine) + 1))


def test_rank_does_not_gather_a_group(spark):
    df = spark.range(1000).selectExpr("1 AS g", "id")
    out = rank_in_group(df, ["g"], {"b": F.floor(F.col("id") / 100)}, ["id"], "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number()" in plan
    assert all("b#" in line for line in plan.split("\n") if "Window [row_number()" in line)
    assert out.where("n <> id + 1").count() == 0


EXPECTED_REPORT = """## Change Review — **CHANGES REQUESTED**

**PR #1:** Title 1  
**Author:** @octocat | **Commit:** `deadbeef` | **Analysis Time:** `12.5 ms`

### Review Overview
| Agent | Category | Findings | Status |
|---|---|:---:|:---:|
| **SecurityAgent** | Security | 1 | Issues Found |
| **PerformanceAgent** | Performance | 0 | Pass |
| **LogicBugAgent** | Bug Risk | 0 | Pass |
| **QualityAgent** | Quality | 1 | Pass |

### Detailed Findings

#### 1. `HIGH` **T1** (Security)
- **Location:** `b.py:5` in `f`
- **Details:** M1
- **Recommendation:**
  ```suggestion
  fix
  ```

#### 2. `LOW` **T2** (Quality)
- **Location:** `a.py:9`
- **Details:** M2

---
*Generated by the change review pipeline.*"""

EXPECTED_CLEAR = """## Change Review — **APPROVED**

**PR #3:** Title 3  
**Author:** @octocat | **Commit:** `deadbeef` | **Analysis Time:** `12.5 ms`

### Review Overview
| Agent | Category | Findings | Status |
|---|---|:---:|:---:|
| **SecurityAgent** | Security | 0 | Pass |
| **PerformanceAgent** | Performance | 0 | Pass |
| **LogicBugAgent** | Bug Risk | 0 | Pass |
| **QualityAgent** | Quality | 0 | Pass |

> [!TIP]
> **All checks passed!** No security vulnerabilities, performance bottlenecks, or logic risks were detected in the modified code.

---
*Generated by the change review pipeline.*"""


def reports(spark, f, *reviews, **options):
    ctx = contexts(spark, *reviews)
    blocks = report.report_blocks(ctx, review.verdicts(ctx, f, KEYS), review.agent_results(ctx, f, KEYS), review.rank_findings(f, KEYS), KEYS, **options)
    return in_order(blocks, "body")


def in_order(blocks, text):
    """{review: (block numbers, whole text)}"""
    out = {}
    for r in blocks.orderBy("block_ord").collect():
        numbers, texts = out.setdefault(r.review, ([], []))
        numbers.append(r.block_ord)
        texts.append(r[text])
    return {k: (n, "\n".join(t)) for k, (n, t) in out.items()}


def test_report_text(spark):
    got = reports(spark, findings(spark, A, B, C), 1, 3)
    assert got[1][1] == EXPECTED_REPORT and got[3] == ([0, 1], EXPECTED_CLEAR)


def test_report_blocks_of_a_long_report(spark):
    many = [(1, f"f{i % 7}.py", i, None, "security", "low", f"t{i}", "m", None, 1.0, "rule", i) for i in range(1, 2500)]
    numbers, text = reports(spark, findings(spark, *many), 1)[1]
    assert numbers == list(range(2501)) and text.count("#### ") == 2499


def test_brand(spark):
    brand = report.Brand("H", "F.", "S")
    body = reports(spark, findings(spark, A), 1, brand=brand)[1][1]
    assert body.startswith("## H — ") and body.endswith("\n*F.*")
    assert report.inline_comments(review.rank_findings(findings(spark, A), KEYS), KEYS, brand).first().body.endswith("| S*")


def test_comments(spark):
    fixed = (1, "src/auth.py", 15, "login", "security", "critical", "Hardcoded API Secret", "Secret found.", " os.getenv('API_KEY')\n", 0.98, "rule", 1)
    got = {r.path: r for r in report.inline_comments(review.rank_findings(findings(spark, fixed, B, C), KEYS), KEYS).collect()
           if r.review == 1}
    assert got["src/auth.py"].body == (
        "**[CRITICAL]** **Hardcoded API Secret** (Security Vulnerability) in `login`\n\nSecret found.\n\n"
        "```suggestion\nos.getenv('API_KEY')\n```\n\n> *Confidence: `98%` | Change Review*")
    assert "suggestion" not in got["a.py"].body and got["a.py"].body.endswith("`88%` | Change Review*")
    assert (got["a.py"].comment_ord, got["a.py"].line, got["a.py"].side) == (2, 9, "RIGHT")


@pytest.mark.parametrize("score,percent", [(0.29, 28), (0.95, 95), (0.92, 92), (0.57, 56), (1.0, 100)])
def test_percent_truncates(spark, score, percent):
    row = (*A[:9], score, *A[10:])
    assert f"`{percent}%`" in report.inline_comments(review.rank_findings(findings(spark, row), KEYS), KEYS).first().body
    assert int(score * 100) == percent


def test_submissions(spark):
    f = findings(spark, A, B, C, (4, "x.py", 999, None, "security", "high", "t", "m", None, 1.0, "rule", 1))
    side = spark.createDataFrame([(1, "b.py", 5), (1, "b.py", 5), (1, "a.py", 9), (4, "x.py", 1)], "review int, filename string, line int")
    got = {r.review: r for r in report.submissions(review.verdicts(contexts(spark, 1, 2, 3, 4), f, KEYS), f, side, KEYS).collect()}
    assert (got[1].status, got[1].event, got[1].inline_comments_posted, got[1].note) == ("success", "REQUEST_CHANGES", 2, None)
    assert (got[2].status, got[2].event, got[2].inline_comments_posted) == ("fallback_success", "COMMENT", 0)
    assert (got[3].status, got[3].event, got[3].inline_comments_posted) == ("success", "APPROVE", 0)
    assert (got[4].status, got[4].event, got[4].verdict) == ("fallback_success", "COMMENT", "REQUEST_CHANGES") and got[4].note


def test_submissions_from_ranges(spark):
    """Against a loop: findings on random ranges, across the borders of bins, in a file with one range of a million lines too."""
    rng = random.Random(3)
    ranges = [(k, f"f{rng.randrange(3)}.py", a, a + rng.choice([0, 1, 40, 700])) for k in range(1, 31) for a in (rng.randrange(1, 3000),) for _ in range(2)]
    ranges += [(31, "big.py", 1, 1_000_000), (32, None, 1, 9)]
    rows = []
    for k, name, first, last in ranges:
        rows += [(k, name, rng.randint(first, last), None, "security", rng.choice(["high", "info"]), f"t{i}", "m", None, 1.0, "rule", i) for i in range(2)]
    rows += [(k, "f0.py", 5000, None, "security", "high", "off", "m", None, 1.0, "rule", 9) for k in (4, 9)]
    rows += [(31, "big.py", 999_999, None, "security", "high", "far", "m", None, 1.0, "rule", 9)]
    f = findings(spark, *rows)
    side = spark.createDataFrame(ranges, "review int, filename string, start_line int, end_line int")
    out = report.submissions(review.verdicts(contexts(spark, *range(1, 34)), f, KEYS), f, side, KEYS)
    off = {r[0] for r in rows if not any(s[0] == r[0] and s[1] == r[1] is not None and s[2] <= r[2] <= s[3] for s in ranges)}
    assert {r.review for r in out.collect() if r.status == "fallback_success"} == off and {4, 9, 32} <= off and 31 not in off


def test_prompt_text_and_parts(spark):
    ctx = spark.createDataFrame([(99, 99, "Add payment validation", "acme/api", "alice", "main", "feature/payments", 20, 5)],
                                "review int, pr_number int, pr_title string, repo_full_name string, author_login string, "
                                "base_branch string, head_branch string, additions int, deletions int")
    files = spark.createDataFrame(
        [(99, "services/payment.py", 0, "modified", "python", [12], [1], "@@ -1 +1 @@\n+x"),
         (99, "b.txt", 2, "added", "unknown", [], [], None)],
        "review int, filename string, file_ord int, status string, language string, changed_lines array<int>, "
        "unscoped_lines array<int>, patch string")
    symbols = spark.createDataFrame(
        [(99, "services/payment.py", 1, "P.charge", "function_definition", 10, 25, [12, 13], "def charge():\n    pass")],
        "review int, filename string, visit int, name string, node_type string, start_line int, end_line int, "
        "modified_lines array<int>, code_snippet string")
    numbers, text = in_order(prompts.prompt_corpus(ctx, files, symbols, KEYS), "text")[99]
    assert numbers == [0, 1, 2, 3]
    assert text == """# Pull Request: #99 — Add payment validation
**Repository:** acme/api
**Author:** @alice
**Base Branch:** `main` | **Head Branch:** `feature/payments`
**Changes:** +20 / -5 across 2 file(s)

## Modified Files & Enclosing AST Context:
### File: `services/payment.py` (Status: modified, Language: python)
**Changed line numbers in new file:** `[12]`
#### Enclosing AST Symbols (Functions / Classes):
```symbol:P.charge (Type: function_definition, Lines 10-25, Modified Lines: [12, 13])
def charge():
    pass
```
**Unscoped modified lines (e.g. imports, global config):** `[1]`
#### Git Unified Patch:
```diff
@@ -1 +1 @@
+x
```
---
### File: `b.txt` (Status: added, Language: unknown)
**Changed line numbers in new file:** `[]`
---
""" + prompts.CLOSING
    compact = in_order(prompts.compact_context(ctx, files, symbols, KEYS), "text")[99][1]
    assert compact.startswith("PR Title: Add payment validation\nRepository: acme/api\nAuthor: alice\nModified Files: 2\n---\n### File: `services")
    assert "(lines 10-25, changed lines: [12, 13])" in compact and compact.endswith("(status: added, language: unknown)\n")
    assert [(r.category, r.system_prompt) for r in prompts.prompt_roles(spark, {"security": "S"}).collect()] == [("security", "S")]
    assert prompts.prompt_roles(spark).count() == 4


def test_sizes(spark):
    reviews = contexts(spark, 1, 2)
    files = spark.createDataFrame([(1, "abcdefg"), (1, None)], "review int, patch string")
    snippets = spark.createDataFrame([(1, 5)], "review int, n_chars int")
    assert rows(review.review_sizes(reviews, files, snippets, KEYS), "review") == [(1, 2, 1, 3), (2, 0, 0, 1)]
