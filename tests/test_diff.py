import random
import re

import pytest

from hunkwise.operators import diff

ONE = "@@ -1,5 +1,6 @@\n import os\n+import sys\n \n def hello():\n-    return 1\n+    return 2\n"
TWO = ('@@ -10,3 +10,4 @@\n def first():\n+    print("new line")\n     return 1\n@@ -50,4 +51,5 @@\n def second():\n'
       "-    old()\n+    new_call()\n+    extra_line()\n")


def frame(spark, *patches):
    return spark.createDataFrame(list(enumerate(patches)), "k int, patch string")


def test_line_lists(spark):
    got = diff.with_line_lists(frame(spark, ONE, TWO, "", "  \n", None, "@@ -1 +1 @@")).orderBy("k").collect()
    assert [r.changed_lines for r in got[:4]] == [[2, 5], [11, 52, 53], [], []]
    assert [r.deleted_lines for r in got[:4]] == [[4], [51], [], []]
    assert got[5].changed_lines == []


def test_hunks(spark):
    got = diff.diff_hunks(frame(spark, "diff --git a b\n" + ONE, "@@ -3 +4,0 @@  def f():  \n+a"), ["k"]).orderBy("k", "hunk").collect()
    a, b = got
    assert (a.old_start, a.old_lines, a.new_start, a.new_lines, a.header) == (1, 5, 1, 6, "")
    assert a.lines[0] == "@@ -1,5 +1,6 @@" and len(a.lines) == 7 and a.modified_new_lines == [2, 5]
    assert (b.old_start, b.old_lines, b.new_start, b.new_lines, b.header) == (3, 1, 4, 0, "def f():")


def walk(patch):
    """Plain state machine over one patch: (hunk, kind, old, new, text) per line below a header."""
    out, hunk, old, new = [], 0, 0, 0
    header = re.compile(r"@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@(?:\s+.*)?$")
    for text in patch.splitlines():
        m = header.match(text)
        if m:
            hunk, old, new = hunk + 1, int(m[1]), int(m[2])
        elif hunk:
            sign = text[:1] if text[:3] not in ("+++", "---") else " "
            if sign == "\\":
                out.append((hunk, "meta", None, None, text))
                continue
            kind = {"+": "add", "-": "del"}.get(sign, "ctx")
            out.append((hunk, kind, None if kind == "add" else old, None if kind == "del" else new, text))
            old, new = old + (kind != "add"), new + (kind != "del")
    return out


def random_patch(rng):
    lines = []
    for _ in range(rng.randint(0, 40)):
        lines.append(rng.choice([
            "+a", "-b", " c", "", "+++", "+++ x", "---", "--- y", "\\ No newline at end of file", "diff --git a/x b/x",
            f"@@ -{rng.randint(0, 99)},{rng.randint(0, 9)} +{rng.randint(0, 99)},3 @@ h", "@@ -1 +2 @@", "@@ -1 +2 @@x", "@@bad",
            "+tab\tx", "+é", "  ",
        ]))
    breaks = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    return "".join(t + rng.choice(breaks) for t in lines)[: None if rng.random() < 0.5 else -1]


@pytest.fixture(scope="module")
def patches():
    rng = random.Random(5)
    return [random_patch(rng) for _ in range(300)]


def test_lines_like_a_walk(spark, patches):
    df = frame(spark, *patches).repartition(4)
    got = {}
    for r in diff.diff_lines(df, ["k"]).where("kind <> 'hdr'").orderBy("k", "hunk", "pos").collect():
        got.setdefault(r.k, []).append((r.hunk, r.kind, r.old_line, r.new_line, r.line))
    for k, patch in enumerate(patches):
        assert got.get(k, []) == walk(patch), repr(patch)


def test_lists_like_a_walk(spark, patches):
    got = {r.k: r for r in diff.with_line_lists(frame(spark, *patches)).collect()}
    added = {}
    for r in diff.changed_lines(frame(spark, *patches), ["k"]).collect():
        added.setdefault(r.k, []).append((r.line, r.text))
    sides = {}
    for r in diff.new_side_lines(frame(spark, *patches), ["k"]).collect():
        sides.setdefault(r.k, []).append(r.line)
    for k, patch in enumerate(patches):
        steps = walk(patch)
        assert got[k].changed_lines == [s[3] for s in steps if s[1] == "add"]
        assert got[k].deleted_lines == [s[2] for s in steps if s[1] == "del"]
        assert sorted(added.get(k, [])) == sorted((s[3], s[4][1:]) for s in steps if s[1] == "add")
        assert sorted(sides.get(k, [])) == sorted(s[3] for s in steps if s[1] in ("add", "ctx"))


def test_from_a_file_without_shuffle(spark, patches, tmp_path):
    path = str(tmp_path / "patches")
    frame(spark, *patches).write.parquet(path)
    df = spark.read.parquet(path)
    for out in [diff.changed_lines(df, ["k"]), diff.diff_lines(df, ["k"]), diff.with_line_lists(df), diff.diff_hunks(df, ["k"])]:
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() > 0


def test_one_hunk_of_many_lines(spark):
    patch = "@@ -0,0 +1,200000 @@\n" + "\n".join(f"+line {i}" for i in range(200_000))
    df = frame(spark, patch)
    assert diff.changed_lines(df, ["k"]).selectExpr("count(*)", "max(line)", "count(distinct line)").first()[:] == (200_000, 200_000, 200_000)


def test_ranges_hold_the_same_lines(spark, patches):
    df = frame(spark, *patches)
    want = {(r.k, r.line) for r in diff.new_side_lines(df, ["k"]).collect()}
    ranges = diff.new_side_ranges(df, ["k"])
    found = ranges.collect()
    assert {(r.k, n) for r in found for n in range(r.start_line, r.end_line + 1)} == want and want
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == diff.diff_hunks(df, ["k"])._jdf.queryExecution().executedPlan().toString().count("Generate")


def test_range_edges(spark):
    only_deleted, empty, huge = "@@ -1,2 +5,0 @@\n-a\n-b", "@@ -1 +1 @@", "@@ -1 +99999999999 @@\n+a"
    got = diff.new_side_ranges(frame(spark, only_deleted, empty, huge, None, "", "@@ -0,0 +7,3 @@\n+a\n\\ x\n b\n-c\n+d"), ["k"]).collect()
    assert [tuple(r) for r in got] == [(5, 7, 9)]
