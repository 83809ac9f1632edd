import random
import re

import pytest
from pyspark.sql import functions as F

from hunkwise.operators import detect, review
from hunkwise.plans import findings as plan
from hunkwise.plans.findings import snippet_findings, with_texts
from hunkwise.rules import LINE_RULES, Rule, numbered, rules_from_table
from registry.inputs import CODE
from tests.conftest import rows

KEYS = ["review"]
SYMBOLS = ("review int, filename string, file_ord int, visit int, name string, node_type string, start_line int, "
           "code_snippet string, docstring string")


def given(spark, snippet, start, changed, name="f", node_type="function_definition", docstring=None):
    symbols = spark.createDataFrame([(1, "a.py", 0, 1, name, node_type, start, snippet, docstring)], SYMBOLS).withColumn(
        "is_async", detect.is_async(F.col("node_type"), F.col("code_snippet")))
    lines = spark.createDataFrame([(1, "a.py", n) for n in changed], "review int, filename string, line int")
    return with_texts(snippet_findings(symbols, lines, KEYS))


def titles(found):
    return sorted((r.line_start, r.title) for r in found.collect())


def passed(spark, found, category):
    agents = review.agent_results(spark.createDataFrame([(1,)], "review int"), found, KEYS)
    return agents.where(F.col("category") == category).first().passed


def test_security(spark):
    code = ('def query_user(user_id):\n    api_key = "secret_1234567890abcdef"\n'
            '    query = f"SELECT * FROM users WHERE id = {user_id}"\n    cursor.execute(query)\n')
    found = given(spark, code, 1, [2, 3])
    assert titles(found.where("category = 'security'")) == [
        (2, "Hardcoded Secret / API Token Detected"), (3, "SQL Injection Risk via Dynamic String Interpolation")]
    assert not passed(spark, found, "security")


def test_performance(spark):
    code = ('async def process_batch(items):\n    time.sleep(5)\n    for item in items:\n'
            '        db.query(f"SELECT * FROM orders WHERE item_id = {item.id}")\n')
    found = given(spark, code, 10, [11, 13], node_type="async_function_definition")
    got = titles(found.where("category = 'performance'"))
    assert [t.split()[0] for _, t in got] == ["Blocking", "Database"]
    assert not passed(spark, found, "performance")


def test_logic(spark):
    code = "def append_item(item, storage=[]):\n    try:\n        storage.append(item)\n    except:\n        pass\n    return storage\n"
    found = given(spark, code, 1, [1, 4])
    assert [n for n, t in titles(found.where("category = 'bug_risk'"))] == [1, 4]
    assert not passed(spark, found, "bug_risk")


def test_quality(spark):
    code = 'def calculate_total(a, b):\n    print(f"Debug: {a}, {b}")\n    return a + b\n'
    found = given(spark, code, 20, [21], docstring="Compute sum")
    assert [t for _, t in titles(found)] == ["Debug `print()` Statement in Production Code"]
    assert passed(spark, found, "code_quality")


@pytest.mark.parametrize("name,docstring,changed,hits", [
    ("f", None, [1], 1), ("f", "", [1], 1), ("f", "x", [1], 0), ("_f", None, [1], 0), ("_F.g", None, [1], 0),
    ("F._g", None, [1], 1), ("f", None, [2], 0)])
def test_missing_docstring(spark, name, docstring, changed, hits):
    found = given(spark, "def f():\n    return 1", 1, changed, name=name, docstring=docstring).where("rule_no = 0")
    got = found.collect()
    assert len(got) == hits
    if hits:
        assert got[0].message == f"Public symbol `{name}` does not have a docstring."
        assert got[0].suggested_fix == f"Add a brief docstring describing the purpose of `{name}`."
        assert got[0].confidence_score == 0.85


NEAR_MISSES = [
    'api_key = "short"', "AKIA123", 'q = "SELECT 1"', "evaluate(x)", "subprocess.run(cmd)", "pickle.dump(x)", "hashlib.sha256(b)",
    "asyncio.sleep(1)", "query = 1", "for x in y", "recompile(x)", "def f(a=None):", "except ValueError:", "x is None", "idx = 1",
    "blueprint(1)", "# TODOS", "PASSWD = 'a.b-c_d1'", "f'drop {x}'", "RAW (\"x delete", "os . system(", "yaml.load( s )",
    "exec  (", "re.compile\t(", "def g(x = [] ):", "except:\t# c", "except Exception : ...", "a ==  None", "type\t=", "print\u00a0(1)",
    "#\u2003FIXME", "éprint(1)", "éid = 1", "Select (", "for\u00a0a in b:", "for a in b:  ",
]


def test_rules_like_python_regexes(spark):
    lines = CODE + NEAR_MISSES
    df = spark.createDataFrame(list(enumerate(lines)), "n int, text string")
    got = {r.n: r.hits for r in detect.with_hits(df, LINE_RULES).collect()}
    fired = set()
    for n, text in enumerate(lines):
        want = [no for no, _, r in numbered(LINE_RULES) if re.search(r.pattern, text)]
        assert got[n] == want, text
        fired.update(want)
    assert fired == set(range(1, 18))


def test_needles_never_hide_a_match():
    rng = random.Random(3)
    words = " ".join(CODE + NEAR_MISSES).split(" ")
    for _ in range(20_000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        for r in LINE_RULES:
            if re.search(r.pattern, text):
                for needle in r.needles:
                    options = needle if isinstance(needle, tuple) else (needle,)
                    assert any(o in text for o in options), (r.rule_id, text)


def test_loop_depth_like_a_loop(spark):
    rng = random.Random(7)
    pool = ["for a in b:", "    for a in b:", "        while x:", "x = 1", "    y", "        z", "", "  ", "        ", "async for q in w:", "\tfor c in d:"]
    scopes = {v: [rng.choice(pool) for _ in range(rng.randint(1, 60))] for v in range(40)}
    df = spark.createDataFrame([(v, n, t) for v, ls in scopes.items() for n, t in enumerate(ls)], "visit int, line int, text string")
    out = detect.with_loop_depth(df.withColumn("step", detect.loop_step(F.col("text"))), ["visit"])
    got = {(r.visit, r.line): r.loop_depth for r in out.collect()}
    for v, ls in scopes.items():
        depth = 0
        for n, text in enumerate(ls):
            if text.strip().startswith(("for ", "while ")):
                depth += 1
            elif len(text) - len(text.lstrip()) <= 4:
                depth = max(0, depth - 1)
            assert got[v, n] == depth, (v, n)


def test_custom_rules(spark):
    table = spark.createDataFrame(
        [("X-1", "security", "high", "Custom", r"\bfoo\d+", "m", None, 0.8)],
        "rule_id string, category string, severity string, title string, pattern string, message string, suggested_fix string, confidence double")
    rules = rules_from_table(table)
    df = spark.createDataFrame([(1, "foo1 bar"), (2, "foo"), (3, "xfoo2")], "n int, text string")
    assert rows(detect.scan_text(df, rules).select("n", "rule_id", "severity")) == [(1, "X-1", "high")]
    assert detect.scan_text(df, []).count() == 0


def test_rule_tables_may_be_long_and_carry_guards(spark):
    ddl = "rule_id string, category string, severity string, title string, pattern string, message string, suggested_fix string, confidence double, needs_async boolean, min_loop_depth int"
    table = spark.createDataFrame([(f"R{i}", "quality", "low", f"t{i}", rf"\bword{i}\b", "m", None, 0.5, i == 3 or None, 2 if i == 4 else None) for i in range(1200)], ddl)
    rules = rules_from_table(table)
    by_id = {r.rule_id: r for r in rules}
    assert len(rules) == 1200 and by_id["R3"].needs_async and not by_id["R2"].needs_async and (by_id["R4"].min_loop_depth, by_id["R5"].min_loop_depth) == (2, 0)
    df = spark.createDataFrame([(1, "word7 word1100 word3000"), (2, "none")], "n int, text string")
    assert rows(detect.scan_text(df, rules).select("n", "rule_id"), "rule_id") == [(1, "R1100"), (1, "R7")]


def test_class_scanned_again_and_class_name_wins(spark):
    """A kept class reports its methods' lines too; counts include both, the dedupe keeps the class."""
    content = "class K:\n    size = 1\n    def m(self):\n        eval(x)\n"
    keys, file_keys = ["review"], ["review", "filename"]
    src = spark.createDataFrame([(1, "a.py", "python", content)], "review int, filename string, language string, content string")
    from hunkwise.operators.scopes import scopes

    changed = spark.createDataFrame(
        [(1, "a.py", 0, 2, "    size = 1"), (1, "a.py", 0, 4, "        eval(x)")], "review int, filename string, file_ord int, line int, text string")
    found = plan.rule_findings(changed, scopes(src, file_keys), src, keys)
    assert sorted(r.symbol_name for r in found.where("line_start = 4").collect()) == ["K", "K.m"]
    unique = review.dedupe_findings(found, keys)
    assert [r.symbol_name for r in unique.where("line_start = 4").collect()] == ["K"]
    only_method = plan.rule_findings(changed.where("line = 4"), scopes(src, file_keys), src, keys)
    assert [r.symbol_name for r in only_method.collect()] == ["K.m"]


def test_line_text_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame([(1, "a.py", 0, "@@ -1 +1,2 @@\n+eval(x)\n+y")], "review int, filename string, file_ord int, patch string").write.parquet(path)
    from hunkwise.operators.cover import cover
    from hunkwise.operators.diff import changed_lines

    keys = ["review", "filename"]
    symbols = spark.createDataFrame([(1, "a.py", 1, "f", 1, 1, False, False, False)],
                                    "review int, filename string, visit int, name string, start_line int, end_line int, "
                                    "is_class boolean, is_async boolean, undocumented boolean")
    lines = detect.with_hits(changed_lines(spark.read.parquet(path), [*keys, "file_ord"]), LINE_RULES).drop("text")
    hits = plan.hit_rows(cover(lines, symbols, keys), LINE_RULES)
    plan_text = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan_text
    assert rows(hits.select("line", "name", "rule_id")) == [(1, "f", "SEC-004")]
    for part in plan_text.split("Exchange hashpartitioning")[1:]:
        below = part.split("\n")[1]
        assert "raw" not in below.split("AS hits")[-1]
