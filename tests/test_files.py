from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hunkwise.operators import files

LANGUAGES = {
    "src/main.py": "python", "app/index.js": "javascript", "components/Button.tsx": "typescript",
    "server/main.go": "go", "unknown.xyz123": "unknown", "A/B.PYI": "python", "Makefile": "unknown", ".bashrc": "unknown",
}
IGNORED = {
    "package-lock.json": True, "poetry.lock": True, "sub/dir/yarn.lock": True, "assets/logo.png": True, "build/app.exe": True,
    "fonts/inter.woff2": True, "dist/bundle.min.js": True, "node_modules/express/index.js": True, ".venv/lib/site.py": True,
    "src/auth.py": False, "frontend/src/App.tsx": False, "src/vendor": True, "Src/BUILD": True, "a.min.css": True,
    "a.min.py": False, "x/Cargo.LOCK": True, "builds/a.py": False,
}


def test_language(spark):
    df = spark.createDataFrame(list(LANGUAGES.items()), "f string, want string")
    assert df.where(files.language(F.col("f")) != F.col("want")).count() == 0


def test_ignored(spark):
    df = spark.createDataFrame(list(IGNORED.items()), "f string, want boolean")
    assert [r.f for r in df.where(files.is_ignored(F.col("f")) != F.col("want")).collect()] == []


NAMES = st.lists(st.text(alphabet="ab./", max_size=10), min_size=30, max_size=60)


@given(names=NAMES)
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_names_and_suffixes_like_pathlib(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = df.select("f", files.base_name(F.col("f")).alias("b"), files.suffix(F.col("f")).alias("s")).collect()
    for r in got:
        path = PurePosixPath(r.f)
        name = path.name
        dot = name.rfind(".")
        assert (r.b, r.s) == (name, name[dot:] if 0 < dot < len(name) - 1 else ""), r.f


def test_defaults_and_gate(spark):
    df = spark.createDataFrame(
        [("a.py", None, None, 2, ""), ("b.py", "", 1, None, "@@ -1 +1 @@\n+x"), ("c.py", "removed", 0, 0, "@@ -1 +1 @@\n+x"),
         ("yarn.lock", "added", 1, 1, "@@ -1 +1 @@\n+x")],
        "filename string, status string, additions int, deletions int, patch string")
    from hunkwise.operators.diff import with_line_lists

    out = {r.filename: r for r in with_line_lists(files.reviewable(df)).collect()}
    assert sorted(out) == ["a.py", "b.py", "c.py"]
    assert (out["a.py"].status, out["a.py"].additions, out["a.py"].patch) == ("modified", 0, None)
    assert (out["b.py"].status, out["b.py"].deletions) == ("modified", 0)
    gated = files.parse_gate(with_line_lists(files.reviewable(df)))
    assert [r.filename for r in gated.collect()] == ["b.py"]


@pytest.mark.parametrize("name,parts", [("a//./b", ["a", "b"]), ("A/B", ["a", "b"])])
def test_parts(spark, name, parts):
    assert spark.range(1).select(files.path_parts(F.lit(name))).first()[0] == parts
