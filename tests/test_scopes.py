import ast
import random
import sysconfig
from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import rows
from hunkwise.operators import cover, scopes
from hunkwise.plans.findings import scope_columns

KEYS = ["filename"]
ADD = '''import sys

def add(a: int, b: int) -> int:
    """Add two numbers."""
    return a + b

def multiply(a: int, b: int) -> int:
    return a * b
'''
SERVICE = '''class UserService:
    """Service managing user accounts."""

    def __init__(self, db):
        self.db = db

    def register(self, email: str, password: str):
        if not email:
            raise ValueError("Email required")
        return self.db.create_user(email, password)

def helper():
    return True
'''
MIXED = "import os\nimport json\n\nDEFAULT_TIMEOUT = 30\n\ndef fetch(url: str):\n    return True\n"
JS = '''class PaymentGateway {
  processPayment(amount) {
    return true;
  }
}

const formatCurrency = (val) => {
  return `$${val}`;
};

function init() {
  console.log("ready");
}
'''


def enriched(spark, content, language, changed):
    """Kept scopes with their lines, and the unscoped lines."""
    src = spark.createDataFrame([("f", language, content)], "filename string, language string, content string")
    symbols = scopes.with_source_text(scopes.scopes(src, KEYS), src, KEYS)
    lines = spark.createDataFrame([("f", n) for n in changed], "filename string, line int")
    covered = cover.cover(lines, scope_columns(symbols, KEYS), KEYS)
    own = cover.symbol_order(cover.modified_lines(covered, KEYS), KEYS)
    kept = own.drop("name", "start_line", "end_line").join(symbols, ["filename", "visit"]).orderBy("symbol_ord").collect()
    return kept, [r.line for r in cover.unscoped_lines(covered, KEYS).orderBy("line").collect()]


def test_python_function(spark):
    (s,), loose = enriched(spark, ADD, "python", [5])
    assert (s.name, s.node_type, s.start_line, s.end_line, s.docstring) == ("add", "function_definition", 3, 5, "Add two numbers.")
    assert s.modified_lines == [5] and loose == [] and s.documented
    assert s.code_snippet == "\n".join(ADD.split("\n")[2:5])


def test_python_method(spark):
    (s,), loose = enriched(spark, SERVICE, "python", [9])
    assert (s.name, s.parent_symbol, s.node_type, s.start_line, s.end_line) == (
        "UserService.register", "UserService", "function_definition", 7, 10)
    assert s.modified_lines == [9] and loose == []
    assert s.code_snippet.startswith("def register(")


def test_scoped_and_unscoped(spark):
    (s,), loose = enriched(spark, MIXED, "python", [1, 6])
    assert (s.name, s.modified_lines, loose) == ("fetch", [6], [1])


def test_javascript(spark):
    kept, loose = enriched(spark, JS, "javascript", [3, 8])
    assert [(s.name, s.node_type) for s in kept] == [
        ("PaymentGateway.processPayment", "method_definition"), ("formatCurrency", "arrow_function")]
    assert loose == []


def test_other_language(spark):
    assert enriched(spark, 'fn main() { println!("hello"); }', "rust", [1]) == ([], [1])


def test_class_keeps_only_what_its_methods_leave(spark):
    kept, loose = enriched(spark, SERVICE, "python", [1, 2, 5, 9, 12])
    assert [(s.name, s.modified_lines) for s in kept] == [
        ("UserService", [1, 2]), ("UserService.__init__", [5]), ("UserService.register", [9]), ("helper", [12])]
    assert loose == []


NESTED = '''class A(
    Base,
):
    """Doc

    of A.
def not_a_def(): inside the string
    """
    attr = 1
    @deco
    def m(
        self,
    ):
        def inner():
            pass
        return inner
# a comment at the left margin
    class B:
        async def q(self): return 1

        def _r(self):
            x = """
left text
"""
            return x
            # tail
if A:
    def hidden():
        pass

async def last():
    """"""
    await z
'''


def test_nested_python(spark):
    src = spark.createDataFrame([("f", "python", NESTED)], "filename string, language string, content string")
    got = rows(scopes.with_source_text(scopes.scopes(src, KEYS), src, KEYS).select(
        "name", "parent_symbol", "start_line", "end_line", "docstring", "documented", "is_async", "visit"), "visit")
    assert got == [
        ("A.m", "A", 11, 16, None, False, False, 1),
        ("A.B.q", "A.B", 19, 19, None, False, True, 2),
        ("A.B._r", "A.B", 21, 26, None, False, False, 3),
        ("A.B", "A", 18, 26, None, False, True, 4),
        ("A", None, 1, 26, "Doc\n\n    of A.\ndef not_a_def(): inside the string", True, True, 5),
        ("last", None, 31, 33, "", False, True, 6),
    ]


TS = '''import x from "x";

/**
 * Makes.
 */
export class Maker extends Base {
  static async make(a: number): Promise<void> {
    if (a) {
      await go({ a });
    }
  }

  /** Gets. */
  get size() { return 1; }
}
const one = x => x + 1;
/** Two. */
const two = async function (a) {
  return a;
};
if (flag) {
  function hidden() {
  }
}
'''


def test_typescript(spark):
    src = spark.createDataFrame([("f", "typescript", TS)], "filename string, language string, content string")
    got = rows(scopes.with_source_text(scopes.scopes(src, KEYS), src, KEYS).select(
        "name", "node_type", "start_line", "end_line", "docstring", "is_async", "visit"), "visit")
    assert got == [
        ("Maker.make", "method_definition", 7, 11, None, True, 1),
        ("Maker.size", "method_definition", 14, 14, "/** Gets. */", False, 2),
        ("Maker", "class_declaration", 6, 15, None, True, 3),
        ("one", "arrow_function", 16, 16, None, False, 4),
        ("two", "function_expression", 18, 20, "/** Two. */", True, 5),
    ]


ARROWS = '''const App = () => (
  <ul>
    {items.map(i => (
      <li>{i}</li>
    ))}
  </ul>
);
export const wide = async (
  a,
  b,
) => {
  return a + b;
};
const total = (
  a,
) => a + 1;
const next = (a) =>
  a + 1;
const value = (
  1 + 2
);
let plain = 5;
'''


def test_arrow_functions_over_several_lines(spark):
    src = spark.createDataFrame([("f", "javascript", ARROWS)], "filename string, language string, content string")
    got = rows(scopes.scopes(src, KEYS).select("name", "node_type", "start_line", "end_line", "is_async"), "start_line")
    assert got == [
        ("App", "arrow_function", 1, 7, False), ("wide", "arrow_function", 8, 13, True),
        ("total", "arrow_function", 14, 16, False), ("next", "arrow_function", 17, 18, False)]


def test_cover_like_a_loop(spark):
    """Random nested classes and functions over several bins, against plain loops."""
    rng = random.Random(11)
    symbols, lines = [], []
    for f in range(6):
        spans, visit = [], 0

        def grow(lo, hi, depth):
            nonlocal visit
            at = lo
            while at < hi and rng.random() < 0.9:
                a = rng.randint(at, hi)
                b = rng.randint(a, min(hi, a + (900 if depth == 0 else 150)))
                is_class = rng.random() < 0.5
                if is_class and depth < 3:
                    grow(a + 1, b, depth + 1)
                visit += 1
                spans.append((visit, a, b, is_class))
                at = b + 1

        grow(1, 3000, 0)
        symbols += [(f"f{f}", v, f"s{v}", a, b, c, False, False) for v, a, b, c in spans]
        lines += [(f"f{f}", n) for n in sorted(rng.sample(range(1, 3100), 500))]
    sdf = spark.createDataFrame(symbols, "filename string, visit int, name string, start_line int, end_line int, "
                                         "is_class boolean, is_async boolean, undocumented boolean")
    ldf = spark.createDataFrame(lines, "filename string, line int")
    covered = cover.cover(ldf, sdf, KEYS)
    want, loose = {}, []
    by_file = {}
    for s in symbols:
        by_file.setdefault(s[0], []).append(s)
    for f in sorted({g for g, _ in lines}):
        taken = set()
        mine = [n for g, n in lines if g == f]
        for _, v, _, a, b, is_class, _, _ in sorted(by_file.get(f, []), key=lambda s: s[1]):
            inside = [n for n in mine if a <= n <= b and not (is_class and n in taken)]
            if inside:
                want[f, v] = inside
                taken |= set(inside)
        loose += [(f, n) for n in mine if n not in taken]
    assert {(r.filename, r.visit): r.modified_lines for r in cover.modified_lines(covered, KEYS).collect()} == want
    assert rows(cover.unscoped_lines(covered, KEYS), "filename", "line") == loose
    kept = covered.where("kept").select("filename", "visit").distinct()
    assert {(r.filename, r.visit) for r in kept.collect()} == set(want)
    assert covered.where(F.col("visit").isNotNull()).groupBy("filename", "line", "visit").count().where("count > 1").count() == 0



def _found(spark, language, text):
    source = spark.createDataFrame([("f", language, text)], "filename string, language string, content string")
    return sorted((r["name"], r["start_line"], r["end_line"]) for r in scopes.scopes(source, KEYS).collect())


def test_braces_in_strings_and_comments(spark):
    text = """class A {
  a() {
    const s = "{";  // opens {
    const t = '}' + `{ ${1} {`; /* { */
    it("don't {");
  }
  b() {
    return `
      text } } {
      more`;
  }
}
function top() {
  // }
}"""
    assert _found(spark, "javascript", text) == [("A", 1, 12), ("A.a", 2, 6), ("A.b", 7, 11), ("top", 13, 15)]


def test_triple_quotes_in_comments_and_strings(spark):
    quote = '"""'
    text = f"""def f():
    # uses {quote} here
    x = '{quote}'
    y = 1

def g():
    {quote}doc
    def inner(): # not code
    {quote}
    return {quote}one line{quote}

def h():
    pass"""
    assert _found(spark, "python", text) == [("f", 1, 4), ("g", 6, 10), ("h", 12, 13)]


def test_patterns_are_linear_and_do_not_recurse(spark):
    n = 100_000
    bodies = ["x(" + "a" * n + ";", "x(" + "a)" * n + ";", "const x = (" + "a(b)" * n, "const x = (" + "a(b)" * n + ") => 1", "static " * n + "x(", "'" * n, "'\\" * n,
              "`" * (n + 1), "/*" * n, '"' * (n + 1), "\\\"" * n, " " * n + "x(", "x" + " " * n + "(", "get " * n, "const x : " + "a" * n, "{" * n, "export " * n, "( " * n]
    text = "\n".join(bodies)
    for language in ("javascript", "python"):
        source = spark.createDataFrame([("f", language, text)], "filename string, language string, content string")
        lines = scopes._line_features(scopes.code_lines(source, KEYS), KEYS)
        assert lines.select("line").distinct().count() == len(bodies)
        assert len({r.line for r in lines.collect()}) == len(bodies)


def test_several_definitions_on_a_line(spark):
    text = """class A { m(a) { return { b: 1 }; } async n() { if (a) { f(); } } get p() { return 1 } }
function f() { return 1; } function g() { return `${ { a: '}' } }`; }
export class B { k() {
    x(); } l() { } }
const h = () => { a(); }; class C { static s() { class Inner { no() { } } } }
"""
    source = spark.createDataFrame([("f", "javascript", text)], "filename string, language string, content string")
    got = [(r.name, r.start_line, r.end_line) for r in scopes.scopes(source, KEYS).orderBy("visit").collect()]
    assert got == [("A.m", 1, 1), ("A.n", 1, 1), ("A.p", 1, 1), ("A", 1, 1), ("f", 2, 2), ("g", 2, 2), ("B.k", 3, 4), ("B.l", 4, 4), ("B", 3, 4),
                   ("h", 5, 5), ("C.s", 5, 5), ("C", 5, 5)]


def test_templates_and_regex_literals_in_bodies(spark):
    text = """class A {
  a(x) {
    const q = `${ x.map((y) => { return `<${ y }>}`; }) } } {{`;
    return /[}/]{2}/.test(q) ? a / b / c : `
  not() { }
`;
  }
  b() {
    return "it's {" + 'x}' /* { */;
  }
}
function top() { // {
  return `}`;
}"""
    assert _found(spark, "javascript", text) == [("A", 1, 11), ("A.a", 2, 7), ("A.b", 8, 10), ("top", 12, 14)]


def _by_ast(text):
    """(name, first line, last line, docstring) of module- and class-level definitions, by Python's own parser."""
    out = []

    def visit(body, outer):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = ".".join([*outer, node.name])
                out.append((name, node.lineno, node.end_lineno, ast.get_docstring(node, clean=False)))
                if isinstance(node, ast.ClassDef):
                    visit(node.body, [*outer, node.name])

    visit(ast.parse(text).body, [])
    return sorted(out, key=lambda r: r[:3])


AWKWARD_PYTHON = r'''class A(Base,
    metaclass=M):
    x = {
"def": """
def no():
    @@@ still inside
""",
}
    def one(self, a="(", b=@@@"""@@@): return a  # "
    def two(
self,
    ) -> dict[
  str, int]:
        r"""Raw \ doc.

end."""
        return f(
1, """
class No: pass
""")
    y = 1 + \
2
    async def three(self):
        "plain doc"
        def inner(): pass
        return """a""" @@@
def no2(): pass
@@@
def four(): pass
class E: """One line."""
if x:
    def hidden(): pass
class F:
    def five(self):
        """Doc \"""  quoted."""
        x = "\
def no3():"
'''.replace("@@@", "'''")


def test_python_scopes_equal_its_own_parser(spark):
    names = ["textwrap", "heapq", "shlex", "csv", "cmd", "json/decoder", "difflib", "optparse", "argparse", "dataclasses", "inspect", "typing", "pickle", "_pydecimal"]
    texts = {n: (Path(sysconfig.get_paths()["stdlib"]) / f"{n}.py").read_text() for n in names} | {"awkward": AWKWARD_PYTHON}
    source = spark.createDataFrame([(n, "python", t) for n, t in texts.items()], "filename string, language string, content string").repartition(8)
    got = {}
    for r in scopes.with_source_text(scopes.scopes(source, KEYS), source, KEYS).collect():
        got.setdefault(r.filename, []).append((r.name, r.start_line, r.end_line, r.docstring, r.documented))
    for n, text in texts.items():
        lines, mine = text.split("\n"), sorted(got[n], key=lambda r: r[:3])
        want = _by_ast(text)
        assert [r[:2] for r in mine] == [r[:2] for r in want], n
        for (name, _, end, doc, documented), (_, first, last, wanted) in zip(mine, want):
            # comments behind the last statement count as part of the scope here
            assert end >= last and all(not line.strip() or line.lstrip().startswith("#") for line in lines[last:end]), (n, name, end, last)
            one_line = wanted is not None and text.split("\n")[first - 1].rstrip().endswith(('"', "'"))
            if not one_line:
                assert documented == bool(wanted and wanted.strip()), (n, name)
