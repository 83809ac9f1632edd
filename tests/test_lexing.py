import io
import random
import re
import sysconfig
import tokenize
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hunkwise.functions import lexing
from hunkwise.functions.lexing import INSIDE, REGEX_WORDS

BEFORE = re.compile(r"(?:\A|[=(,:\[!&|?{;+\-*%~^]|=>|\b(?:" + "|".join(REGEX_WORDS) + r"))\s*\Z")


def brace_loop(text):
    """The same by one character at a time."""
    out, stack, i, code = [], [], 0, ""  # code: what stood before, strings as their quotes

    def emit(s):
        nonlocal code
        out.append(s)
        code += s

    while i < len(text):
        c, two, top = text[i], text[i : i + 2], stack[-1] if stack else ""
        if top in ("", "{", "$"):
            if two in ("//", "/*"):
                stack.append(two)
                i += 2
                continue
            if two == "*/":  # no comment is open: two operators
                emit(two)
                i += 2
                continue
            if c in "`\"" or (c == "'" and not (i and text[i - 1].isalnum())):
                stack.append(c)
                emit(c)
            elif c == "/" and BEFORE.search(code.replace(INSIDE, " ")):
                stack.append("/")
                emit('"')
            else:
                emit(c)
                if c == "{":
                    stack.append("{")
                elif c == "}" and stack:
                    stack.pop()
        elif top == "`":
            if c == "\\":
                if text[i + 1 : i + 2] == "\n":
                    emit("\n" + INSIDE)
                i += 1
            elif c == "`":
                stack.pop()
                emit("`")
            elif two == "${":
                stack.append("$")
                emit("{")
                i += 1
            elif c == "\n":
                emit("\n" + INSIDE)
        elif top in "\"'":
            if c == "\\":
                if text[i + 1 : i + 2] == "\n":
                    emit("\n" + INSIDE)
                i += 1
            elif c == top or c == "\n":
                stack.pop()
                emit(top if c == top else top + "\n")
        elif top == "/":
            if c == "\\" and text[i + 1 : i + 2] != "\n":
                i += 1
            elif c == "[":
                stack.append("[")
            elif c in "/\n":
                stack.pop()
                emit('"' if c == "/" else '"\n')
        elif top == "[":
            if c == "\\" and text[i + 1 : i + 2] != "\n":
                i += 1
            elif c == "]" or c == "\n":
                stack.pop()
                if c == "\n":
                    emit("\n")
        elif top == "//":
            if c == "\n":
                stack.pop()
                emit("\n")
        elif two == "*/":
            stack.pop()
            code += " "
            i += 1
        elif c == "\n":
            out.append("\n" + INSIDE)
        i += 1
    return "".join(out)


def blanked(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(8)
    return [r["c"] for r in df.select("n", fn(F.col("t")).alias("c")).orderBy("n").collect()]


def sample(rng, depth=0):
    """Random source made of whole constructs."""
    def inner():
        return "".join(sample(rng, depth + 1) for _ in range(rng.randint(0, 3)))

    word = rng.choice(["a", "b1", "$x", "return", "é", "of"])
    kinds = [lambda: word + " ", lambda: f"'{rng.choice(['', '{', 'x`y', chr(92) + chr(39), '//', '${'])}' ", lambda: f'"{rng.choice(["}", "it is", chr(92) + chr(34), "/*"])}";',
             lambda: f"// {rng.choice(['{', '`', 'don’t', chr(39)])}\n", lambda: f"/* {rng.choice(['}', '`', chr(10) + ' * {', '**', '\\'])} */", lambda: "\n",
             lambda: rng.choice([" = ", " + ", ", ", "(", ") / 2 ", " => ", "; "])]
    if depth < 5:
        kinds += [lambda: "{" + inner() + "}", lambda: "`" + "".join(rng.choice(["text ", "it's {", "}", "\n", "\\`", "\\${", "$", "/", "//x", "${" + inner() + "}"]) for _ in range(rng.randint(0, 4))) + "`",
                  lambda: f"= /{rng.choice(['a{2}', '[/}`]', chr(92) + '/', chr(92) + '//' + 'x'[:0], '[^' + chr(92) + ']]*', '`', '${', 'x*'])}/g "]
    return rng.choice(kinds)()


def test_braces_equal_a_character_loop(spark):
    rng = random.Random(5)
    texts = ["".join(sample(rng) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts = [t if rng.random() < 0.5 else t.replace("${", "$").replace("= /", "= 1/") for t in texts]
    got = blanked(spark, texts, lexing.brace_code)
    assert sum("${" in t for t in texts) > 150 and sum("`" in t and "${" not in t for t in texts) > 150
    for text, code in zip(texts, got):
        marks = "`'\""  # whether an open string at the end of a text is closed does not matter
        assert code.rstrip(marks) == brace_loop(text).rstrip(marks), text
        assert code.count("\n") == text.count("\n")


@pytest.mark.parametrize("text,code", [
    ("const a = `x ${ f({ b: `}` }) } {`;", "const a = `{ f({ b: `` }) }`;"),
    ("a = b / c / d; x = /[/{]/.test(`{`)", 'a = b / c / d; x = "".test(``)'),
    ("return /}/; <p>don't {x}</p>", "return \"\"; <p>don't {x}</p>"),
    ("s = 'it\\\n{'; }", "s = '\n" + INSIDE + "'; }"),
    ("x = `\n{\n` }", "x = `\n" + INSIDE + "\n" + INSIDE + "` }"),
    ("", ""), ("}", "}"), ("plain { }", "plain { }"),
])
def test_brace_examples(spark, text, code):
    assert blanked(spark, [text], lexing.brace_code) == [code]


def test_long_texts_are_read_in_runs(spark):
    text = "x = `${ {a: '}'} }` ; \n" * 4000
    (code,) = blanked(spark, [text], lexing.brace_code)
    assert code == "x = `{ {a: ''} }` ; \n" * 4000


def python_loop(text):
    """By Python's own tokens: strings as their quotes, comments gone."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out, at = [], 0
    for kind, token, (r1, c1), (r2, c2), _ in tokenize.generate_tokens(io.StringIO(text).readline):
        if kind not in (tokenize.STRING, tokenize.COMMENT):
            continue
        a, b = starts[r1 - 1] + c1, starts[r2 - 1] + c2
        out.append(text[at:a])
        if kind == tokenize.STRING:
            prefix = re.match(r"[A-Za-z]*", token).group()
            quote = token[len(prefix)]
            out.append(prefix + quote + ("\n" + INSIDE) * token.count("\n") + quote)
        at = b
    return "".join(out) + text[at:]


def test_python_equals_its_own_tokens(spark):
    names = ["textwrap", "heapq", "shlex", "csv", "fnmatch", "cmd", "sched", "json/scanner", "difflib", "posixpath", "optparse", "copy", "code", "pickle"]
    texts = [(Path(sysconfig.get_paths()["stdlib"]) / f"{n}.py").read_text() for n in names]
    texts = [t for t in texts if not re.search(r"\b[rR]?[fF][rR]?['\"]", t)]  # tokens of f-strings differ between versions
    texts += ['x = """a\n  b""" + \'c\' # d\ny = "\\""\n', "s = 'a\\\nb'\nt = '''\"\"\" ' \\''''\n", "u = ''\nv = \"\"\nw = ''''''\n", "# only\n"]
    assert len(texts) > 9
    for text, code in zip(texts, blanked(spark, texts, lexing.python_code)):
        assert code == python_loop(text)


def test_open_strings_at_the_end(spark):
    assert blanked(spark, ["x = '''a\nb", 'y = "a\\', "z = 'a\nq"], lexing.python_code) == ["x = '\n" + INSIDE + "'", 'y = ""', "z = ''\nq"]
