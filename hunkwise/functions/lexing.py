"""Source text as code: strings, comments, templates and regex literals blanked, line by line.

The result has as many lines as the text. A string keeps its quotes only (a regex literal becomes two double quotes), a comment goes, and a
line that begins inside a string, template text or block comment starts with INSIDE. What stands in the ``${}`` parts of a template is
code like any other, with the braces of the part.

Python needs one linear pattern. JavaScript templates nest without a limit, so texts with ``${`` or with a possible regex literal are
read lexeme by lexeme: a fold over the lexemes of a text keeps a stack of open things, one character each, and puts the code together
in runs of RUN lexemes, so that no growing value is copied a lexeme at a time. All other texts take one pattern there, too. All patterns
are linear and none recurses: repeated groups are possessive.

Choices: ``'`` right after a letter or digit opens no JS string (it is prose in markup); ``/`` begins a regex literal after an
operator, an opening bracket, a comma, a colon, a semicolon, ``=>`` or one of REGEX_WORDS, and divides otherwise; strings
in quotes end with their line unless it ends with a backslash. Quotes of the same kind nested in a Python f-string end it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSIDE = "\x00"
RUN = 256
REGEX_WORDS = ["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof"]

_TRIPLE = r"{q}{{3}}[^{q}\\]*+(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*+)*+(?:{q}{{3}}|\\?\z)"
_QUOTED = r"{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+(?:{q}|(?=\n)|\\?\z)"
_PY_LEXEME = "|".join([_TRIPLE.format(q='"'), _TRIPLE.format(q="'"), _QUOTED.format(q='"'), _QUOTED.format(q="'"), r"#[^\n]*+", r"[^\"'#]++"])

_REGEX_AFTER = r"[=(,:\[!&|?{;+\-*%~^]|=>"
_REGEX_START = r"(?:" + _REGEX_AFTER + r"|\A|\b(?:" + "|".join(REGEX_WORDS) + r"))\s*+/(?![/*])"
_JS_SIMPLE = "|".join([r"//[^\n]*+", r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)", r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\\?\z)", _QUOTED.format(q='"'),
                       r"(?<![\p{L}\p{N}])" + _QUOTED.format(q="'"), r"(?:[^\"'`/]++|(?<=[\p{L}\p{N}])')++", "/"])
_JS_LEXEME = r"\$\{|//|/\*|\*/|[`'\"{}/\[\]\\\n]|\w++|[^\S\n]++|[^\w\s\\`'\"{}/\[\]$*]++|[\s\S]"
_REGEX_BEFORE = r"(?:\A|" + _REGEX_AFTER + r"|\b(?:" + "|".join(REGEX_WORDS) + r"))\s*\z"


def _blank_lexemes(text: Column, pattern: str, comments: list[str]) -> Column:
    def blank(lexeme: Column) -> Column:
        first = F.substring(lexeme, 1, 1)
        lines = F.when(lexeme.contains("\n"), F.replace(F.regexp_replace(lexeme, r"[^\n]++", F.lit("")), F.lit("\n"), F.lit("\n" + INSIDE))).otherwise("")
        is_comment = F.substring(lexeme, 1, len(comments[0])).isin(*comments)
        return F.when(is_comment, lines).when(first.isin('"', "'", "`"), F.concat(first, lines, first)).otherwise(lexeme)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), blank), "")


def python_code(text: Column) -> Column:
    return F.when(text.rlike("[\"'#]"), _blank_lexemes(text, _PY_LEXEME, ["#"])).otherwise(text)


def _action(stack: Column, last: Column, x: Column) -> Column:
    """What lexeme ``x`` does: pop, push, emit, and what it leaves as the last lexeme."""
    top = F.substring(stack, -1, 1)
    escaped = last == "\\"

    def do(emit: Column | str, last: Column | str, pop: bool = False, push: str = "") -> Column:
        as_column = [c if isinstance(c, Column) else F.lit(c) for c in (emit, last)]
        return F.struct(F.lit(pop).alias("pop"), F.lit(push).alias("push"), as_column[0].alias("emit"), as_column[1].alias("last"))

    newline, skip = x == "\n", do("", x)
    in_code = (
        F.when(newline, do("\n", F.concat(F.rtrim(last), F.lit(" "))))
        .when(x == "`", do("`", "", push="T")).when(x == '"', do('"', "", push="D"))
        .when((x == "'") & ~last.rlike(r"[\p{L}\p{N}]\z"), do("'", "", push="S"))
        .when(x == "//", do("", last, push="L")).when(x == "/*", do("", last, push="B"))
        .when((x == "/") & last.rlike(_REGEX_BEFORE), do('"', "", push="R"))
        .when(x.isin("{", "${"), do(x, "{", push="{"))
        .when(x == "}", F.when(top == "", do("}", "}")).otherwise(do("}", F.when(top == "$", "").otherwise("}"), pop=True)))
        .when(x.rlike(r"\A\s"), do(x, F.concat(F.rtrim(last), F.lit(" ")))).otherwise(do(x, x)))

    def quoted(mark: str) -> Column:
        return (F.when(newline, F.when(escaped, do("\n" + INSIDE, "")).otherwise(do(mark + "\n", mark, pop=True)))
                .when(escaped, do("", "")).when(x == mark, do(mark, mark, pop=True)).otherwise(skip))

    in_template = (F.when(newline, do("\n" + INSIDE, "")).when(escaped, do("", ""))
                   .when(x == "`", do("`", "`", pop=True)).when(x == "${", do("{", "{", push="$")).otherwise(skip))
    ends = do('"', '"', pop=True)
    in_regex = (
        F.when(newline, do('"\n', '"', pop=True))
        .when(escaped, F.when(x.isin("//", "*/"), ends).otherwise(do("", "")))
        .when(x.isin("/", "*/"), ends).when(x == "//", do('"/', "/", pop=True)).when(x == "/*", do('"*', "*", pop=True))
        .when(x == "[", do("", "", push="C")).otherwise(skip))
    in_class = (F.when(newline, do("\n", "", pop=True)).when(escaped, do("", "")).when(x == "]", do("", "", pop=True)).otherwise(skip))
    in_line = F.when(newline, do("\n", F.concat(F.rtrim(last), F.lit(" ")), pop=True)).otherwise(do("", last))
    in_block = F.when(newline, do("\n" + INSIDE, last)).when(x == "*/", do("", F.concat(F.rtrim(last), F.lit(" ")), pop=True)).otherwise(do("", last))
    return (F.when(top.isin("", "{", "$"), in_code).when(top == "T", in_template).when(top == "D", quoted('"')).when(top == "S", quoted("'"))
            .when(top == "R", in_regex).when(top == "C", in_class).when(top == "L", in_line).otherwise(in_block))


def _folded(text: Column) -> Column:
    lexemes = F.regexp_extract_all(text, F.lit(_JS_LEXEME), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        def apply(s: Column, a: Column) -> Column:  # an aggregate over one element binds the action to a name
            stack = F.when(a["pop"], F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)).otherwise(s["stack"])
            return F.struct(F.concat(stack, a["push"]).alias("stack"), a["last"].alias("last"), F.concat(s["out"], a["emit"]).alias("out"))

        return F.aggregate(F.array(_action(state["stack"], state["last"], x)), state, apply)

    def run(state: Column, lexemes_of_run: Column) -> Column:
        start = F.struct(state["stack"].alias("stack"), state["last"].alias("last"), F.lit("").alias("out"))
        done = F.aggregate(lexemes_of_run, start, step)
        return F.aggregate(F.array(done), state, lambda s, d: F.struct(d["stack"].alias("stack"), d["last"].alias("last"), F.array_append(s["outs"], d["out"]).alias("outs")))

    def runs(all_of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / RUN).cast("int")),
                           lambda i: F.slice(all_of, i * RUN + 1, F.lit(RUN)))

    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("last"), F.array().cast("array<string>").alias("outs"))
    bound = F.transform(F.array(lexemes), lambda all_of: F.aggregate(runs(all_of), start, run, lambda s: F.array_join(s["outs"], "")))
    return F.when(F.length(text) == 0, "").otherwise(bound[0])


def brace_code(text: Column) -> Column:
    simple = F.when(text.rlike("[\"'`/]"), _blank_lexemes(text, _JS_SIMPLE, ["//", "/*"])).otherwise(text)
    return F.when(text.contains("${") | (text.contains("/") & text.rlike(_REGEX_START)), _folded(text)).otherwise(simple)
