"""Functions and classes from source text, by indentation (Python) or braces (JavaScript, TypeScript).

Only line features travel through the windows. All windows hash on the file key; one file is one text cell,
so a group is bounded by that cell. Where an end has to be searched, a line is repeated once per scope level
that it can close (the distinct levels of a file are few), and the search is then a running window over the
level's rows instead of a join of every header with every later line.

Lines are read as code (``functions.lexing``): strings, comments, template texts and regex literals are blanked over the whole text
before braces, brackets and headers are looked for, and a line that begins inside a string is marked. A Python line is a
statement's first if it does not begin inside a string or an open bracket and does not continue a line that ends with a backslash; an
open bracket ends at the next header at the latest, so a broken line spoils no more than its own scope. A brace-language line with
several opening braces, or one behind a closing one, is cut behind each brace, so that each of its definitions has a row of its own (``seg`` numbers them).

Approximations against a grammar: of definitions that share a row without a brace between them the first counts; an arrow function
without a block ends with its line, with the next line after a last ``=>``, or with the line of closing parentheses after a last ``(``;
``functions.lexing`` lists its choices on ``'`` and ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.functions.lexing import INSIDE, brace_code, python_code
from hunkwise.functions.steps import computed_once
from hunkwise.functions.text import BLANKS, lstrip, split_lines, strip, unix_lines
from hunkwise.operators.cover import interval_join
from hunkwise.schemas import lookup
from hunkwise.session import stage

BRACE_LANGUAGES = ["javascript", "typescript"]

_PY_HEADER = r"(?U)\A\s*(?:async\s+)?(def|class)\s+(\w+)"
_PY_STRING_START = r"""\A\s*[rRuUbB]{0,2}(\"{3}|'{3}|\"|')"""

_NAME = r"([\w$#]++)"
_JS_LEAD = r"(?U)\A\s*+(?:export\s++(?:default\s++)?+)?+"
_JS_FUNCTION = _JS_LEAD + r"(?:async\s++)?+function\s++" + _NAME + r"\s*+[(<]"
_JS_CLASS = _JS_LEAD + r"(?:abstract\s++)?+class\s++" + _NAME
_JS_VALUE = _JS_LEAD + r"(?:const|let|var)\s++" + _NAME + r"\s*+(?::[^=]++)?+=\s*+(?:async\s++)?"
_JS_CONST = _JS_VALUE + r"(function\b|\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)\s*+(?::[^=]++)?+=>|[\w$]++\s*+=>)"
_JS_CONST_OPEN = _JS_VALUE + r"\([^()]*+\z"
# the rest of a method's line needs no pattern: it has no semicolon, or ends with a closing brace
_JS_METHOD = (
    r"(?U)\A\s*+(?:(?:public|private|protected|static|override|readonly)\s++(?!\())*+(?:async\s++(?!\())?+\*?+\s*+(?:(?:get|set)\s++(?!\())?+"
    + r"(?!(?:if|for|while|switch|catch|function|return|do|else|with|new|typeof|await|super|throw)\b)"
    + _NAME + r"\s*+\("
)

_PIECE = r"[^{}]*+(?:\{|\}[;,]*+)|[^{}]++\z"
_GOES_ON = r"\A\s*+\}\s*+(?:else|catch|finally|while)\b[^{}]*+\{\s*+\z"
_LAST = 1 << 30  # the segment of an end that is a whole line

#: Source lines whose rows one task keeps for the windows, about 1 kB a line.
TASK_LINES = 1 << 17

def source_lines(sources: DataFrame, keys: list[str]) -> DataFrame:
    """One row per source line: ``line`` from 1 and ``text``."""
    return sources.select(*keys, F.posexplode(split_lines(F.col("content"))).alias("off", "text")).select(
        *keys, (F.col("off") + 1).alias("line"), "text"
    )


def code_lines(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Source lines with ``language`` and their ``code``; a line of a brace language with several blocks as one row behind each
    brace (``seg`` from 0; ``whole``: the row begins its line)."""
    text = F.when(F.length("content") == 0, F.lit(None)).otherwise(F.regexp_replace(unix_lines(F.col("content")), "\n\\z", ""))
    rows = computed_once(sources.select(*keys, "language", text.alias("raw")).where("raw IS NOT NULL"), "as_code",
                         F.when(F.col("language") == "python", python_code(F.col("raw"))).otherwise(brace_code(F.col("raw"))))
    pairs = F.arrays_zip(F.split("raw", "\n").alias("text"), F.split("as_code", "\n").alias("code"))
    names = list(dict.fromkeys([*keys, "language"]))
    lines = rows.select(*names, F.posexplode(pairs).alias("off", "pair"))
    code = F.col("pair.code")
    reopens = code.contains("}") & code.rlike(r"\}[^{]*+\{") & ~code.rlike(_GOES_ON)
    several = (F.col("language") != "python") & ((_char_count(code, "{") > 1) | reopens)
    pieces = F.when(several, F.regexp_extract_all("pair.code", F.lit(_PIECE), F.lit(0))).otherwise(F.array("pair.code"))
    whole = F.col("seg") == 0
    return lines.select(*names, (F.col("off") + 1).alias("line"), "pair.text", F.posexplode(pieces).alias("seg", "code")).withColumns({
        "text": F.when(whole, F.col("text")).otherwise(F.col("code")), "whole": whole})


def _char_count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def _line_features(lines: DataFrame, keys: list[str]) -> DataFrame:
    """What the windows need to know of a row. Regexes run only behind a cheap test for their literal text."""
    lines = computed_once(computed_once(lines, "body", lstrip(F.col("text"))), "stripped", strip(F.col("code")))
    text, body, code, stripped = F.col("text"), F.col("body"), F.col("code"), F.col("stripped")
    python = F.col("language") == "python"
    inside = code.startswith(INSIDE)
    comment = body.startswith("//") | body.startswith("/*") | body.startswith("*")

    def extract(guard: Column, pattern: str, group: int) -> Column:
        return F.when(guard, F.nullif(F.regexp_extract(code, pattern, group), F.lit("")))

    py = python & (stripped.startswith("def") | stripped.startswith("class") | stripped.startswith("async"))
    js_class = ~python & code.contains("class")
    js_function = ~python & code.contains("function")
    js_const = ~python & code.contains("=") & (code.contains("=>") | code.contains("function"))
    js_method = ~python & code.contains("(") & (~code.contains(";") | code.rlike(r"\}\s*+\z"))
    js_open = ~python & code.contains("(") & code.contains("=")

    def brackets(marks: str) -> Column:
        return F.when(python, F.length(code) - F.length(F.translate(code, marks, ""))).otherwise(0)

    return lines.select(
        *keys, "line", "seg", python.alias("python"), inside.alias("inside"),
        (F.length(text) - F.length(body)).alias("indent"),
        (body != "").alias("filled"),
        F.when(python, body.startswith("#") & ~inside).otherwise(comment & F.col("whole")).alias("is_comment"),
        (python & (stripped != "") & ~inside).alias("has_code"),
        (python & code.endswith("\\")).alias("goes_on"),
        (brackets("([{") - brackets(")]}")).alias("bracket_step"),
        (python & stripped.endswith(":")).alias("ends_colon"),
        (python & (body.contains("\"") | body.contains("\'")) & body.rlike(_PY_STRING_START)).alias("starts_string"),
        F.when(python, F.length(F.translate(body, BLANKS + "\"\'", ""))).otherwise(0).alias("plain_chars"),
        (text.contains("async ") & (F.col("whole") | ~python)).cast("int").alias("async_word"),
        *(F.when(python, 0).otherwise(_char_count(code, brace)).alias(name) for brace, name in (("{", "opens"), ("}", "closes"))),
        extract(py, _PY_HEADER, 1).alias("py_kind"),
        extract(py, _PY_HEADER, 2).alias("py_name"),
        extract(js_class, _JS_CLASS, 1).alias("class_name"),
        extract(js_function, _JS_FUNCTION, 1).alias("function_name"),
        extract(js_const, _JS_CONST, 1).alias("const_name"),
        extract(js_const, _JS_CONST, 2).alias("const_value"),
        extract(js_method, _JS_METHOD, 1).alias("method_name"),
        extract(js_open, _JS_CONST_OPEN, 1).alias("open_name"),
        (~python & stripped.endswith("(")).alias("ends_open"),
        (~python & stripped.endswith("=>")).alias("ends_arrow"),
        (~python & stripped.startswith(")")).alias("starts_close"),
        (~python & stripped.startswith(")") & code.contains("=>")).alias("closes_arrow"),
        (~python & stripped.startswith(")") & stripped.rlike(r"\A\)+;?\s*\z")).alias("only_closes"),
        (~python & F.col("whole") & body.startswith("/**")).alias("doc_opens"),
        (~python & F.col("whole") & text.contains("/*")).alias("block_opens"),
        (~python & F.col("whole") & text.contains("*/") & text.rlike(r"(?U)\*/\s*\z")).alias("doc_ends"),
        (~python & body.startswith("export ")).alias("is_export"),
    )


def line_tasks(sources: DataFrame) -> int:
    """Tasks over which the lines of all sources are dealt. The windows sort a task's rows several times over, so its memory goes with
    its lines; their number per task is held, however many partitions a session has and however well rows compress."""
    lines = sources.agg(F.sum(_char_count(F.col("content"), "\n") + 1)).first()[0] or 0
    return max(1, -(-lines // TASK_LINES))


def scope_headers(lines: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Every definition row with its extent, from the rows of :func:`code_lines`.

    Both languages share one pass: one exchange on the file key (to ``tasks`` partitions, if given), then running windows in line
    order, in reversed order, and per scope level.
    """
    # the number leads the keys: it is never a literal, which would keep the windows from using the partitioning by it
    file = ["file_no", *keys]
    down = W.partitionBy(*file).orderBy("line", "seg")
    so_far, above = down.rowsBetween(W.unboundedPreceding, W.currentRow), down.rowsBetween(W.unboundedPreceding, -1)
    # a backward fill is a running window over the reversed order: a frame open to the end would rescan it
    up = W.partitionBy(*file).orderBy(F.desc("line"), F.desc("seg"))
    below, here_or_below = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*file)
    zero = F.lit(0)

    features = _line_features(lines.withColumn("file_no", F.xxhash64(*keys)), file)
    rows = (features if tasks is None else features.repartition(tasks, "file_no")).withColumns({
        "depth_after": F.sum(F.col("opens") - F.col("closes")).over(so_far),
        "brackets_above": F.coalesce(F.sum("bracket_step").over(above), zero),
        "brackets_after": F.sum("bracket_step").over(so_far),
        "continued": F.coalesce(F.lag("goes_on").over(down), F.lit(False)),
        "chars_above": F.coalesce(F.sum("plain_chars").over(above), zero),
        "async_above": F.coalesce(F.sum("async_word").over(above), zero),
        "last_filled": F.max(F.when(F.col("filled"), F.col("line"))).over(above),
        "prev": F.last(F.when(F.col("filled"), F.struct("line", "doc_ends")), ignorenulls=True).over(above),
        "doc_line": F.last(F.when(F.col("doc_opens"), F.col("line")), ignorenulls=True).over(above),
        "block_line": F.last(F.when(F.col("block_opens"), F.col("line")), ignorenulls=True).over(above),
    })
    # no expression holds def or class, so a header line stands outside all brackets
    base = F.coalesce(F.last(F.when(F.col("py_kind").isNotNull() & ~F.col("inside"), F.col("brackets_above")), ignorenulls=True).over(so_far), zero)
    # JS: how a parameter list or an expression left open on a header line goes on
    rows = rows.withColumns({
        "base": base,
        "next_filled": F.last(F.when(F.col("filled"), F.col("line")), ignorenulls=True).over(below),
        "next_close": F.last(F.when(F.col("starts_close"), F.struct("line", "closes_arrow", "opens")), ignorenulls=True).over(below),
        "next_end": F.last(F.when(F.col("only_closes"), F.col("line")), ignorenulls=True).over(below),
    })
    code = F.col("has_code") & (F.col("brackets_above") <= F.col("base")) & ~F.col("continued")
    depth = F.col("depth_after") - F.col("opens") + F.col("closes")
    js_kind = (
        F.when(F.col("is_comment") | F.col("inside"), None)
        .when(F.col("class_name").isNotNull(), "class_declaration")
        .when(F.col("function_name").isNotNull(), "function_declaration")
        .when(F.col("const_name").isNotNull(),
              F.when(F.col("const_value").startswith("function"), "function_expression").otherwise("arrow_function"))
        .when(F.col("open_name").isNotNull() & F.col("next_close.closes_arrow"), "arrow_function")
        .when(F.col("method_name").isNotNull() & (depth > 0), "method_definition")
    )
    py_kind = F.when(code, lookup(F.col("py_kind"), {"def": "function_definition", "class": "class_definition"}))
    rows = rows.withColumns({
        "is_code": code,
        "kind": F.when(F.col("python"), py_kind).otherwise(js_kind),
        "name": F.coalesce("py_name", "class_name", "function_name", "const_name", "open_name", "method_name"),
        "level_here": F.when(F.col("python"), F.col("indent")).otherwise(depth).cast("int"),
    })

    # a string that begins on a line ends on the last line before one that begins outside
    rows = rows.withColumns({
        "next_indent": F.last(F.when(F.col("is_code"), F.col("indent")), ignorenulls=True).over(below),
        "next_outside": F.last(F.when(~F.col("inside"), F.struct("line", "chars_above")), ignorenulls=True).over(below),
        "file_end": F.max(F.when(F.col("filled"), F.col("line"))).over(whole),
        "async_total": F.sum("async_word").over(whole),
        "levels": F.collect_set(F.when(F.col("kind").isNotNull(), F.col("level_here"))).over(whole),
    })
    statement = F.struct(
        "line", "indent", "starts_string", (F.col("next_outside.line") - 1).alias("doc_to"),
        (F.col("next_outside.chars_above") - F.col("chars_above")).alias("doc_chars"))
    rows = rows.withColumn("statement", F.last(F.when(F.col("is_code"), statement), ignorenulls=True).over(below))
    # the body starts below the nearest line that ends with a colon outside brackets: the header itself, or the end of its signature
    ends_signature = F.col("ends_colon") & (F.col("brackets_after") <= F.col("base"))
    rows = rows.withColumn("first", F.last(F.when(ends_signature, F.col("statement")), ignorenulls=True).over(here_or_below))

    # Python: a code line closes every level from its indent up; a comment only together with the code below
    # it. Braces: a row with a closing brace closes every level from the depth it leaves.
    closing = (
        F.when(F.col("is_code"), F.col("indent"))
        .when(F.col("python") & F.col("filled") & F.col("is_comment") & (F.col("brackets_above") <= F.col("base")),
              F.greatest(F.col("indent"), F.coalesce(F.col("next_indent"), F.lit(-1))))
        .when(~F.col("python") & (F.col("closes") > 0), F.col("depth_after"))
    )
    is_closer, is_header = F.col("closing") <= F.col("level"), F.col("kind").isNotNull() & (F.col("level_here") == F.col("level"))
    levels = rows.withColumn("closing", closing.cast("int")).where("closing IS NOT NULL OR kind IS NOT NULL").withColumn(
        "level", F.explode("levels")).where(is_closer | is_header)
    after = W.partitionBy(*file, "level").orderBy(F.desc("line"), F.desc("seg")).rowsBetween(W.unboundedPreceding, -1)
    closer = F.struct("line", "seg", "last_filled", "async_above", "async_word")
    headers = levels.withColumn(
        "next_closer", F.last(F.when(is_closer, closer), ignorenulls=True).over(after)).where(is_header)

    python = F.col("python")
    block_end = F.when(is_closer, closer).otherwise(F.col("next_closer"))
    # an arrow function without a block ends with its line, or where the expression left open ends
    arrow = F.col("kind") == "arrow_function"
    open_list = arrow & F.col("const_name").isNull()
    no_block = F.when(open_list, F.col("next_close.opens") == 0).otherwise(arrow & (F.col("opens") == 0))
    expression_end = (
        F.when(open_list, F.col("next_close.line"))
        .when(F.col("ends_arrow"), F.coalesce("next_filled", "line"))
        .when(F.col("ends_open"), F.coalesce("next_end", "line"))
        .otherwise(F.col("line"))
    )
    headers = headers.withColumns({
        "end_line": F.when(python, F.coalesce("next_closer.last_filled", "file_end"))
        .when(no_block, expression_end).otherwise(F.coalesce(block_end["line"], F.col("file_end"))),
        "end_seg": F.when(~python & ~F.coalesce(no_block, F.lit(False)), F.coalesce(block_end["seg"], F.lit(_LAST))).otherwise(_LAST),
        "async_end": F.when(python, F.coalesce("next_closer.async_above", "async_total"))
        .when(no_block, F.col("async_above") + F.col("async_word"))
        .otherwise(F.coalesce(block_end["async_above"] + block_end["async_word"], F.col("async_total"))),
    })
    # JS: a doc comment right above; before ``export`` it belongs to the export, not to the declaration
    js_doc = ~python & ~F.col("is_export") & F.col("prev.doc_ends") & (F.col("doc_line") == F.col("block_line"))
    py_doc = python & F.col("first.starts_string") & (F.col("first.line") > F.col("line")) & (F.col("first.line") <= F.col("end_line"))
    return headers.select(
        *keys, F.col("line").alias("start_line"), F.col("seg").alias("start_seg"), "end_line", "end_seg", F.col("level").alias("level"),
        F.when(python, F.col("statement.indent")).alias("body_level"), "python", "name",
        F.col("kind").alias("node_type"), F.col("kind").startswith("class").alias("is_class"),
        (F.col("async_end") > F.col("async_above")).alias("is_async"),
        F.when(js_doc, F.col("doc_line")).when(py_doc, F.col("first.line")).alias("doc_from"),
        F.when(js_doc, F.col("prev.line")).when(py_doc, F.coalesce("first.doc_to", "file_end")).alias("doc_to"),
        (F.coalesce(js_doc, F.lit(False)) | F.coalesce(py_doc & (F.coalesce("first.doc_chars", F.lit(1)) > 0), F.lit(False))
         ).alias("documented"),
    )


def visited(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions at module or class level only, with qualified names and visit order.

    The classes around a header come from an interval join: as many rows as the header is deep. Python: every
    step down the chain of classes must be one body indent; braces: the depth must equal the number of classes.
    Then nothing but classes encloses the header. A class is visited after everything in it, so its place in
    the order is its last line, a function's its first.
    """
    rest = [c for c in headers.columns if c not in keys]
    rows = headers.select(*keys, F.col("start_line").alias("line"), F.struct(*rest).alias("row"))
    classes = headers.where("is_class").select(
        *keys, "start_line", "end_line", F.struct("start_line", "start_seg", "end_line", "end_seg", "name", "level", "body_level").alias("outer"))
    joined = interval_join(rows, classes, keys, "left")
    # rows of one line: in the class from behind its opening brace to its closing one
    here, begins, ends = (F.struct(*(F.col(f"{row}.{c}").alias(n) for c, n in zip(cols, ("line", "seg")))) for row, cols in (
        ("row", ("start_line", "start_seg")), ("outer", ("start_line", "start_seg")), ("outer", ("end_line", "end_seg"))))
    within = F.when((here > begins) & (here <= ends), F.col("outer"))
    around = joined.groupBy(*keys, F.col("line"), F.col("row.start_seg").alias("start_seg")).agg(
        F.first("row").alias("row"), F.array_sort(F.collect_list(within)).alias("outers"))
    steps = F.concat(F.transform("outers", lambda o: o["level"]), F.array("row.level"))
    wanted = F.concat(F.array(F.lit(0)), F.transform("outers", lambda o: o["body_level"]))
    in_chain = F.forall(F.zip_with(steps, wanted, lambda s, w: F.coalesce(s == w, F.lit(False))), lambda ok: ok)
    in_classes = (F.size("outers") == F.col("row.level")) & (
        (F.col("row.node_type") != "method_definition") | (F.size("outers") > 0))
    parents = F.transform("outers", lambda o: o["name"])
    kept = around.where(F.when(F.col("row.python"), in_chain).otherwise(in_classes)).select(
        *keys, "row.*", parents.alias("parents"))
    at_end = F.col("is_class")
    order = W.partitionBy(*keys).orderBy(
        F.when(at_end, F.col("end_line")).otherwise(F.col("start_line")), at_end & (F.col("end_seg") == _LAST),
        F.when(at_end, F.col("end_seg")).otherwise(F.col("start_seg")), at_end, F.desc("start_line"), F.desc("start_seg"))
    return kept.select(
        *keys, F.row_number().over(order).alias("visit"), F.concat_ws(".", "parents", "name").alias("name"), "node_type",
        F.nullif(F.array_join("parents", "."), F.lit("")).alias("parent_symbol"), "start_line", "end_line",
        "is_class", "is_async", "documented", "doc_from", "doc_to")


def scopes(sources: DataFrame, keys: list[str], sized_by: DataFrame | None = None) -> DataFrame:
    """Symbols of every source (``language``, ``content``); other languages have none.

    The lines are counted first, of ``sized_by`` where that is a cheaper table with all the texts (``content``).

    The header rows (a few per cent of the lines) are staged: the class chain reads them twice, and the source
    texts are read once.
    """
    known = sources.where(F.col("language").isin("python", *BRACE_LANGUAGES))
    tasks = line_tasks(known if sized_by is None else sized_by)
    return visited(stage(scope_headers(code_lines(known, keys), keys, tasks), "scope-headers"), keys)


def with_source_text(symbols: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``code_snippet`` (from where the definition starts) and ``docstring`` (without its quotes)."""
    def taken(first: str, last: str) -> Column:
        return F.array_join(F.slice("source_rows", F.col(first), F.col(last) - F.col(first) + 1), "\n")

    doc = strip(taken("doc_from", "doc_to"))
    bare = strip(F.trim(doc, F.lit("\"'")))
    joined = symbols.join(sources.select(*keys, "content"), keys).withColumn("source_rows", split_lines(F.col("content")))
    return joined.withColumns({
        "code_snippet": lstrip(taken("start_line", "end_line")),
        "docstring": F.when(F.col("doc_from").isNotNull(), F.when(doc.startswith("/**"), doc).otherwise(bare)),
    }).drop("content", "source_rows", "doc_from", "doc_to")
