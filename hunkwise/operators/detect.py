"""The rule scan: every rule on every changed line, in one pass, before anything is shuffled.

A line is scanned once, where it is read. What travels on is the array of matched rule numbers, not the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.functions.factors import factors, indexed_hits
from hunkwise.functions.text import indent_width, split_lines, strip
from hunkwise.rules import Rule, numbered, rules_frame


def matches(text: Column, rule: Rule) -> Column:
    """The rule's literal needles, then its regex."""
    test = None
    for needle in rule.needles:
        options = needle if isinstance(needle, tuple) else (needle,)
        any_of = text.contains(options[0])
        for other in options[1:]:
            any_of = any_of | text.contains(other)
        test = any_of if test is None else test & any_of
    regex = text.rlike(rule.regex)
    return regex if test is None else test & regex


RULES_AT_ONCE = 200
#: Lists with more rules without needles than this are tried through the index of their literal factors.
INDEXED_FROM = 50


def hit_array(text: Column, rules: list[Rule]) -> Column:
    """Numbers of the rules that match the text. Patterns are literals, so each is compiled once, and the
    whole expression stays in generated code; long lists are chunks of arrays.

    In a long list the rules without needles whose patterns have literal factors are tried only on texts that hold one, so
    that the work depends on the texts rather than on the number of rules. The hits are the same either way."""
    all_numbered = numbered(rules)
    plain = {no: r for no, _, r in all_numbered if not r.needles}
    needed = {no: factors(r.pattern) for no, r in plain.items()} if len(plain) > INDEXED_FROM else {}
    needed = {no: words for no, words in needed.items() if words}
    flags = [F.when(matches(text, r), no).otherwise(0) for no, _, r in all_numbered if no not in needed]
    chunks = [F.array_remove(F.array(*flags[i : i + RULES_AT_ONCE]), 0) for i in range(0, len(flags), RULES_AT_ONCE)]
    if needed:
        chunks.append(indexed_hits(text, {no: plain[no].regex for no in needed}, needed))
    return chunks[0] if len(chunks) == 1 else F.concat(F.array().cast("array<int>"), *chunks)


def with_hits(lines: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    return lines.withColumn("hits", hit_array(F.col(text), rules))


def snippet_lines(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each scope's own text (``code_snippet``), numbered from its first line."""
    return symbols.select(
        *keys, "visit", "start_line", F.posexplode(split_lines(F.col("code_snippet"))).alias("off", "text")
    ).select(*keys, "visit", (F.col("start_line") + F.col("off")).alias("line"), "text")


def is_async(node_type: Column, code: Column) -> Column:
    """The word anywhere in the scope's text counts, comments included."""
    return (node_type == "async_function_definition") | code.contains("async ")


def loop_step(text: Column) -> Column:
    """+1 on a loop header, -1 on any other line indented by at most four characters."""
    body = strip(text)
    maybe = text.contains("for ") | text.contains("while ")  # spares most lines the strip
    return (
        F.when(maybe & (body.startswith("for ") | body.startswith("while ")), 1)
        .when(indent_width(text) <= 4, -1)
        .otherwise(0)
    )


def with_loop_depth(scope_lines: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Loop depth per line of a scope: the steps summed with a floor at zero.

    A sum clamped at zero equals the free sum minus its lowest value so far (if below zero), so two running
    windows over one sort give it. ``keys`` identify the scope; one scope is part of one file's text.
    """
    running = W.partitionBy(*keys).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        scope_lines.withColumn("free_sum", F.sum(step).over(running))
        .withColumn("lowest", F.min("free_sum").over(running))
        .withColumn("loop_depth", (F.col("free_sum") - F.least(F.lit(0), F.col("lowest"))).cast("int"))
        .drop("free_sum", "lowest")
    )


def lacks_docstring(name: Column, docstring: Column) -> Column:
    """Public by its qualified name, and without a docstring text."""
    return ~name.startswith("_") & (F.coalesce(docstring, F.lit("")) == "")


def scan_text(lines: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Any rules on any table with a text column: one row per line and matched rule (custom scans)."""
    table = rules_frame(lines.sparkSession, rules).select("rule_no", "rule_id", "category", "severity", "title")
    return (
        lines.withColumn("rule_no", F.explode(hit_array(F.col(text), rules)))
        .join(F.broadcast(table), "rule_no")
    )

