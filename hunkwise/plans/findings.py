"""Rule findings of all files, in one pass over the added lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.operators.cover import BIN, cover, dealt, interval_join
from hunkwise.operators.detect import (
    lacks_docstring,
    loop_step,
    snippet_lines,
    with_hits,
    with_loop_depth,
)
from hunkwise.operators.scopes import source_lines
from hunkwise.rules import DOCSTRING_RULE, LINE_RULES, Rule, rules_frame
from hunkwise.schemas import AGENTS, Agent, agent_order
from hunkwise.session import stage

SEQ_FIELDS = ["agent_ord", "origin_ord", "file_ord", "phase", "start_line", "visit", "line_ord", "rule_ord"]


def seq(agent: Column, origin: int, file_ord: Column, phase=0, start=0, visit=0, line=0, rule=0) -> Column:
    """Arrival order as a column: the order in which findings would be listed one by one."""
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    values = [agent, F.lit(origin), file_ord, col(phase), col(start), col(visit), col(line), col(rule)]
    return F.struct(*[v.cast("int").alias(n) for v, n in zip(values, SEQ_FIELDS)])


def scope_columns(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The narrow part of the symbols that detection needs. Whether a scope has a docstring comes from the
    flag ``documented``, or from the ``docstring`` text of symbols made elsewhere."""
    if "documented" in symbols.columns:
        bare = ~F.col("name").startswith("_") & ~F.col("documented")
    else:
        bare = lacks_docstring(F.col("name"), F.col("docstring"))
    return symbols.select(*keys, "visit", "name", "start_line", "end_line", "is_class", "is_async", bare.alias("undocumented"))


def hit_rows(covered: DataFrame, rules: list[Rule], docstrings: bool = True) -> DataFrame:
    """One row per line, scope and matched rule; number 0 is the docstring check on a scope's first line.

    Scopes that are not kept report nothing; lines in no scope report security rules only. The rules table
    comes from the driver's list of rules, so its size is known and small.
    """
    nothing = F.array().cast("array<int>")
    reported = F.when(F.col("visit").isNull() | F.col("kept"), F.col("hits")).otherwise(nothing)
    bare = F.col("kept") & F.col("undocumented") & (F.col("line") == F.col("start_line"))
    numbers = F.concat(reported, F.when(bare, F.array(F.lit(0))).otherwise(nothing)) if docstrings else F.concat(reported)
    dim = rules_frame(covered.sparkSession, rules).drop("message", "suggested_fix")
    rows = covered.withColumn("rule_no", F.explode(numbers)).drop("hits", "kept", "modified", "undocumented", "is_class")
    scoped = F.col("visit").isNotNull()
    return rows.join(F.broadcast(dim), "rule_no").where(
        F.when(scoped, ~F.col("needs_async") | F.col("is_async")).otherwise(F.col("category") == "security")
    )


def depth_filter(hits: DataFrame, scope_lines: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Hits of loop rules that are deep enough. Depth is computed only for the scopes that have such hits.

    ``hits`` is read by several branches: give a staged table.

    ``scope_lines`` has keys, ``line``, ``text`` of the files, or also ``visit`` for lines of given scopes. ``tasks``, if given, is the
    number of partitions of lines and scopes.
    """
    looped = hits.where("min_loop_depth > 0 AND visit IS NOT NULL")
    plain = hits.where("min_loop_depth = 0 OR visit IS NULL")
    steps = scope_lines.withColumn("step", loop_step(F.col("text"))).drop("text")
    if "visit" in scope_lines.columns:
        inside = steps.join(looped.select(*keys, "visit").distinct(), [*keys, "visit"], "left_semi")
    else:
        spans = looped.select(*keys, "visit", "start_line", "end_line").distinct()
        inside = interval_join(steps, spans, keys, tasks=tasks).drop("start_line", "end_line", BIN)
    depth = with_loop_depth(dealt(inside, tasks, *keys, "visit"), [*keys, "visit"]).where("loop_depth > 0").select(*keys, "visit", "line", "loop_depth")
    deep = looped.join(depth, [*keys, "visit", "line"]).where("loop_depth >= min_loop_depth").drop("loop_depth")
    return plain.unionByName(deep)


def as_findings(hits: DataFrame, keys: list[str], agents: list[Agent] = AGENTS) -> DataFrame:
    """Finding rows still without the long texts; those come from the rules table at the end."""
    scoped = F.col("visit").isNotNull()
    return hits.select(
        *keys, F.col("filename").alias("file"), F.col("line").alias("line_start"), F.col("line").alias("line_end"),
        F.col("name").alias("symbol_name"), "category", "severity", "title", "confidence_score", "rule_no",
        F.lit("rule").alias("origin"),
        seq(agent_order(F.col("category"), agents), 0, F.col("file_ord"), F.when(scoped, 0).otherwise(1),
            F.coalesce("start_line", F.lit(0)), F.coalesce("visit", F.lit(0)),
            F.when(F.col("rule_no") == 0, 0).otherwise(F.col("line")), F.col("rule_ord")).alias("seq"),
    )


def with_texts(findings: DataFrame, rules: list[Rule] = LINE_RULES) -> DataFrame:
    """Fills message and fix of rule findings from the (broadcast, size-checked) rules table."""
    texts = rules_frame(findings.sparkSession, rules).select(
        "rule_no", F.col("message").alias("rule_message"), F.col("suggested_fix").alias("rule_fix"))
    columns = findings.columns
    for name in ("message", "suggested_fix"):
        if name not in columns:
            findings = findings.withColumn(name, F.lit(None).cast("string"))

    def fill(text: str) -> Column:
        return F.when(F.col("rule_no") == 0, F.replace(F.col(text), F.lit("{symbol}"), F.col("symbol_name"))).otherwise(
            F.col(text))

    return findings.join(F.broadcast(texts), "rule_no", "left").withColumns({
        "message": F.coalesce("message", fill("rule_message")),
        "suggested_fix": F.when(F.col("rule_no").isNull(), F.col("suggested_fix")).otherwise(fill("rule_fix")),
    }).drop("rule_message", "rule_fix")


def rule_findings(changed: DataFrame, symbols: DataFrame, sources: DataFrame, keys: list[str],
                  rules: list[Rule] = LINE_RULES, unscoped: bool = True, agents: list[Agent] = AGENTS,
                  source_keys: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Findings on ``changed`` lines (keys, filename, ``file_ord``, ``line``, and ``text`` or already ``hits``)
    against ``symbols`` (from sources or given by the caller).

    Each added line is matched where its patch is read. Only keys, line number and rule numbers are shuffled;
    no line text is. The few hit rows are staged since two branches read them. ``unscoped=False`` leaves out
    the security scan outside scopes (files that come without a patch). The docstring check belongs to the
    quality agent and runs only where that agent is among ``agents``. ``sources`` (``source_keys``, by default the
    file keys, and ``content``) are read for the files with a hit of a loop rule only.
    Where lines meet scopes, they are dealt over ``tasks``, if given: the lines there are many times those of the hits.
    """
    file_keys = [*keys, "filename"]
    lines = changed if "hits" in changed.columns else with_hits(changed, rules).drop("text")
    docstrings = DOCSTRING_RULE.category in [a.category for a in agents]
    hits = hit_rows(cover(lines, scope_columns(symbols, file_keys), file_keys, tasks), rules, docstrings)
    hits = stage(hits if unscoped else hits.where("visit IS NOT NULL"), "hits")
    source_keys = source_keys or file_keys
    looped = hits.where("min_loop_depth > 0 AND visit IS NOT NULL").select(*file_keys).distinct()
    texts = looped.join(sources.select(*source_keys, "content"), source_keys)
    return as_findings(depth_filter(hits, source_lines(texts, file_keys), file_keys, tasks), keys, agents)


def snippet_findings(symbols: DataFrame, changed: DataFrame, keys: list[str],
                     rules: list[Rule] = LINE_RULES) -> DataFrame:
    """Findings from given scopes with their own text (``code_snippet``) and changed line numbers.

    ``symbols``: keys, filename, file_ord, visit, name, start_line, code_snippet, is_async, docstring; every
    given scope counts as kept. ``changed``: keys, filename, line.
    """
    file_keys = [*keys, "filename"]
    lines = snippet_lines(symbols, file_keys)
    head = symbols.select(
        *file_keys, "file_ord", "visit", "name", "start_line", "is_async",
        lacks_docstring(F.col("name"), F.col("docstring")).alias("undocumented"))
    scanned = with_hits(lines, rules).drop("text").join(changed, [*file_keys, "line"], "left_semi")
    covered = scanned.join(head, [*file_keys, "visit"]).withColumns({
        "kept": F.lit(True), "modified": F.lit(True), "is_class": F.lit(False), "end_line": F.lit(None).cast("int")})
    hits = stage(hit_rows(covered, rules), "hits")
    return as_findings(depth_filter(hits, lines, file_keys), keys)

