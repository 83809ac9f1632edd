"""Texts of a review: Markdown report, inline comments, submission payload.

A report is a table of blocks: per review the head (block 0), one block per ranked finding, and the footer. The blocks in order,
joined by line breaks, are the Markdown text, which ``review_rows`` puts together beside the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import strip
from hunkwise.operators.assemble import PART_CHARS, assemble
from hunkwise.operators.cover import interval_join
from hunkwise.schemas import AGENTS, SEVERITIES, VERDICT_BADGES, lookup

ALL_CLEAR = (  # fixed value
    "> [!TIP]\n> **All checks passed!** No security vulnerabilities, performance bottlenecks, or logic risks were "
    "detected in the modified code.\n"
)
FALLBACK_NOTE = "Inline comments fell back to summary body due to diff position mismatch."  # fixed value


@dataclass(frozen=True)
class Brand:
    """The names a deployment prints in its texts."""

    heading: str = "Change Review"
    footer: str = "Generated by the change review pipeline."
    signer: str = "Change Review"


def _severity_badge(index: int) -> Column:
    return lookup(F.col("severity"), {s[0]: s[index] for s in SEVERITIES})


def _category_label(place: str) -> Column:
    return lookup(F.col("category"), {a.category: getattr(a, place) for a in AGENTS}, F.col("category"))


def _symbol_info() -> Column:
    symbol = F.coalesce(F.col("symbol_name"), F.lit(""))
    return F.when(symbol == "", "").otherwise(F.concat(F.lit(" in `"), symbol, F.lit("`")))


def finding_block() -> Column:
    """The report's lines on one ranked finding."""
    fix = F.coalesce(F.col("suggested_fix"), F.lit(""))
    return F.concat(
        F.lit("#### "), F.col("finding_ord").cast("string"), F.lit(". "),
        F.coalesce(_severity_badge(2), F.col("severity")), F.lit(" **"), F.col("title"), F.lit("** ("),
        _category_label("report_label"), F.lit(")\n- **Location:** `"),
        F.col("file"), F.lit(":"), F.col("line_start").cast("string"), F.lit("`"), _symbol_info(),
        F.lit("\n- **Details:** "), F.col("message"),
        F.when(fix == "", "\n").otherwise(
            F.concat(F.lit("\n- **Recommendation:**\n  ```suggestion\n  "), fix, F.lit("\n  ```\n"))),
    )


def report_blocks(contexts: DataFrame, verdicts: DataFrame, agents: DataFrame, ranked: DataFrame, keys: list[str],
                  brand: Brand = Brand()) -> DataFrame:
    """``block_ord`` (from 0, without gaps) and ``body`` per review.

    ``contexts`` has ``pr_title``, ``author_login`` and ``elapsed_ms``, the time to print, as text.
    """
    agent_line = F.concat(
        F.lit("| **"), F.col("agent_name"), F.lit("** | "), _category_label("report_label"), F.lit(" | "),
        F.col("n_findings").cast("string"), F.lit(" | "), F.when(F.col("passed"), "Pass").otherwise("Issues Found"), F.lit(" |"))
    agent_rows = agents.select(*keys, "agent_ord", agent_line.alias("agent_line")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("agent_ord", "agent_line"))).alias("agent_lines"))
    # fixed values: the texts around the columns
    head = F.concat(
        F.lit(f"## {brand.heading} — "), lookup(F.col("verdict"), VERDICT_BADGES, F.lit("**REVIEW COMPLETE**")),
        F.lit("\n\n**PR #"), F.col("pr_number").cast("string"), F.lit(":** "), F.col("pr_title"),
        F.lit("  \n**Author:** @"), F.col("author_login"), F.lit(" | **Commit:** `"), F.substring("head_sha", 1, 8),
        F.lit("` | **Analysis Time:** `"), F.col("elapsed_ms"),
        F.lit(" ms`\n\n### Review Overview\n| Agent | Category | Findings | Status |\n|---|---|:---:|:---:|\n"),
        F.array_join(F.transform("agent_lines", lambda a: a["agent_line"]), "\n"), F.lit("\n\n"),
        F.when(F.col("total_findings") == 0, ALL_CLEAR).otherwise("### Detailed Findings\n"))
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("block_ord"), head.alias("body")),
        F.struct((F.col("total_findings") + 1).cast("long").alias("block_ord"), F.lit(f"---\n*{brand.footer}*").alias("body")))
    rows = contexts.join(verdicts, keys).join(agent_rows, keys).withColumn("block", F.explode(ends))
    return rows.select(*keys, "block.block_ord", "block.body").union(
        ranked.select(*keys, F.col("finding_ord").cast("long").alias("block_ord"), finding_block().alias("body")))


def review_rows(verdicts: DataFrame, blocks: DataFrame, keys: list[str], part_chars: int = PART_CHARS) -> DataFrame:
    """What is submitted of each review: verdict, total_findings and the report as ``body``; a report beyond ``part_chars`` comes as
    several rows (``part`` of ``n_parts``), any other as one."""
    return verdicts.join(assemble(blocks, keys, "block_ord", "body", part_chars=part_chars), keys)


def comment_body(brand: Brand = Brand()) -> Column:
    """Badge, title, label and scope; the message; a fix block where a fix is given; the confidence."""
    fix = strip(F.coalesce(F.col("suggested_fix"), F.lit("")))
    percent = (F.col("confidence_score") * 100).cast("int").cast("string")
    return F.concat(
        F.coalesce(_severity_badge(3), F.lit("**[NOTE]**")), F.lit(" **"), F.col("title"), F.lit("** ("),
        _category_label("comment_label"), F.lit(")"), _symbol_info(), F.lit("\n\n"), F.col("message"),
        F.when(fix == "", "").otherwise(F.concat(F.lit("\n\n```suggestion\n"), fix, F.lit("\n```"))),
        F.lit("\n\n> *Confidence: `"), percent, F.lit(f"%` | {brand.signer}*"),
    )


def inline_comments(ranked: DataFrame, keys: list[str], brand: Brand = Brand()) -> DataFrame:
    return ranked.select(
        *keys, F.col("finding_ord").alias("comment_ord"), F.col("file").alias("path"), F.col("line_start").alias("line"),
        F.lit("RIGHT").alias("side"), comment_body(brand).alias("body"))


def submissions(verdicts: DataFrame, findings: DataFrame, new_side: DataFrame, keys: list[str]) -> DataFrame:
    """What is submitted per review. One finding off the new side of the diff turns all inline comments of its
    review into the summary alone, and a REQUEST_CHANGES event into COMMENT; the verdict stays as it was.

    ``new_side`` has keys, ``filename`` and the ranges ``start_line`` to ``end_line`` of the added and context lines, one per
    hunk; a table with ``line`` instead has ranges of one line. Findings meet ranges by file and bin of lines.
    """
    if "line" in new_side.columns:
        new_side = new_side.withColumns({"start_line": F.col("line"), "end_line": F.col("line")})
    ranges = new_side.select(*keys, F.col("filename").alias("file"), "start_line", "end_line")
    places = findings.select(*keys, "file", F.col("line_start").alias("line"))
    misplaced = interval_join(places, ranges, [*keys, "file"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_misplaced"))
    fell_back = F.coalesce("n_misplaced", F.lit(0)) > 0
    return verdicts.join(misplaced, keys, "left").select(
        *keys,
        F.when(fell_back, "fallback_success").otherwise("success").alias("status"),
        F.when(fell_back & (F.col("verdict") == "REQUEST_CHANGES"), "COMMENT").otherwise(F.col("verdict")).alias("event"),
        "verdict",
        F.when(fell_back, 0).otherwise(F.col("total_findings")).alias("inline_comments_posted"),
        F.when(fell_back, FALLBACK_NOTE).alias("note"),
    )


def dry_run_rows(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        F.lit("dry_run").alias("status"), F.col("repo_full_name").alias("repo"), "pr_number", "verdict",
        F.col("total_findings").alias("inline_comments_count"))
