"""Offline reviews of local files: no patch, so only lines inside scopes are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.operators.detect import with_hits
from hunkwise.operators.review import agent_results, unique_ranked, verdicts
from hunkwise.operators.scopes import line_tasks, scopes, source_lines
from hunkwise.plans.findings import rule_findings, with_texts
from hunkwise.plans.report import Brand, report_blocks
from hunkwise.rules import LINE_RULES, Rule
from hunkwise.schemas import REVIEW_KEYS
from hunkwise.session import stage
from hunkwise.sources.tables import LOCAL_REPO, LOCAL_SHA, local_reviews

LOCAL_KEYS = [*REVIEW_KEYS, "review_file"]


def _with_review(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(LOCAL_REPO).alias("repo_full_name"), F.lit(1).cast("bigint").alias("pr_number"), F.lit(LOCAL_SHA).alias("head_sha"), "*")


def review_local(files: DataFrame, lines: Column | None = None, rules: list[Rule] = LINE_RULES,
                 brand: Brand = Brand()) -> dict[str, DataFrame]:
    """``symbols``, ``findings``, ``verdicts``, ``agent_results`` and ``reports`` of the given files."""
    contexts, rows = local_reviews(files, lines)
    # the file tells a local review: the other keys are the same everywhere and are added at the end
    keys, file_keys = ["review_file"], ["review_file", "filename"]
    symbols = scopes(rows.select(*file_keys, "language", "content"), file_keys)
    tasks = line_tasks(rows)
    # matched where the text is read; what is joined to the wanted lines is rule numbers
    changed = with_hits(source_lines(rows, [*file_keys, "file_ord"]), rules).drop("text")
    if lines is not None:
        wanted = rows.select(*file_keys, F.explode("changed_lines").alias("line"))
        changed = changed.join(wanted, [*file_keys, "line"], "left_semi")
    found = stage(rule_findings(changed, symbols, rows, keys, rules, unscoped=False, tasks=tasks), "local-findings")
    unique = stage(unique_ranked(found, keys), "local-unique")
    found, unique, symbols = map(_with_review, (found, unique, symbols))
    ranked = with_texts(unique.where("finding_ord IS NOT NULL"), rules)
    verdict = verdicts(contexts, unique, LOCAL_KEYS)
    agents = agent_results(contexts, found, LOCAL_KEYS)
    reports = report_blocks(contexts.withColumn("elapsed_ms", F.lit("0.0")), verdict, agents, ranked, LOCAL_KEYS, brand)
    return {"symbols": symbols, "findings": ranked, "verdicts": verdict, "agent_results": agents, "reports": reports}
