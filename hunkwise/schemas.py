"""Column names, key lists and fixed dimensions shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_KEYS = ["repo_full_name", "pr_number", "head_sha"]
FILE_KEYS = REVIEW_KEYS + ["filename"]
SOURCE_KEYS = ["repo_full_name", "head_sha", "filename"]

REVIEW_CONTEXT_DDL = """
    installation_id BIGINT, repo_full_name STRING, repo_clone_url STRING, pr_number BIGINT, pr_title STRING,
    head_sha STRING, head_branch STRING, base_branch STRING, author_login STRING,
    additions BIGINT, deletions BIGINT, changed_files BIGINT
"""
PR_EVENTS_DDL = "delivery_id STRING, event_type STRING, signature STRING, body BINARY, received_at TIMESTAMP"
PR_FILES_DDL = """
    repo_full_name STRING, pr_number BIGINT, head_sha STRING, file_ord INT, filename STRING, old_filename STRING,
    status STRING, additions INT, deletions INT, patch STRING
"""
SOURCES_DDL = "repo_full_name STRING, head_sha STRING, filename STRING, content STRING"
SYMBOLS_DDL = """
    repo_full_name STRING, pr_number BIGINT, head_sha STRING, filename STRING, visit INT, name STRING,
    node_type STRING, parent_symbol STRING, start_line INT, end_line INT, docstring STRING,
    is_class BOOLEAN, is_async BOOLEAN
"""
MODEL_RESPONSES_DDL = "repo_full_name STRING, pr_number BIGINT, head_sha STRING, category STRING, raw STRING"

# Severities in rank order with their report and comment badges.
SEVERITIES = [
    ("critical", 0, "`CRITICAL`", "**[CRITICAL]**"),
    ("high", 1, "`HIGH`", "**[HIGH]**"),
    ("medium", 2, "`MEDIUM`", "**[MEDIUM]**"),
    ("low", 3, "`LOW`", "**[LOW]**"),
    ("info", 4, "`INFO`", "**[INFO]**"),
]
BLOCKING = ["critical", "high"]

@dataclass(frozen=True)
class Agent:
    """A reviewer: its category, its labels in the report and in comments, and its summary texts."""

    name: str
    category: str
    report_label: str
    comment_label: str
    pass_text: str
    flag_head: str
    flag_tail: str


# The agents in running order.
AGENTS = [
    Agent("SecurityAgent", "security", "Security", "Security Vulnerability",
          "Security Audit passed with no critical issues.",
          "Security Audit flagged ", " potential vulnerability(ies)."),
    Agent("PerformanceAgent", "performance", "Performance", "Performance Bottleneck",
          "Performance Audit passed with no critical bottlenecks.",
          "Performance Audit flagged ", " potential performance bottleneck(s)."),
    Agent("LogicBugAgent", "bug_risk", "Bug Risk", "Logic / Bug Risk",
          "Logic Audit passed with no critical bug risks.",
          "Logic Audit flagged ", " potential bug risk(s)."),
    Agent("QualityAgent", "code_quality", "Quality", "Code Quality & Maintainability",
          "Quality Audit passed with no critical concerns.",
          "Quality Audit highlighted ", " style or maintainability suggestion(s)."),
]
CATEGORIES = [a.category for a in AGENTS]

# Report badge per verdict.
VERDICT_BADGES = {
    "APPROVE": "**APPROVED**",
    "COMMENT": "**COMMENT / FEEDBACK**",
    "REQUEST_CHANGES": "**CHANGES REQUESTED**",
}


def lookup(key: Column, pairs: dict, default: Column | None = None) -> Column:
    """``CASE key WHEN … END`` for a short fixed table."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s[0]: s[1] for s in SEVERITIES}, F.lit(5))


def agent_order(category: Column, agents: list[Agent] = AGENTS) -> Column:
    return lookup(category, {a.category: n for n, a in enumerate(agents, 1)}, F.lit(len(agents) + 1))


def agent_array(agents: list[Agent] = AGENTS) -> Column:
    """The agents as an array literal, for one ``explode`` per review."""
    return F.array(*[
        F.struct(F.lit(n).alias("agent_ord"), F.lit(a.name).alias("agent_name"), F.lit(a.category).alias("category"),
                 F.lit(a.pass_text).alias("pass_text"), F.lit(a.flag_head).alias("flag_head"), F.lit(a.flag_tail).alias("flag_tail"))
        for n, a in enumerate(agents, 1)
    ])
