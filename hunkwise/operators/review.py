"""From findings to reviews: dedupe, rank, agent rows, verdict, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.operators.ranking import HOT_ROWS, hot_groups, number_whole, rank_in_group, split_hot
from hunkwise.schemas import AGENTS, BLOCKING, Agent, agent_array, severity_rank

RANK_BIN_LINES = 4096


def dedupe_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """First by ``seq`` per (review, file, line, category, title).

    An aggregation, not a window: it combines on the map side, so a key with very many copies stays cheap. ``seq`` leads the
    struct whose least is taken, so it is moved once.
    """
    key = [*keys, "file", "line_start", "category", "title"]
    rest = [c for c in findings.columns if c not in key]
    ordered = F.struct("seq", *[c for c in rest if c != "seq"])
    first = findings.groupBy(*key).agg(F.min(F.when(F.col("seq").isNotNull(), ordered)).alias("first"))
    return first.select(*key, *[F.col(f"first.{c}").alias(c) for c in rest])


def _rank_buckets() -> dict[str, Column]:
    return {
        "rank_severity": severity_rank(F.col("severity")),
        "rank_file": F.col("file"),
        "rank_block": F.floor(F.col("line_start") / RANK_BIN_LINES),
    }


_ORDER = ["line_start", "seq"]


def rank_findings(findings: DataFrame, keys: list[str], keep_unranked: bool = False) -> DataFrame:
    """``finding_ord`` per review: severity, file, line, then arrival order.

    A review may hold a large share of all findings, so a large one is numbered by pieces of (severity, file, block of
    lines) and never sorted in one task.
    """
    return rank_in_group(findings, keys, _rank_buckets(), _ORDER, "finding_ord", keep_unranked=keep_unranked)


def unique_ranked(findings: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The unique findings with their ``finding_ord``; a finding without a review key, file or line has none (null).

    The same rows as :func:`dedupe_findings` and :func:`rank_findings` give, but the findings of a review with at most
    ``hot_rows`` of them move once, by review, for both. Those of a larger review go through the two steps, which spread it.
    ``findings`` is read for the counts and for the rows, so it should be staged.
    """
    hot = hot_groups(findings, keys, hot_rows)
    small = split_hot(findings, hot, keys, "left_anti").repartition(*keys)
    small = number_whole(dedupe_findings(small, keys), keys, _rank_buckets(), _ORDER, "finding_ord", keep_unranked=True)
    large = rank_findings(dedupe_findings(split_hot(findings, hot, keys, "inner"), keys), keys, keep_unranked=True)
    return small.unionByName(large)


def agent_results(reviews: DataFrame, findings: DataFrame, keys: list[str],
                  summaries: DataFrame | None = None, agents: list[Agent] = AGENTS) -> DataFrame:
    """One row per review and agent, also without findings: count before the cross-agent dedupe, pass flag,
    summary text. ``findings`` has ``origin`` (``rule`` or ``model``); ``summaries`` are model summaries per
    (review, category). A caller's own ``agents`` take the place of the four."""
    per_agent = findings.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("origin") == "rule").alias("n_rule"),
        F.bool_or(F.col("severity").isin(BLOCKING)).alias("blocked"),
    )
    every = reviews.select(*keys).withColumn("agent", F.explode(agent_array(agents))).select(*keys, "agent.*")
    rows = every.join(per_agent, [*keys, "category"], "left").withColumns({
        "n_findings": F.coalesce("n_findings", F.lit(0)),
        "passed": ~F.coalesce("blocked", F.lit(False)),
    })
    if summaries is None:
        rows = rows.withColumn("model_summary", F.lit(None).cast("string"))
    else:
        # one reply per (review, category) is expected; were there more, the least text is taken
        one = summaries.groupBy(*keys, "category").agg(F.min("summary").alias("model_summary"))
        rows = rows.join(one, [*keys, "category"], "left")
    use_model = (F.coalesce(F.col("model_summary"), F.lit("")) != "") & (F.coalesce("n_rule", F.lit(0)) == 0)
    return rows.select(
        *keys, "agent_ord", "agent_name", "category", "n_findings",
        F.when(use_model, F.col("model_summary")).when(F.col("passed"), F.col("pass_text"))
        .otherwise(F.concat("flag_head", F.col("n_findings").cast("string"), "flag_tail")).alias("summary"),
        "passed",
    )


def verdicts(reviews: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """``verdict`` and ``total_findings`` per review; ``findings`` are the deduplicated ones."""
    per_review = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.bool_or(F.col("severity").isin(BLOCKING)).alias("blocked"),
    )
    return reviews.select(*keys).join(per_review, keys, "left").select(
        *keys,
        F.when(F.col("total_findings").isNull(), "APPROVE").when(F.col("blocked"), "REQUEST_CHANGES")
        .otherwise("COMMENT").alias("verdict"),
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
    )


def review_sizes(reviews: DataFrame, files: DataFrame, snippets: DataFrame, keys: list[str]) -> DataFrame:
    """File count, kept scopes and token estimate per review: a quarter of the characters, at least one.

    ``files`` has ``patch``; ``snippets`` has one row per kept scope with ``n_chars`` of its text.
    """
    per_files = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.length(F.coalesce("patch", F.lit("")))).alias("patch_chars")
    )
    per_scopes = snippets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("symbols_modified"), F.sum("n_chars").alias("snippet_chars")
    )
    zero = F.lit(0)
    chars = F.coalesce("patch_chars", zero) + F.coalesce("snippet_chars", zero)
    return reviews.select(*keys).join(per_files, keys, "left").join(per_scopes, keys, "left").select(
        *keys,
        F.coalesce("n_files", zero).alias("n_files"),
        F.coalesce("symbols_modified", zero).alias("symbols_modified"),
        F.greatest(F.lit(1), F.floor(chars / 4)).alias("estimated_tokens"),
    )
