"""The whole review: files, sources and model replies in; findings, agent rows, verdicts and texts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.operators.cover import cover, modified_lines, unscoped_lines
from hunkwise.operators.diff import changed_lines, new_side_ranges
from hunkwise.operators.model import decode_replies, explode_items, merge_findings, model_findings, quarantine
from hunkwise.operators.review import agent_results, review_sizes, unique_ranked, verdicts
from hunkwise.operators.scopes import with_source_text
from hunkwise.plans.enrich import file_symbols, gated_files
from hunkwise.plans.findings import rule_findings, scope_columns, seq, with_texts
from hunkwise.plans.prompts import prompt_corpus, prompt_pairs
from hunkwise.plans.report import Brand, dry_run_rows, inline_comments, report_blocks, review_rows, submissions
from hunkwise.rules import LINE_RULES, Rule
from hunkwise.schemas import AGENTS, FILE_KEYS, REVIEW_KEYS, SOURCE_KEYS, Agent, agent_order
from hunkwise.session import stage


@dataclass
class ReviewTables:
    """Lazy results over one staged table of ranked findings."""

    findings: DataFrame
    agent_results: DataFrame
    verdicts: DataFrame
    quarantine: DataFrame | None
    _contexts: DataFrame
    _files: DataFrame
    _brand: Brand

    def inline_comments(self) -> DataFrame:
        return inline_comments(self.findings, REVIEW_KEYS, self._brand)

    def submissions(self) -> DataFrame:
        return submissions(self.verdicts, self.findings, new_side_ranges(self._files, FILE_KEYS), REVIEW_KEYS)

    def reports(self) -> DataFrame:
        contexts = self._contexts
        if "elapsed_ms" not in contexts.columns:
            contexts = contexts.withColumn("elapsed_ms", F.lit("0.0"))
        return report_blocks(contexts, self.verdicts, self.agent_results, self.findings, REVIEW_KEYS, self._brand)

    def reviews(self) -> DataFrame:
        """The rows of the review sink, one a review: verdict, total and the report as ``body``."""
        return review_rows(self.verdicts, self.reports(), REVIEW_KEYS)

    def dry_run(self) -> DataFrame:
        return dry_run_rows(self.verdicts)


def model_rows(model: DataFrame, agents: list[Agent] = AGENTS) -> DataFrame:
    """Model findings in the shape of rule findings."""
    return model.withColumns({
        "rule_no": F.lit(None).cast("int"),
        "origin": F.lit("model"),
        "seq": seq(agent_order(F.col("category"), agents), 1, F.col("item_ord")),
    })


def review(contexts: DataFrame, pr_files: DataFrame, sources: DataFrame, model_responses: DataFrame | None = None,
           symbols: DataFrame | None = None, rules: list[Rule] = LINE_RULES, brand: Brand = Brand(),
           agents: list[Agent] = AGENTS, extra_findings: DataFrame | None = None) -> ReviewTables:
    """Reviews all ``contexts``. ``symbols`` may come from elsewhere; otherwise they come from ``sources``.

    Custom agents: ``rules`` and ``agents`` replace the built-in ones, and ``extra_findings`` (review keys, file,
    line_start, line_end, symbol_name, category, severity, title, message, suggested_fix, confidence_score, and
    ``item_ord``, their order) are findings of any other job; they count as the agent's own, after its rules.
    """
    files = gated_files(pr_files.join(contexts.select(*REVIEW_KEYS), REVIEW_KEYS, "left_semi"))
    if symbols is None:
        symbols = file_symbols(files, sources)
    found = rule_findings(changed_lines(files, [*FILE_KEYS, "file_ord"]), symbols, sources, REVIEW_KEYS, rules,
                          agents=agents, source_keys=SOURCE_KEYS)
    bad_replies = summaries = None
    if extra_findings is not None:
        own = extra_findings.withColumns({
            "rule_no": F.lit(None).cast("int"), "origin": F.lit("rule"),
            "seq": seq(agent_order(F.col("category"), agents), 0, F.col("item_ord"), phase=2)}).drop("item_ord")
        found = found.unionByName(own, allowMissingColumns=True)
    if model_responses is not None:
        decoded = decode_replies(model_responses.join(contexts.select(*REVIEW_KEYS), REVIEW_KEYS, "left_semi"))
        with_category = [*REVIEW_KEYS, "category"]
        model = model_rows(model_findings(explode_items(decoded, with_category), with_category), agents)
        found = merge_findings(found, model, with_category).drop("item_ord")
        bad_replies, summaries = quarantine(decoded), decoded.select(*with_category, "summary")
    found = stage(found, "findings")
    unique = stage(unique_ranked(found, REVIEW_KEYS), "unique-findings")
    return ReviewTables(
        findings=with_texts(unique.where("finding_ord IS NOT NULL"), rules),  # long texts join last, on the map side
        agent_results=agent_results(contexts, found, REVIEW_KEYS, summaries, agents),
        verdicts=verdicts(contexts, unique, REVIEW_KEYS),
        quarantine=bad_replies, _contexts=contexts, _files=files, _brand=brand,
    )


@dataclass
class EnrichedTables:
    """Files with line lists and unscoped lines, and their kept scopes with text."""

    contexts: DataFrame
    files: DataFrame
    symbols: DataFrame

    def sizes(self) -> DataFrame:
        chars = self.symbols.select(*REVIEW_KEYS, F.length("code_snippet").alias("n_chars"))
        return review_sizes(self.contexts, self.files, chars, REVIEW_KEYS)

    def prompts(self) -> DataFrame:
        return prompt_corpus(self.contexts, self.files, self.symbols, REVIEW_KEYS)

    def prompt_pairs(self, system_prompts: dict[str, str] | None = None) -> DataFrame:
        return prompt_pairs(self.prompts(), REVIEW_KEYS, system_prompts)


def enrich(contexts: DataFrame, pr_files: DataFrame, sources: DataFrame,
           symbols: DataFrame | None = None) -> EnrichedTables:
    """The context of each review: what a prompt or a size estimate needs."""
    files = gated_files(pr_files.join(contexts.select(*REVIEW_KEYS), REVIEW_KEYS, "left_semi"))
    if symbols is None:
        symbols = file_symbols(files, sources)
    lines = files.select(*FILE_KEYS, F.explode("changed_lines").alias("line"))
    covered = cover(lines, scope_columns(symbols, FILE_KEYS), FILE_KEYS)
    own = modified_lines(covered, FILE_KEYS).select(*FILE_KEYS, "visit", "modified_lines")
    kept = with_source_text(symbols.join(own, [*FILE_KEYS, "visit"]), sources, SOURCE_KEYS)
    # one group is one file: bounded by its patch cell
    loose = unscoped_lines(covered, FILE_KEYS).groupBy(*FILE_KEYS).agg(
        F.sort_array(F.collect_set("line")).alias("unscoped_lines"))
    with_loose = files.join(loose, FILE_KEYS, "left").withColumn(
        "unscoped_lines", F.coalesce("unscoped_lines", F.array().cast("array<int>")))
    return EnrichedTables(contexts, with_loose, kept)
