"""The registered queries. Each reads the driver tables through ``inputs`` and runs operators over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.functions.hmac import hmac_sha256_hex
from hunkwise.operators import cover as cov
from hunkwise.operators import detect, diff, events, files, model, review, scopes
from hunkwise.plans import findings as plan_findings
from hunkwise.plans import prompts, report
from hunkwise.plans import review as plan_review
from hunkwise.plans.local import review_local
from hunkwise.rules import LOGIC_RULES, PERFORMANCE_RULES, QUALITY_RULES, SECURITY_RULES, LINE_RULES, Rule
from hunkwise.schemas import REVIEW_KEYS
from hunkwise.session import stage, stage_path
from hunkwise.sources.tables import diff_summary, read_reviews, write_reviews
from hunkwise.streaming.intake import judged_rows, read_judged, start_intake
from registry import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FILE = ["doc_id", "filename"]
CONTEXT_COLUMNS = [
    "installation_id", "repo_full_name", "repo_clone_url", "pr_number", "pr_title", "head_sha", "head_branch",
    "base_branch", "author_login", "additions", "deletions", "changed_files",
]
CUSTOM_RULE = Rule("CUSTOM-001", "security", "critical", "Planted token", r'\btoken\s*=\s*"[0-9a-f]{40}"',
                   "A token is in the text.", None, 0.9, ("token",))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def numbers_text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


# ── files ────────────────────────────────────────────────────────────────────────────────────────────

@query
def file_filter(spark, sf):
    f = F.col("filename")
    return inputs.paths(spark, sf).select(
        "doc_id", "filename", files.is_lockfile(f).alias("lockfile"), files.has_ignored_suffix(f).alias("binary_suffix"),
        files.is_minified(f).alias("minified"), files.in_ignored_dir(f).alias("ignored_dir"), files.is_ignored(f).alias("ignored"))


@query
def file_language(spark, sf):
    f = F.col("filename")
    return inputs.paths(spark, sf).select("doc_id", files.suffix(f).alias("suffix"), files.language(f).alias("language"))


def _raw_files(spark, sf):
    d = F.col("doc_id")
    return inputs.patches(spark, sf).join(inputs.paths(spark, sf), "doc_id").select(
        "doc_id", "filename",
        F.when(d % 4 == 0, F.lit(None)).when(d % 4 == 1, "").when(d % 4 == 2, "removed").otherwise("renamed").alias("status"),
        F.when(d % 3 == 0, F.lit(None)).otherwise((d % 9).cast("int")).alias("additions"),
        F.when(d % 5 == 0, F.lit(None)).otherwise((d % 7).cast("int")).alias("deletions"),
        F.when(d % 6 == 0, "").otherwise(F.col("patch")).alias("patch"))


@query
def file_defaults(spark, sf):
    return files.reviewable(_raw_files(spark, sf)).select(
        "doc_id", "filename", "status", "additions", "deletions", "language", F.col("patch").isNull().alias("no_patch"))


@query
def parse_gate(spark, sf):
    gated = diff.with_line_lists(files.reviewable(_raw_files(spark, sf)))
    return files.parse_gate(gated).select("doc_id", F.size("changed_lines").alias("n_changed"))


# ── diffs ────────────────────────────────────────────────────────────────────────────────────────────

@query
def diff_lines(spark, sf):
    return diff.diff_lines(inputs.patches(spark, sf), ["doc_id"]).where("kind <> 'hdr'").select(
        "doc_id", "hunk", "pos", "kind", "old_line", "new_line", "line")


@query
def diff_changed_lines(spark, sf):
    return diff.with_line_lists(inputs.patches(spark, sf)).select(
        "doc_id", numbers_text("changed_lines"), numbers_text("deleted_lines"))


@query
def diff_added_text(spark, sf):
    return diff.changed_lines(inputs.patches(spark, sf), ["doc_id"])


@query
def diff_hunks(spark, sf):
    return diff.diff_hunks(inputs.patches(spark, sf), ["doc_id"]).select(
        "doc_id", "hunk", "old_start", "old_lines", "new_start", "new_lines", "header", F.size("lines").alias("n_lines"),
        F.array_join("lines", "\n").alias("raw"), numbers_text("modified_new_lines"))


@query
def whole_tree_diff(spark, sf):
    """Documents of one source language joined to multi-file diffs by tens, as one text each."""
    pieces = inputs.patches(spark, sf).select(
        F.floor(F.col("doc_id") / 10).alias("tree"), "doc_id",
        F.concat(F.format_string("diff --git a/%d b/%d\n--- a/%d\n+++ b/%d\n", *["doc_id"] * 4), F.col("patch")).alias("p"))
    diffs = pieces.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("doc_id", "p"))).alias("ps")).select(
        "tree", F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("diff"))
    return diff_summary(diffs, ["tree"])


# ── scopes and changed lines ─────────────────────────────────────────────────────────────────────────

def _changed(spark, sf):
    return inputs.code_lines(spark, sf).where("changed").select(*FILE, "line", "text", F.lit(0).alias("file_ord"))


def _covered(spark, sf):
    return cov.cover(_changed(spark, sf).drop("text"), plan_findings.scope_columns(inputs.code_scopes(spark, sf), FILE), FILE)


@query
def scope_join(spark, sf):
    lines = _changed(spark, sf).select(*FILE, "line")
    spans = inputs.code_scopes(spark, sf).select(*FILE, "visit", "name", "start_line", "end_line")
    return cov.interval_join(lines, spans, FILE).select("doc_id", "line", "visit", "name")


@query
def class_residual(spark, sf):
    return _covered(spark, sf).where("is_class AND modified").select("doc_id", "name", "line")


@query
def unscoped_lines(spark, sf):
    return cov.unscoped_lines(_covered(spark, sf), ["doc_id"])


@query
def symbol_modified_lines(spark, sf):
    own = cov.modified_lines(_covered(spark, sf), FILE)
    return cov.symbol_order(own, FILE).select("doc_id", "symbol_ord", "visit", "name", numbers_text("modified_lines"))


@query
def symbols_modified(spark, sf):
    return cov.symbols_modified(_covered(spark, sf), ["doc_id"])


# ── rule scans ───────────────────────────────────────────────────────────────────────────────────────

def _hits(spark, sf, rules):
    lines = detect.with_hits(_changed(spark, sf), rules).drop("text")
    symbols = plan_findings.scope_columns(inputs.code_scopes(spark, sf), FILE)
    return plan_findings.hit_rows(cov.cover(lines, symbols, FILE), rules)


def _scan(spark, sf, rules):
    return _hits(spark, sf, rules).where("visit IS NOT NULL AND rule_no > 0").select(
        "doc_id", "line", F.col("name").alias("symbol_name"), "rule_id", "severity")


@query
def scan_security(spark, sf):
    return _scan(spark, sf, SECURITY_RULES)


@query
def scan_logic(spark, sf):
    return _scan(spark, sf, LOGIC_RULES)


@query
def scan_quality(spark, sf):
    return _scan(spark, sf, QUALITY_RULES)


@query
def scan_performance(spark, sf):
    hits = stage(_hits(spark, sf, PERFORMANCE_RULES).where("visit IS NOT NULL AND rule_no > 0"), "hits")
    texts = inputs.code_lines(spark, sf).select(*FILE, "line", "text")
    return plan_findings.depth_filter(hits, texts, FILE).select(
        "doc_id", "line", F.col("name").alias("symbol_name"), "rule_id", "severity")


@query
def scan_unscoped(spark, sf):
    return _hits(spark, sf, LINE_RULES).where("visit IS NULL").select("doc_id", "line", "rule_id", "severity")


@query
def missing_docstring(spark, sf):
    return _hits(spark, sf, []).where("rule_no = 0").select("doc_id", "line", F.col("name").alias("symbol_name"), "title")


@query
def loop_depth(spark, sf):
    steps = inputs.code_lines(spark, sf).select(*FILE, "line", detect.loop_step(F.col("text")).alias("step"))
    spans = inputs.code_scopes(spark, sf).select(*FILE, "visit", "start_line", "end_line")
    inside = cov.interval_join(steps, spans, FILE)
    return detect.with_loop_depth(inside, [*FILE, "visit"]).select("doc_id", "visit", "line", "loop_depth")


@query
def scan_snippets(spark, sf):
    """All rules on scopes that come with their own text."""
    symbols = inputs.code_scopes(spark, sf)
    changed = _changed(spark, sf).select(*FILE, "line")
    found = plan_findings.snippet_findings(symbols, changed, ["doc_id"])
    return plan_findings.with_texts(found).select(
        "doc_id", "line_start", "symbol_name", "category", "severity", "title", "message", "suggested_fix", "confidence_score")


@query
def scan_custom_rule(spark, sf):
    lines = inputs.doc_lines(spark, sf)
    return detect.scan_text(lines, [CUSTOM_RULE]).select("doc_id", "pos", "rule_id", "severity", "title")


# ── scopes from source ───────────────────────────────────────────────────────────────────────────────

def _scope_rows(symbols):
    return symbols.select(
        "doc_id", "visit", "name", "node_type", "parent_symbol", "start_line", "end_line", "docstring", "is_class", "is_async")


def _with_text(sources):
    return scopes.with_source_text(scopes.scopes(sources, FILE), sources, FILE)


@query
def scopes_indent(spark, sf):
    return _scope_rows(_with_text(inputs.python_sources(spark, sf)))


@query
def scopes_brace(spark, sf):
    return _scope_rows(_with_text(inputs.brace_sources(spark, sf)))


@query
def scope_snippets(spark, sf):
    return _with_text(inputs.brace_sources(spark, sf)).select("doc_id", "visit", "code_snippet")


# ── model replies ────────────────────────────────────────────────────────────────────────────────────

def _items(spark, sf):
    return model.explode_items(model.decode_replies(inputs.replies(spark, sf)), ["review", "category"])


@query
def model_decode(spark, sf):
    return model.decode_replies(inputs.replies(spark, sf)).select(
        "review", "reply_status", "summary", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))


@query
def model_filter(spark, sf):
    return model.model_findings(_items(spark, sf), ["review", "category"]).drop("category")


def _rule_places(spark, sf):
    """Rule findings at every line: small quantities in the category of the model's findings, the others beside it."""
    return inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review"), F.when(F.col("l_quantity") < 10, "security").otherwise("performance").alias("category"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file"),
        F.col("l_linenumber").alias("line_start"), F.lit("r").alias("title"), F.lit("rule").alias("origin"))


@query
def merge_findings(spark, sf):
    keys = ["review", "category"]
    found = model.model_findings(_items(spark, sf), keys).withColumn("origin", F.lit("model"))
    return model.merge_findings(_rule_places(spark, sf), found, keys).select(
        "review", "category", "file", "line_start", "title", "origin", "item_ord")


# ── reviews from findings ────────────────────────────────────────────────────────────────────────────

KEY = ["review"]


DEDUPE_COLUMNS = [*KEY, "file", "line_start", "category", "title", "seq"]


def _unique(spark, sf, *rest):
    """``rest``: the columns wanted beside those of the dedupe; no others are moved."""
    found = inputs.order_findings(spark, sf)
    return review.dedupe_findings(found.select(*DEDUPE_COLUMNS, *rest) if rest else found, KEY)


def _ranked(spark, sf, *rest):
    """``rest``: the columns wanted beside those of the dedupe; no others are written or moved."""
    found = stage(inputs.order_findings(spark, sf).select(*DEDUPE_COLUMNS, *rest), "findings")
    return review.unique_ranked(found, KEY).where("finding_ord IS NOT NULL")


def _verdicts(spark, sf, unique=None):
    return review.verdicts(inputs.customer_reviews(spark, sf), _unique(spark, sf, "severity") if unique is None else unique, KEY)


def _summaries(spark, sf):
    r = F.col("c_custkey")
    return inputs.table(spark, sf, "customer").select(
        r.alias("review"), inputs.pick(["security", "performance", "bug_risk", "code_quality"], r % 4).alias("category"),
        F.when(r % 2 == 1, F.lit(None)).when(r % 10 == 0, "").otherwise("model says fine").alias("summary"))


def _agents(spark, sf, found=None):
    return review.agent_results(
        inputs.customer_reviews(spark, sf), inputs.order_findings(spark, sf) if found is None else found, KEY, _summaries(spark, sf))


def _reports(spark, sf):
    """Verdicts and report blocks, both from findings that are joined and deduplicated once."""
    found = stage(inputs.order_findings(spark, sf), "findings")
    unique = stage(review.unique_ranked(found, KEY), "unique-findings")
    verdicts = _verdicts(spark, sf, unique)
    ranked = unique.where("finding_ord IS NOT NULL")
    return verdicts, report.report_blocks(inputs.customer_reviews(spark, sf), verdicts, _agents(spark, sf, found), ranked, KEY)


@query
def dedupe_findings(spark, sf):
    return _unique(spark, sf).select(
        "review", "file", "line_start", "category", "title", "severity", "symbol_name", "message",
        F.col("seq.l_orderkey").alias("l_orderkey"), F.col("seq.l_partkey").alias("l_partkey"))


@query
def rank_findings(spark, sf):
    return _ranked(spark, sf, "severity", "message").select("review", "finding_ord", "severity", "file", "line_start", "category", "title", "message")


@query
def verdict(spark, sf):
    return _verdicts(spark, sf)


@query
def review_sink(spark, sf):
    """Verdicts and report texts written three times (other totals, the whole, and the same batch again) and read back."""
    path = stage_path(spark, "review-sink")
    found = stage(report.review_rows(*_reports(spark, sf), KEY), "review-rows")
    write_reviews(found.withColumn("total_findings", F.col("total_findings") + 1), path, "first")
    for _ in range(2):
        write_reviews(found, path, "second")
    return read_reviews(spark, path, keys=KEY).select(
        "review", "verdict", "total_findings", "part", "n_parts", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query
def agent_results(spark, sf):
    return _agents(spark, sf).select("review", "agent_ord", "agent_name", "category", "n_findings", "passed")


@query
def agent_summary(spark, sf):
    return _agents(spark, sf).select("review", "agent_name", "summary")


@query
def dry_run(spark, sf):
    rows = _verdicts(spark, sf).join(inputs.customer_reviews(spark, sf).select("review", "repo_full_name", "pr_number"), "review")
    return report.dry_run_rows(rows)


@query
def inline_comments(spark, sf):
    return report.inline_comments(_ranked(spark, sf, "severity", "symbol_name", "message", "suggested_fix", "confidence_score"), KEY)


def _new_side(spark, sf):
    """Hunks of one added line at the places of all findings, but every fortieth part's far below its own; as the diff reads them."""
    lines = inputs.table(spark, sf, "lineitem").join(
        inputs.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_partkey") % 40 == 0, F.col("l_linenumber") + 1000).otherwise(F.col("l_linenumber")).cast("string")
    files = lines.select(
        F.col("o_custkey").alias("review"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("filename"),
        F.concat(F.lit("@@ -"), start, F.lit(",2 +"), start, F.lit(",1 @@\n-a\n-b\n+c\n\\ No newline at end of file")).alias("patch"))
    return diff.new_side_ranges(files, ["review", "filename"])


@query
def submission_payload(spark, sf):
    unique = stage(_unique(spark, sf, "severity").drop("seq"), "unique-findings")
    return report.submissions(_verdicts(spark, sf, unique), unique, _new_side(spark, sf), KEY)


@query
def report_markdown(spark, sf):
    return _reports(spark, sf)[1]


@query
def token_estimate(spark, sf):
    """Reviews of ten documents: patch texts, and the snippets of their scopes."""
    group = F.floor(F.col("doc_id") / 10).alias("review")
    reviews = inputs.table(spark, sf, "documents").select(group).distinct()
    patches = inputs.patches(spark, sf).select(group, "patch")
    snippets = inputs.code_scopes(spark, sf).select(group, F.length("code_snippet").alias("n_chars"))
    return review.review_sizes(reviews, patches, snippets, KEY)


# ── events ───────────────────────────────────────────────────────────────────────────────────────────

def _judged(spark, sf):
    return events.with_disposition(inputs.event_deliveries(spark, sf), inputs.SECRET)


@query
def signature_audit(spark, sf):
    rows = inputs.event_deliveries(spark, sf)
    return rows.select(
        "delivery_id", events.signature_state(F.col("signature"), F.col("body"), inputs.SECRET).alias("signature_state"),
        hmac_sha256_hex(inputs.SECRET, F.col("body")).alias("digest"))


@query
def event_disposition(spark, sf):
    return _judged(spark, sf).select("delivery_id", "disposition")


@query
def disposition_counts(spark, sf):
    return events.disposition_counts(_judged(spark, sf))


@query
def event_context(spark, sf):
    return events.review_contexts(_judged(spark, sf), ["delivery_id"])


@query
def stream_intake(spark, sf):
    """The events table as a file stream through intake, until all of it is read."""
    schema = inputs.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, checkpoint = stage_path(spark, "intake"), stage_path(spark, "intake-progress")
    run = start_intake(inputs.deliveries(stream), inputs.SECRET, out, checkpoint)
    run.awaitTermination()
    return read_judged(spark, out).select("delivery_id", "disposition", *CONTEXT_COLUMNS)


# ── prompts ──────────────────────────────────────────────────────────────────────────────────────────

def _prompt_inputs(spark, sf):
    """Reviews of ten documents with patch, line lists and the modified scopes of the code lines."""
    group = F.floor(F.col("doc_id") / 10)
    covered = _covered(spark, sf)
    own = cov.modified_lines(covered, FILE).select(*FILE, "visit", "modified_lines")
    symbols = inputs.code_scopes(spark, sf).join(own, [*FILE, "visit"]).withColumn(
        "node_type", F.when(F.col("is_class"), "class_definition").otherwise("function_definition"))
    loose = cov.unscoped_lines(covered, ["doc_id"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("unscoped_lines"))
    rows = diff.with_line_lists(inputs.patches(spark, sf)).join(loose, "doc_id", "left").select(
        group.alias("review"), F.col("doc_id").cast("string").alias("filename"), (F.col("doc_id") % 10).cast("int").alias("file_ord"),
        F.lit("modified").alias("status"), F.lit("python").alias("language"), "changed_lines",
        F.coalesce("unscoped_lines", F.array().cast("array<int>")).alias("unscoped_lines"), "patch")
    number = F.col("review")
    contexts = inputs.table(spark, sf, "documents").select(group.alias("review")).distinct().select(
        "review", number.alias("pr_number"), F.format_string("Change %d", number).alias("pr_title"),
        F.lit("org/app").alias("repo_full_name"), F.lit("dev").alias("author_login"), F.lit("main").alias("base_branch"),
        F.lit("feat").alias("head_branch"), F.lit(3).alias("additions"), F.lit(4).alias("deletions"))
    named = symbols.withColumn("review", group).withColumn("filename", F.col("doc_id").cast("string")).drop("doc_id")
    return contexts, rows, named


@query
def prompt_corpus(spark, sf):
    return prompts.prompt_corpus(*_prompt_inputs(spark, sf), KEY)


@query
def prompt_pairs(spark, sf):
    """System and user prompt of every review and category."""
    pairs = prompts.prompt_pairs(prompt_corpus(spark, sf), KEY)
    return pairs.select("review", "category", "part", "n_parts", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("system_prompt", "user_prompt")))


@query
def compact_context(spark, sf):
    return prompts.compact_context(*_prompt_inputs(spark, sf), KEY)


# ── whole reviews ────────────────────────────────────────────────────────────────────────────────────

def _review(spark, sf):
    return plan_review.review(
        inputs.review_contexts(spark, sf), inputs.review_files(spark, sf), inputs.review_sources(spark, sf))


@query
def review_findings(spark, sf):
    return _review(spark, sf).findings.select(
        "pr_number", "finding_ord", "file", "line_start", "symbol_name", "category", "severity", "title", "message",
        "suggested_fix", "confidence_score")


@query
def review_verdicts(spark, sf):
    tables = _review(spark, sf)
    per_agent = tables.agent_results.groupBy(*REVIEW_KEYS).pivot(
        "category", ["security", "performance", "bug_risk", "code_quality"]).agg(F.first("n_findings"))
    return tables.verdicts.join(per_agent, REVIEW_KEYS).drop("repo_full_name", "head_sha")


@query
def review_enrichment(spark, sf):
    return plan_review.enrich(
        inputs.review_contexts(spark, sf), inputs.review_files(spark, sf), inputs.review_sources(spark, sf)
    ).sizes().drop("repo_full_name", "head_sha")


@query
def local_review(spark, sf):
    """Every Python source as a local file, all lines counted as changed."""
    sources = inputs.python_sources(spark, sf).select(
        F.format_string("pkg/m%d.py", F.col("doc_id")).alias("review_file"), "content")
    return review_local(sources)["findings"].select(
        "review_file", "finding_ord", "line_start", "symbol_name", "category", "severity", "title")
