"""Prompt texts per review: the full corpus per category, and a compact code context.

A review's text is a table of blocks, as in ``report``: the head, one block per file, and the closing. It is the same for all
categories, so the blocks are kept once; ``prompt_pairs`` joins them and sets each category's system prompt beside the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.functions.text import int_list
from hunkwise.operators.assemble import PART_CHARS, assemble
from hunkwise.operators.ranking import rank_in_group

CLOSING = (  # fixed value
    "Analyze the changes above according to your specialized role. "
    "Return your structured evaluation in JSON adhering to the required schema."
)
# Role texts of our own; a caller gives other texts to ``prompt_corpus``.
SYSTEM_PROMPTS = {
    "security": "You review code changes for security. Report exploitable weaknesses in the changed lines: injection, "
                "leaked secrets, missing access checks, unsafe deserialization, weak cryptography. Answer in JSON only.",
    "performance": "You review code changes for performance. Report costs that matter: nested loops over growing data, "
                   "queries inside loops, blocking calls in async code, unbounded memory. Answer in JSON only.",
    "bug_risk": "You review code changes for correctness. Report defects: unchecked null values, wrong conditions, "
                "swallowed errors, mutable defaults, races. Answer in JSON only.",
    "code_quality": "You review code changes for maintainability. Report missing types and docstrings, overly complex "
                    "functions, leftover debug output, unclear names. Answer in JSON only.",
}


def _joined(pieces: Column, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), separator)


def _symbol_block(full: bool) -> Column:
    lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    if full:
        head = F.concat(F.lit(" (Type: "), F.col("node_type"), F.lit(", Lines "), lines, F.lit(", Modified Lines: "))
    else:
        head = F.concat(F.lit(" (lines "), lines, F.lit(", changed lines: "))
    return F.concat(
        F.lit("```symbol:"), F.col("name"), head, int_list(F.col("modified_lines")), F.lit(")\n"), F.col("code_snippet"),
        F.lit("\n```"))


def file_sections(files: DataFrame, symbols: DataFrame, keys: list[str], full: bool = True) -> DataFrame:
    """One text per file. A group here is one file: its scopes, whose texts come from one source cell.

    ``files``: status, language, changed_lines, unscoped_lines, patch. ``symbols``: kept scopes with
    start_line, end_line, visit, name, node_type, modified_lines, code_snippet.
    """
    blocks = symbols.select(
        *keys, "filename", F.struct("start_line", "visit", _symbol_block(full).alias("text")).alias("piece")
    ).groupBy(*keys, "filename").agg(_joined(F.collect_list("piece")).alias("symbol_text"))
    rows = files.join(blocks, [*keys, "filename"], "left")
    patch = F.nullif(F.col("patch"), F.lit(""))
    if full:
        text = F.concat_ws(
            "\n",
            F.concat(F.lit("### File: `"), F.col("filename"), F.lit("` (Status: "), F.col("status"), F.lit(", Language: "),
                     F.col("language"), F.lit(")")),
            F.concat(F.lit("**Changed line numbers in new file:** `"), int_list(F.col("changed_lines")), F.lit("`")),
            F.concat(F.lit("#### Enclosing AST Symbols (Functions / Classes):\n"), F.col("symbol_text")),
            F.when(F.size("unscoped_lines") > 0, F.concat(
                F.lit("**Unscoped modified lines (e.g. imports, global config):** `"), int_list(F.col("unscoped_lines")),
                F.lit("`"))),
            F.concat(F.lit("#### Git Unified Patch:\n```diff\n"), patch, F.lit("\n```")),
            F.lit("---"),
        )
    else:
        text = F.concat_ws(
            "\n",
            F.concat(F.lit("### File: `"), F.col("filename"), F.lit("` (status: "), F.col("status"), F.lit(", language: "),
                     F.col("language"), F.lit(")")),
            F.concat(F.lit("#### Changed Code Symbols (Functions/Classes):\n"), F.col("symbol_text")),
            F.concat(F.lit("#### Git Unified Diff:\n```diff\n"), patch, F.lit("\n```")),
            F.lit(""),
        )
    return rows.select(*keys, "filename", "file_ord", text.alias("text"))


def _blocks(heads: DataFrame, files: DataFrame, sections: DataFrame, keys: list[str], closing: str | None) -> DataFrame:
    # files are numbered by their narrow rows; the texts join afterwards
    order = rank_in_group(
        files.select(*keys, "filename", "file_ord"), keys,
        {"ord_block": F.floor(F.col("file_ord") / 4096)}, ["file_ord", "filename"], "section_ord")
    ranked = sections.select(*keys, "filename", "text").join(order.drop("file_ord"), [*keys, "filename"])
    ends = [F.struct(F.lit(0).cast("long").alias("block_ord"), F.col("head").alias("text"))]
    if closing is not None:
        ends.append(F.struct((F.col("n_files") + 1).cast("long").alias("block_ord"), F.lit(closing).alias("text")))
    rows = heads.withColumn("block", F.explode(F.array(*ends))).select(*keys, "block.block_ord", "block.text")
    return rows.union(ranked.select(*keys, F.col("section_ord").cast("long").alias("block_ord"), "text"))


def _heads(contexts: DataFrame, files: DataFrame, keys: list[str], head: Column) -> DataFrame:
    counts = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))
    return contexts.join(counts, keys, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0))).select(
        *keys, "n_files", head.alias("head"))


def prompt_roles(spark: SparkSession, system_prompts: dict[str, str] | None = None) -> DataFrame:
    """(category, system_prompt): goes with every review's blocks."""
    return spark.createDataFrame(list((system_prompts or SYSTEM_PROMPTS).items()), "category string, system_prompt string")


def prompt_corpus(contexts: DataFrame, files: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The user prompt per review: ``block_ord`` (from 0, without gaps) and ``text``, to be joined by line breaks."""
    # fixed values: the texts around the columns
    head = F.concat(
        F.lit("# Pull Request: #"), F.col("pr_number").cast("string"), F.lit(" — "), F.col("pr_title"),
        F.lit("\n**Repository:** "), F.col("repo_full_name"), F.lit("\n**Author:** @"), F.col("author_login"),
        F.lit("\n**Base Branch:** `"), F.col("base_branch"), F.lit("` | **Head Branch:** `"), F.col("head_branch"),
        F.lit("`\n**Changes:** +"), F.col("additions").cast("string"), F.lit(" / -"), F.col("deletions").cast("string"),
        F.lit(" across "), F.col("n_files").cast("string"), F.lit(" file(s)\n\n## Modified Files & Enclosing AST Context:"))
    return _blocks(_heads(contexts, files, keys, head), files, file_sections(files, symbols, keys), keys, CLOSING)


def prompt_pairs(blocks: DataFrame, keys: list[str], system_prompts: dict[str, str] | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """One (``system_prompt``, ``user_prompt``) per review and category, from the blocks of :func:`prompt_corpus`. A text beyond
    ``part_chars`` comes as several rows (``part`` of ``n_parts``)."""
    roles = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("system_prompt")) for c, p in (system_prompts or SYSTEM_PROMPTS).items()])
    texts = assemble(blocks, keys, "block_ord", "text", part_chars=part_chars)
    return texts.withColumn("role", F.explode(roles)).select(*keys, "role.*", "part", "n_parts", F.col("text").alias("user_prompt"))


def compact_context(contexts: DataFrame, files: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The shorter form: title, repository, author, file count, then scopes and patches."""
    head = F.concat(
        F.lit("PR Title: "), F.col("pr_title"), F.lit("\nRepository: "), F.col("repo_full_name"), F.lit("\nAuthor: "),
        F.col("author_login"), F.lit("\nModified Files: "), F.col("n_files").cast("string"), F.lit("\n---"))
    return _blocks(_heads(contexts, files, keys, head), files, file_sections(files, symbols, keys, full=False), keys, None)
