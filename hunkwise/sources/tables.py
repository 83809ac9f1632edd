"""Input tables, local files and whole-tree diffs as inputs, and the review sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise import schemas
from hunkwise.functions.text import split_lines
from hunkwise.operators.diff import hunk_texts, with_line_lists
from hunkwise.operators.files import language
from hunkwise.schemas import REVIEW_KEYS
from hunkwise.sources.commits import compact, read_committed, write_batch

REVIEWS = "reviews"
TABLES = {
    "pr_events": schemas.PR_EVENTS_DDL,
    "reviews_ctx": schemas.REVIEW_CONTEXT_DDL,
    "pr_files": schemas.PR_FILES_DDL,
    "sources": schemas.SOURCES_DDL,
    "symbols": schemas.SYMBOLS_DDL,
    "model_responses": schemas.MODEL_RESPONSES_DDL,
}

# The review that stands for a local file.
LOCAL_REPO = "local/simulated-repo"
LOCAL_SHA = "00000000local"
LOCAL_TITLE = "Local Simulation Review of "
LOCAL_BRANCH, LOCAL_BASE, LOCAL_AUTHOR = "feature/local", "main", "local-developer"


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """One of TABLES with its declared schema: no inference, unknown fields are not read."""
    return spark.read.format(fmt).schema(TABLES[name]).options(**options).load(path)


def read_table_stream(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(TABLES[name]).options(**options).load(path)


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files as rows (``review_file``, ``content``), whole text per row."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.input_file_name(), r"\Afile:/+", "/").alias("review_file"), F.col("value").alias("content"))


def local_reviews(files: DataFrame, lines: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Each file (``review_file``, ``content``) as a review of its own: contexts, and file rows with their
    changed lines: the given ones (an int array), or all lines of the file."""
    every = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(split_lines(F.col("content")))))
    whole = F.when(F.size(split_lines(F.col("content"))) > 0, every).otherwise(F.array().cast("array<int>"))
    given = whole if lines is None else F.when(F.size(lines) > 0, lines).otherwise(whole)
    rows = files.select(
        F.lit(LOCAL_REPO).alias("repo_full_name"), F.lit(1).cast("bigint").alias("pr_number"),
        F.lit(LOCAL_SHA).alias("head_sha"), "review_file", F.col("review_file").alias("filename"),
        F.lit(0).alias("file_ord"), F.lit("modified").alias("status"), language(F.col("review_file")).alias("language"),
        F.lit(None).cast("string").alias("patch"), given.alias("changed_lines"), "content")
    contexts = rows.select(
        *REVIEW_KEYS, "review_file", F.lit(1).cast("bigint").alias("installation_id"),
        F.concat(F.lit(LOCAL_TITLE), F.element_at(F.split("review_file", "/"), -1)).alias("pr_title"),
        F.lit(LOCAL_BRANCH).alias("head_branch"), F.lit(LOCAL_BASE).alias("base_branch"),
        F.lit(LOCAL_AUTHOR).alias("author_login"), F.size("changed_lines").cast("bigint").alias("additions"),
        F.lit(0).cast("bigint").alias("deletions"), F.lit(1).cast("bigint").alias("changed_files"))
    return contexts, rows


def diff_summary(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Hunks and added lines of multi-file diff texts; file headers between hunks count as context."""
    return with_line_lists(diffs, diff).select(
        *keys, F.size(hunk_texts(F.col(diff))).alias("n_hunks"), F.size("changed_lines").alias("n_added"))


def write_reviews(reviews: DataFrame, path: str, batch: str | None = None) -> None:
    """Commit rows of reviews (verdict and text, or the blocks of reports). Nothing that was written before is read. The same ``batch``
    written again takes the place of its first write; without a name each write is a batch of its own."""
    spark = reviews.sparkSession
    write_batch(spark, path, batch or uuid.uuid4().hex, {REVIEWS: reviews.withColumn("written_on", F.current_date())})


def read_reviews(spark: SparkSession, path: str, since: str | None = None, keys: list[str] = REVIEW_KEYS) -> DataFrame:
    """The rows of each review's last write, so that writing again replaces. ``since``: a date, reviews last written before it are left out."""
    rows = read_committed(spark, path, REVIEWS, keys)
    if since is not None:
        rows = rows.where(F.col("written_on") >= F.lit(since).cast("date"))
    return rows.drop("written_on")


def compact_reviews(spark: SparkSession, path: str, keys: list[str] = REVIEW_KEYS) -> None:
    """One write in the place of all, each review's last."""
    compact(spark, path, {REVIEWS: keys})
