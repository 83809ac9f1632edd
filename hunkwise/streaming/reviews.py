"""The batch review of each micro-batch of accepted events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.plans.report import Brand
from hunkwise.plans.review import review
from hunkwise.rules import LINE_RULES, Rule
from hunkwise.schemas import REVIEW_KEYS
from hunkwise.sources.commits import commit_batch, put
from hunkwise.streaming.intake import OnBatch

#: Single rows that may fail in one batch; with more of them something else is wrong, and the batch fails.
MOST_FAILURES = 20
#: Halvings, each by one more bit of the key's hash; rows that still stand together then (repeated keys) fail together.
MOST_HALVINGS = 40


def isolate(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], None], most: int = MOST_FAILURES) -> list[tuple[DataFrame, str]]:
    """Runs ``work`` on all rows; where it fails, on each half of them, and so on down to single keys. Returns the rows that fail on
    their own with their error. A row that works is in exactly one call that succeeded."""
    failed: list[tuple[DataFrame, str]] = []

    def attempt(part: DataFrame, halvings: int) -> None:
        try:
            work(part)
            return
        except Exception as error:  # whatever one review makes fail: data, a rule, a missing column value
            found, text = error, f"{type(error).__name__}: {error}"
        if halvings >= MOST_HALVINGS or part.select(*keys).distinct().limit(2).count() < 2:
            failed.append((part, text))
            if len(failed) > most:
                raise found
            return
        side = F.shiftright(F.xxhash64(*keys), halvings).bitwiseAND(F.lit(1).cast("long"))
        for bit in (0, 1):
            half = part.where(side == bit)
            if not half.isEmpty():
                attempt(half, halvings + 1)

    attempt(rows, 0)
    return failed


def reviewing(pr_files: DataFrame, sources: DataFrame, out: str, model_responses: DataFrame | None = None,
              rules: list[Rule] = LINE_RULES, brand: Brand = Brand(), most_failures: int = MOST_FAILURES) -> OnBatch:
    """An ``on_batch`` that reviews the batch's pull requests against the landed tables and commits ``reviews``, ``reports``,
    ``inline_comments`` and ``failed`` (context and ``error`` of reviews that cannot be made) together: a batch that runs again after a
    failure replaces its rows in all of them. Read them with :func:`hunkwise.sources.commits.read_committed`. Of the landed tables
    only the rows of the batch's review keys are used; how much of them is read depends on how they are laid out."""

    def run(contexts: DataFrame, batch_id: int) -> None:
        batch, spark = str(batch_id), contexts.sparkSession
        folders: dict[str, list[str]] = {"reviews": [], "reports": [], "inline_comments": [], "failed": []}

        def work(part: DataFrame) -> None:
            tables = review(part, pr_files, sources, model_responses, rules=rules, brand=brand)
            made = {"reviews": tables.reviews(), "reports": tables.reports(), "inline_comments": tables.inline_comments()}
            written = {name: put(df, out, name, batch) for name, df in made.items()}
            for name, folder in written.items():  # all three or none
                folders[name].append(folder)

        for part, text in isolate(contexts.dropDuplicates(REVIEW_KEYS), REVIEW_KEYS, work, most_failures):
            folders["failed"].append(put(part.withColumn("error", F.lit(text)), out, "failed", batch))
        commit_batch(spark, out, batch, folders)

    return run
