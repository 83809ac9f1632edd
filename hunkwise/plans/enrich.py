"""Files of a review with their source and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.operators.diff import with_line_lists
from hunkwise.operators.files import parse_gate, reviewable
from hunkwise.operators.scopes import scopes
from hunkwise.schemas import FILE_KEYS, SOURCE_KEYS


def gated_files(pr_files: DataFrame) -> DataFrame:
    """Reviewable files with line lists, and ``parsed``: whether their source is looked up."""
    files = with_line_lists(reviewable(pr_files))
    return files.withColumn("parsed", (F.col("status") != "removed") & (F.size("changed_lines") > 0))


def file_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Source text of gated files by (repo, sha, name); a file without one simply has no scopes.

    The file side carries keys only, so this is the one place where source text may cross the network.
    """
    wanted = parse_gate(files).select(*FILE_KEYS, "language")
    return wanted.join(sources.select(*SOURCE_KEYS, "content"), SOURCE_KEYS).select(*FILE_KEYS, "language", "content")


def file_symbols(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Scopes of all gated files."""
    return scopes(file_sources(files, sources), FILE_KEYS, sized_by=sources)
