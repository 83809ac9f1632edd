"""File rows of a review: ignore rules, language, defaults and the parse gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lockfile names, ignored suffixes, ignored directory names, language per suffix.
LOCKFILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock",
    "composer.lock", "go.sum", "flake.lock",
]
IGNORED_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".bmp", ".tiff",
    ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".iso",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".webm",
    ".map",
]
IGNORED_DIRS = ["node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", ".next", ".git"]
LANGUAGE_SUFFIXES = {
    "python": [".py", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "go": [".go"], "rust": [".rs"], "java": [".java"],
    "cpp": [".cpp", ".hpp"], "c": [".c", ".h"], "csharp": [".cs"],
    "ruby": [".rb"], "php": [".php"], "swift": [".swift"],
    "kotlin": [".kt", ".kts"], "scala": [".scala"],
    "html": [".html"], "css": [".css"], "scss": [".scss"], "sql": [".sql"],
    "bash": [".sh", ".bash", ".zsh"],
    "json": [".json"], "yaml": [".yaml", ".yml"], "toml": [".toml"], "xml": [".xml"], "markdown": [".md"],
}


def path_parts(filename: Column) -> Column:
    """Lower-cased path components; empty and ``.`` components do not count."""
    return F.filter(F.split(F.lower(filename), "/"), lambda p: ~p.isin("", "."))


def base_name(filename: Column) -> Column:
    return F.coalesce(F.try_element_at(path_parts(filename), F.lit(-1)), F.lit(""))


def suffix(filename: Column) -> Column:
    """Last suffix of the base name, as pathlib counts it: none for ``.bashrc`` or ``notes.``."""
    return F.regexp_extract(base_name(filename), r"\A[\s\S]+(\.[^.]+)\z", 1)


def is_lockfile(filename: Column) -> Column:
    return base_name(filename).isin(LOCKFILES)


def has_ignored_suffix(filename: Column) -> Column:
    return suffix(filename).isin(IGNORED_SUFFIXES)


def is_minified(filename: Column) -> Column:
    return base_name(filename).endswith(".min.js") | base_name(filename).endswith(".min.css")


def in_ignored_dir(filename: Column) -> Column:
    """True when any path component, the base name included, is an ignored directory name."""
    return F.arrays_overlap(path_parts(filename), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def is_ignored(filename: Column) -> Column:
    return is_lockfile(filename) | has_ignored_suffix(filename) | is_minified(filename) | in_ignored_dir(filename)


def language(filename: Column) -> Column:
    """Language by suffix. A CASE over 24 short lists: no join, and it folds into the scan's projection."""
    ext = suffix(filename)
    out = None
    for name, suffixes in LANGUAGE_SUFFIXES.items():
        out = F.when(ext.isin(suffixes), name) if out is None else out.when(ext.isin(suffixes), name)
    return out.otherwise("unknown")


def with_defaults(pr_files: DataFrame) -> DataFrame:
    """Null or empty status is ``modified``, null counts are 0, an empty patch is null."""
    return pr_files.withColumns({
        "status": F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("modified")),
        "additions": F.coalesce(F.col("additions").try_cast("int"), F.lit(0)),
        "deletions": F.coalesce(F.col("deletions").try_cast("int"), F.lit(0)),
        "patch": F.nullif(F.col("patch"), F.lit("")),
    })


def reviewable(pr_files: DataFrame) -> DataFrame:
    """Files left after the ignore rules, with defaults and language."""
    kept = pr_files.where(~is_ignored(F.col("filename")))
    return with_defaults(kept).withColumn("language", language(F.col("filename")))


def parse_gate(files: DataFrame) -> DataFrame:
    """Files whose source is worth reading: not removed, and with added lines (``changed_lines`` array)."""
    return files.where((F.col("status") != "removed") & (F.size("changed_lines") > 0))
