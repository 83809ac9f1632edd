"""Unified diffs as table work, without a shuffle.

A patch is one string cell, so its hunks and line numbers are computed inside its row with array
functions: the number of a new-side line is the hunk's start plus the line's position among the new-side
lines of the hunk, and likewise for the old side. No window and no exchange is needed, and a row's work is
linear in its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.steps import computed_once
from hunkwise.functions.text import strip, unix_lines

# The hunk header form; blanks are any but the line break.
_GAP = r"[^\S\n]+"
HEADER = rf"@@{_GAP}-([0-9]+)(?:,([0-9]+))?{_GAP}\+([0-9]+)(?:,([0-9]+))?{_GAP}@@(?:{_GAP}([^\n]*))?(?=\n|\z)"
_AT_START = r"(?U)\A" + HEADER
# cut before each header, and take off a line break that ends the text
_CUT = r"(?U)\n(?=" + HEADER + r")|\n\z"


def is_added(line: Column) -> Column:
    """``+`` but not ``+++``: an added line whose own text starts with ``++`` counts as context."""
    return line.startswith("+") & ~line.startswith("+++")


def is_deleted(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def is_meta(line: Column) -> Column:
    return line.startswith("\\")


def is_context(line: Column) -> Column:
    return ~is_added(line) & ~is_deleted(line) & ~is_meta(line)


def on_new_side(line: Column) -> Column:
    return ~is_deleted(line) & ~is_meta(line)


def on_old_side(line: Column) -> Column:
    return ~is_added(line) & ~is_meta(line)


def hunk_texts(patch: Column) -> Column:
    """The patch cut at its hunk headers; anything before the first header is dropped."""
    pieces = F.split(unix_lines(patch), _CUT)
    return F.coalesce(F.filter(pieces, lambda p: p.rlike(_AT_START)), F.array().cast("array<string>"))


def _header_part(hunk: Column, name: str) -> Column:
    def number(group: int) -> Column:
        return F.regexp_extract(hunk, _AT_START, group).try_cast("int")

    return {
        "old_start": lambda: number(1),
        "old_lines": lambda: F.coalesce(number(2), F.lit(1)),
        "new_start": lambda: number(3),
        "new_lines": lambda: F.coalesce(number(4), F.lit(1)),
        "header": lambda: strip(F.regexp_extract(hunk, _AT_START, 5)),
        "lines": lambda: F.split(hunk, "\n"),
    }[name]()


def hunk_structs(patch: Column, *parts: str) -> Column:
    """One struct per hunk with the named parts, so that a header is read once per hunk, not per line."""
    return F.transform(
        hunk_texts(patch), lambda h: F.struct(*[_header_part(h, name).alias(name) for name in parts])
    )


def _body(hunk: Column) -> Column:
    return F.slice(hunk["lines"], 2, F.size(hunk["lines"]))


def _numbers(hunk: Column, start: str, on_side, wanted) -> Column:
    """Line numbers of the wanted lines, counted over the lines of one side."""
    offsets = F.transform(F.filter(_body(hunk), on_side), lambda line, i: F.when(wanted(line), i))
    return F.transform(F.array_compact(offsets), lambda i: hunk[start] + i)


def with_line_lists(pr_files: DataFrame, patch: str = "patch") -> DataFrame:
    """Adds ``changed_lines`` (new-file numbers) and ``deleted_lines`` (old-file numbers) per file row."""
    lists = F.transform(
        hunk_structs(F.col(patch), "old_start", "new_start", "lines"),
        lambda h: F.struct(
            _numbers(h, "new_start", on_new_side, is_added).alias("changed"),
            _numbers(h, "old_start", on_old_side, is_deleted).alias("deleted")))
    return computed_once(pr_files, "line_lists", lists).withColumns({
        "changed_lines": F.flatten("line_lists.changed"),
        "deleted_lines": F.flatten("line_lists.deleted"),
    }).drop("line_lists")


def _hunks(pr_files: DataFrame, keys: list[str], patch: str, *parts: str) -> DataFrame:
    """One row per hunk, its parts as plain columns."""
    return pr_files.where(F.col(patch).isNotNull()).select(
        *keys, F.posexplode(hunk_structs(F.col(patch), *parts)).alias("hunk", "h")
    ).select(*keys, (F.col("hunk") + 1).alias("hunk"), *[F.col(f"h.{p}").alias(p) for p in parts])


def diff_hunks(pr_files: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """One row per hunk: header numbers, header text, raw lines (header first), added line numbers."""
    parts = ["old_start", "old_lines", "new_start", "new_lines", "header", "lines"]
    numbers = _numbers(F.struct("new_start", "lines"), "new_start", on_new_side, is_added)
    return _hunks(pr_files, keys, patch, *parts).withColumn("modified_new_lines", numbers)


def diff_lines(pr_files: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """Every line of every hunk: ``hunk``, ``pos`` in the hunk (0 is the header), kind, both numbers, text."""

    def row(kind: str, r: Column, old_off: Column | None, new_off: Column | None) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(
            r["pos"].alias("pos"), F.lit(kind).alias("kind"), r["line"].alias("line"),
            (none if old_off is None else old_off).alias("old_off"),
            (none if new_off is None else new_off).alias("new_off"),
        )

    def side(lines: Column, on_side) -> Column:
        kept = F.filter(lines, lambda r: (r["pos"] > 0) & on_side(r["line"]))
        return F.transform(kept, lambda r, i: F.struct(r["pos"].alias("pos"), r["line"].alias("line"), i.alias("off")))

    def pick(rows: Column, wanted) -> Column:
        return F.filter(rows, lambda r: wanted(r["line"]))

    hunks = _hunks(pr_files, keys, patch, "old_start", "new_start", "lines")
    numbered = F.transform(F.col("lines"), lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    hunks = computed_once(hunks, "numbered", numbered)
    hunks = computed_once(hunks, "sides", F.struct(
        side(F.col("numbered"), on_new_side).alias("new"), side(F.col("numbered"), on_old_side).alias("old")))
    lines, new, old = F.col("numbered"), F.col("sides.new"), F.col("sides.old")
    pieces = F.concat(
        F.transform(F.filter(lines, lambda r: r["pos"] == 0), lambda r: row("hdr", r, None, None)),
        F.transform(pick(new, is_added), lambda r: row("add", r, None, r["off"])),
        F.transform(pick(old, is_deleted), lambda r: row("del", r, r["off"], None)),
        F.zip_with(pick(new, is_context), pick(old, is_context), lambda n, o: row("ctx", n, o["off"], n["off"])),
        F.transform(F.filter(lines, lambda r: (r["pos"] > 0) & is_meta(r["line"])), lambda r: row("meta", r, None, None)),
    )
    return hunks.select(
        *keys, "hunk", "old_start", "new_start", F.inline(pieces),
    ).select(
        *keys, "hunk", "pos", "kind",
        (F.col("old_start") + F.col("old_off")).alias("old_line"),
        (F.col("new_start") + F.col("new_off")).alias("new_line"),
        "line",
    )


def _new_side(pr_files: DataFrame, keys: list[str], patch: str) -> DataFrame:
    body = F.slice("lines", 2, F.size("lines"))
    return _hunks(pr_files, keys, patch, "new_start", "lines").select(
        *keys, "new_start", F.posexplode(F.filter(body, on_new_side)).alias("off", "raw"),
    ).withColumn("line", F.col("new_start") + F.col("off"))


def changed_lines(pr_files: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """Added lines only: keys, new-file ``line`` number, ``text`` without the ``+``."""
    return _new_side(pr_files, keys, patch).where(is_added(F.col("raw"))).select(
        *keys, "line", F.expr("substring(raw, 2)").alias("text")
    )


def new_side_lines(pr_files: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """Numbers of the lines a comment may sit on: added and context lines of the new side."""
    return _new_side(pr_files, keys, patch).select(*keys, "line")


def new_side_ranges(pr_files: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """The same places as one range per hunk, ``start_line`` to ``end_line``: new-side lines of a hunk are numbered without gaps, so
    they are only counted. A hunk without such lines has no range."""
    body = F.slice("lines", 2, F.size("lines"))
    return _hunks(pr_files, keys, patch, "new_start", "lines").select(
        *keys, F.col("new_start").alias("start_line"), F.size(F.filter(body, on_new_side)).alias("n_lines"),
    ).where("n_lines > 0 AND start_line IS NOT NULL").select(
        *keys, "start_line", (F.col("start_line") + F.col("n_lines") - 1).alias("end_line"))
