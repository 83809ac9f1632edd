"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

Items and texts are normalised alike: A-Z lower-cased, everything but digits, letters and non-ASCII characters a
separator, one blank between words. A window is 13 consecutive words of an item; an item of fewer words, but not none, is
one window. The automaton holds every distinct window between blanks, so a match is a match of whole words, and its end
tells by the blanks before it which words it covers. Word places map back to code points of the original text.

The windows are measured before they are sent to the tasks. Up to ``SHARD_CHARS`` they are one automaton; larger
benchmarks are cut into that many more, and each further one scans what the scan before it has written, so neither the
driver nor a task ever holds more than one shard.

Defined results: null, empty and wordless texts have no words and are clean; null, empty and wordless items have no
windows; items that share an item_id are one item; a null item_id counts as the empty string. A text is contaminated if
it has hit words and they are at least a twentieth of its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import Staged

WINDOW = 13
#: Contaminated: SHARE * n_hit >= n_words.
SHARE = 20
#: Characters of windows and item ids in one automaton: about 200 MB in a task.
SHARD_CHARS = 3_000_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_HIT = "hit_items array<string>, hit_places array<int>"


def _joined(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_FOLD).split())


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
        rows = []
        for item, text in zip(items, texts):
            words = _joined(text).split()
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                part = words[i : i + WINDOW]
                rows.append((b" ".join(part).decode("latin-1"), len(part), item))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["pattern", "n", "item"])


def windows(benchmark: DataFrame) -> DataFrame:
    """(pattern, n words, item) for each distinct window of each item; a pattern has one character a byte."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(_window_batches, "pattern string, n int, item string").distinct()


def _scan(rows: list, columns: list[str], text_at: int) -> Callable:
    """A scan of Arrow batches with the windows of one shard; adds to the hits that the batch brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = ahocorasick.Automaton(), {}
        for pattern, n, item in rows.value:
            items.setdefault((pattern, n), []).append(item)
        for (pattern, n), whose in items.items():
            automaton.add_word(f" {pattern} ", (n, whose))
        if items:
            automaton.make_automaton()
        for batch in batches:
            texts = batch.column(text_at).cast(pa.large_binary()).to_pylist()
            found_items = batch.column(len(columns)).to_pylist()
            found_places = batch.column(len(columns) + 1).to_pylist()
            n_words = []
            for k, text in enumerate(texts):
                joined = b" " + _joined(text) + b" "
                n_words.append(joined.count(b" ") - 1 if len(joined) > 2 else 0)
                hits = list(automaton.iter(joined.decode("latin-1"))) if items and n_words[-1] else []
                if not hits:
                    continue
                blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                ends = np.searchsorted(blanks, [end for end, _ in hits])
                step = np.zeros(n_words[-1] + 1, np.int64)
                np.add.at(step, ends - [n for _, (n, _) in hits], 1)
                np.add.at(step, ends, -1)
                places = set(np.flatnonzero(np.cumsum(step)[:-1] > 0).tolist()) | set(found_places[k] or [])
                whose = {i for _, (_, names) in hits for i in names} | set(found_items[k] or [])
                found_items[k], found_places[k] = sorted(whose), sorted(places)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(found_items, pa.list_(pa.string())), pa.array(found_places, pa.list_(pa.int32())),
                 pa.array(n_words, pa.int64())], names=[*columns, "hit_items", "hit_places", "n_words_found"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as a column ``doc`` (all its columns, so that no name clashes) with n_words, n_hit, item_ids (sorted, as
    strings) and places (the hit words, from 0)."""
    spark = docs.sparkSession
    staged = Staged(spark)
    found = staged.put(windows(benchmark), "windows")
    chars = found.agg(F.sum(F.length("pattern") + F.length("item") + 2)).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    inner = [f"c{i}" for i in range(len(docs.columns))]
    names = docs.columns
    state = docs.toDF(*inner)
    at = names.index(text)
    schema = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(inner, docs.dtypes))
    state = state.withColumns({"hit_items": F.lit(None).cast("array<string>"), "hit_places": F.lit(None).cast("array<int>")})
    for shard in range(shards):
        part = found if shards == 1 else found.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard)
        rows = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        state = state.mapInArrow(_scan(rows, inner, at), f"{schema}, {_HIT}, n_words_found long")
        if shard + 1 < shards:
            state = staged.put(state, "scan").drop("n_words_found")
    places = F.coalesce("hit_places", F.array().cast("array<int>"))
    return state.select(
        F.struct(*(F.col(c).alias(n) for c, n in zip(inner, names))).alias("doc"), F.col("n_words_found").alias("n_words"),
        F.size(places).cast("long").alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("item_ids"), places.alias("places"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were."""
    return scan(docs, benchmark).where(~contaminated()).select("doc.*")


def spans(found: DataFrame) -> DataFrame:
    """``scan``'s rows with ``spans``: the runs of hit words as code points of the original text (end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hit, here = set(places), []
                for i, m in enumerate(_TOKEN.finditer(text or "")) if hit else ():
                    if i in hit:
                        if i - 1 in hit:
                            here[-1]["end"] = m.end()
                        else:
                            here.append({"start": m.start(), "end": m.end()})
                out.append(here)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                                             names=["doc_id", "n_hit", "spans"])

    rows = found.select("doc.text", "places", F.col("doc.doc_id").cast("long").alias("doc_id"), "n_hit")
    return rows.mapInArrow(run, "doc_id long, n_hit long, spans array<struct<start:int,end:int>>")
