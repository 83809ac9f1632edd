"""A learned index from a token's rank to its offset: lines fitted to the boundary offsets, with every rest stored.

The boundaries of a text are 0 and the end of each token. A segment is a run of neighbouring ranks on the line through its first and
last boundary, and is accepted when no boundary is further than ERROR from its line (rounded down); otherwise it is halved. What
the line misses is kept as one signed byte a boundary. A look-up finds the segment of a rank by binary search, takes the line's
value, and adds the stored rest: exact for every rank. Texts of a batch are fitted side by side; a segment never spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.shingles import chunks

#: The most a boundary may lie off its line: a rest fits in one signed byte.
ERROR = 127

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Boundaries:
    """All boundaries of several texts in one row: text t has those from ``first[t]`` to ``first[t + 1]``."""

    offsets: np.ndarray
    first: np.ndarray

    @property
    def tokens(self) -> np.ndarray:
        return np.diff(self.first) - 1


def boundaries(texts: list[bytes | None]) -> Boundaries:
    """Byte offsets of the ends of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, each text's with a 0 before them."""
    data = [t or b"" for t in texts]
    begins = np.cumsum([0] + [len(t) for t in data])
    space = _IS_SPACE[np.frombuffer(b"".join(data), np.uint8)]
    last = np.zeros(len(space) + 1, bool)
    last[begins] = True  # a text ends before the byte that begins the next
    ends = np.flatnonzero(last[1:] | (~space & np.append(space[1:], True))) + 1
    until = np.searchsorted(ends, begins, "right")  # tokens that end at or before a text's begin
    first = until + np.arange(len(begins))
    offsets = np.zeros(len(ends) + len(data), np.int64)
    owner = np.repeat(np.arange(len(data)), np.diff(until))
    offsets[np.arange(len(ends)) + owner + 1] = ends - begins[owner]
    return Boundaries(offsets, first)


@dataclass
class RankIndex:
    """Segments by their first place (rank counted over all texts of the batch), and the rests of all boundaries."""

    start: np.ndarray
    base: np.ndarray
    rise: np.ndarray
    run: np.ndarray
    rest: np.ndarray

    def offset(self, at: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.start, at, "right") - 1
        return self.base[segment] + (at - self.start[segment]) * self.rise[segment] // self.run[segment] + self.rest[at]


def fit(found: Boundaries) -> RankIndex:
    offsets = found.offsets
    rest = np.zeros(len(offsets), np.int8)
    done: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    left, right = found.first[:-1].astype(np.int64), found.first[1:].astype(np.int64) - 1  # open segments, both ends included
    while len(left):
        size = right - left + 1
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        at = np.repeat(left, size) + step
        rise, run = offsets[right] - offsets[left], np.maximum(right - left, 1)
        missed = offsets[at] - np.repeat(offsets[left], size) - step * np.repeat(rise, size) // np.repeat(run, size)
        fits = np.maximum.reduceat(np.abs(missed), begin) <= ERROR
        inside = np.repeat(fits, size)
        rest[at[inside]] = missed[inside]
        done.append(np.column_stack((left[fits], right[fits])))
        left, right = left[~fits], right[~fits]
        middle = (left + right) // 2
        left, right = np.concatenate((left, middle + 1)), np.concatenate((middle, right))
    ends = np.concatenate(done)
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    start, stop = ends[:, 0], ends[:, 1]
    return RankIndex(start, offsets[start], offsets[stop] - offsets[start], np.maximum(stop - start, 1), rest)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
        for at, part in chunks(texts):
            found = boundaries(part)
            index = fit(found)
            of = np.searchsorted(index.start, found.first)
            pieces = [index.start - np.repeat(found.first[:-1], np.diff(of)), index.base, index.rise, index.run]
            lists = [pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(p, pa.int64())) for p in pieces]
            rests = [index.rest[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(found.tokens, pa.int64()), *lists, pa.array(rests, pa.binary())],
                                             names=["doc_id", "n", "start", "base", "rise", "run", "rest"])


def index_table(docs: DataFrame) -> DataFrame:
    """The index of every text as a row to be stored: doc_id, n (tokens), the segments (start rank, base offset, rise, run) as arrays
    and the rests as bytes. Null and empty texts have one boundary, 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_index_batches, "doc_id long, n long, start array<long>, base array<long>, rise array<long>, run array<long>, rest binary")


def stored_offset(row: dict, rank: int) -> int:
    """The byte offset of boundary ``rank`` by one row of :func:`index_table`."""
    index = RankIndex(*(np.array(row[c], np.int64) for c in ("start", "base", "rise", "run")), np.frombuffer(row["rest"], np.int8))
    return int(index.offset(np.array([rank]))[0])
