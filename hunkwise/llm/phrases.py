"""Phrase collocations by stripes.

A stripe belongs to a prefix of 0 to 3 words and counts the words that follow it inside a piece; the stripe of the empty prefix
counts the words. Its cells are the extensions, the cell of the prefix itself (in the next shorter stripe) is its total, and the
largest cell says how far an extension subsumes the prefix. Tasks build stripes of their texts (words as numbers, so counts are exact)
and the tables hold them cell by cell, (lang, prefix, next, count): merging stripes elementwise is a sum with map-side combining, and
the stripe of a very common prefix lies in many tasks instead of one.

Most phrases are rare, so their cells are never made. Passes with phrases of 1, 2, 3 and 4 words count 64-bit hashes first: a hash that
occurs fewer than LEAST times has no phrase that does. What is left goes into a Bloom filter, and a pass only counts phrases whose two
shorter ones are in the filter before. The last pass makes the stripes of the phrases that the filters let through and counts them
exactly, by their words; a phrase let through wrongly is dropped then. A filter is sized by its hashes, up to FILTER_BITS (32 MB; with
four of them all that is ever broadcast); a full filter costs time, never results. Long texts are cut between pieces.

Counts of parts: a candidate asks for the counts of its first and last words at each cut. Parts asked for by very many candidates (the
most asked HOT_PARTS, pre-aggregated) are answered by a broadcast of that many rows, the others by a join on the part.

Defined results: null text is empty, null lang is ``und`` and counts with it. Texts without words give nothing. Repeated rows count
each. Other columns, whatever their names, are not read. Ties are broken by count and phrase, so the ranks are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.llm.common import Staged
from hunkwise.llm.shingles import _tables as power_tables
from hunkwise.llm.shingles import mix

LONGEST, LEAST, TOP = 4, 30, 2000
#: In hundredths: the share of a candidate's count from which a longer one subsumes it.
SUBSUMED = 80
#: Fixed value: a score is floor(SCALE * a / (l + r)).
SCALE = 2_000_000
UNKNOWN = "und"
CHUNK_BYTES = 2 << 20
FILTER_BITS, BITS_A_HASH, PROBES = 1 << 28, 12, 4
HOT_PARTS = 1_000
#: Parts that a language's candidates are cut to TOP in before they meet: the last ranking has that many times TOP rows a language.
RANK_PARTS = 64

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_VALUES = mix(np.arange(256, dtype=np.uint64))


def _portions(langs: list[str], texts: list[bytes | None]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Texts in portions of about CHUNK_BYTES; a longer one is cut behind a piece."""
    size, names, parts = 0, [], []
    for lang, text in zip(langs, texts):
        at, text = 0, text or b""
        while at < len(text):
            end = min(len(text), at + CHUNK_BYTES)
            while end < len(text) and _CLASS[text[end - 1]] != _BREAK:
                end += 1
            names.append(lang)
            parts.append(text[at:end])
            size, at = size + end - at, end
            if size >= CHUNK_BYTES:
                yield names, parts
                size, names, parts = 0, [], []
    if parts:
        yield names, parts


class Portion:
    """The words of a portion: ``lang`` (a number a word), ``joined`` (whether the next word stands in the same piece), hashes, and, when
    asked for, ``words`` (distinct) and ``ids`` (a number a word)."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        self.kind = _CLASS[self.data]
        solid = np.concatenate(([False], self.kind == _WORD, [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.first, self.last = first, _ = edges[::2], edges[1::2]
        breaks = np.searchsorted(np.flatnonzero(self.kind == _BREAK), first)
        self.joined = np.append(breaks[1:] == breaks[:-1], False)[: len(first)]
        lang, self.langs = pd.factorize(np.array(langs, dtype=object))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.lang = lang[np.searchsorted(begins, first, "right") - 1].astype(np.int64)

    def __len__(self) -> int:
        return len(self.first)

    @cached_property
    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum(self.last - self.first))).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.kind == _WORD])]).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        up, down = power_tables(len(self.data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[self.data] * up[: len(self.data)], dtype=np.uint64)))
        return mix((sums[self.last] - sums[self.first]) * down[self.first] + (self.last - self.first).astype(np.uint64))

    def hashes(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, with the language."""
        n = max(0, len(self) - k + 1)
        out = mix(np.array([xxhash.xxh64_intdigest(name) for name in self.langs], np.uint64))[self.lang[:n]]
        for i in range(k):
            out = mix(out * _STEP + self.word_hashes[i : n + i])
        return out

    def phrases(self, k: int) -> np.ndarray:
        """Whether the k words from each word on stand in one piece."""
        n = max(0, len(self) - k + 1)
        out = np.ones(n, bool)
        for i in range(k - 1):
            out &= self.joined[i : n + i]
        return out


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def held(hashes: np.ndarray, filter_words: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in _probes(hashes, len(filter_words) * 64):
        out &= (filter_words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def hash_filter(found: DataFrame) -> np.ndarray:
    """The Bloom filter of the staged hashes ``found`` (hash) as 64-bit words."""
    wanted, bits = found.count() * BITS_A_HASH, 1 << 10
    while bits < min(wanted, FILTER_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(list(_probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            places, which = np.unique(at >> 6, return_inverse=True)
            set_bits = np.zeros(len(places), np.uint64)
            np.bitwise_or.at(set_bits, which, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(set_bits.view(np.int64))], names=["place", "bits"])

    cells = found.select("hash").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column("place").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Portion]:
    for batch in batches:
        for langs, texts in _portions(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            yield Portion(langs, texts)


def hash_counts(texts: DataFrame, k: int, shorter: Broadcast | None) -> DataFrame:
    """(hash, n): occurrences of the hashes of phrases of ``k`` words whose first and last k - 1 words are in ``shorter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _read(batches):
            open_ = portion.phrases(k)
            if k > 1:
                known = held(portion.hashes(k - 1), shorter.value)
                open_ &= known[:-1] & known[1:] if len(open_) else open_
            found, counts = np.unique(portion.hashes(k)[open_], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each key, and per distinct key its first place and its count."""
    codes, values = pd.factorize(keys)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(keys))[::-1]
    return codes.astype(np.int64), first, np.bincount(codes, minlength=len(values))


def stripes(portion: Portion, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length the place of each distinct phrase that the filters let through, and its count."""
    words, ids = portion.numbered
    size, pairs, n_pairs, let = len(words), np.zeros(len(portion), np.int64), 0, np.zeros(0, bool)
    for k, bits in enumerate(filters, 1):
        here = portion.phrases(k) & held(portion.hashes(k), bits)
        if k > 1:
            here &= let[:-1] & let[1:] if len(here) else here
        let, at = here, np.flatnonzero(here)
        # numbers of shorter phrases make the keys, so that a key is one phrase
        if k == 1:
            keys = portion.lang[at] * size + ids[at]
        elif k == 2:
            keys = (portion.lang[at] * size + ids[at]) * size + ids[at + 1]
        else:
            keys = pairs[at] * max(size, n_pairs) + (ids if k == 3 else pairs)[at + 2]
        codes, first, counts = _distinct(keys)
        if k == 2:
            pairs[at], n_pairs = codes, len(counts)
        yield k, at[first], counts


def merged_stripes(texts: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """Cells (lang, k, prefix, next, a) of the stripes with prefixes of k - 1 words, as far as the filters let them through, and for each
    language one row of k = 0 with the number of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _read(batches):
            names = np.asarray(portion.langs, dtype=object)
            size = np.bincount(portion.lang, minlength=len(names))
            none = pa.array([""] * len(names), pa.string())
            yield _cell_batch(pa.array(names, pa.string()), 0, none, none, size)
            words, ids = portion.numbered
            for k, at, counts in stripes(portion, [f.value for f in filters]):
                found = [words.take(pa.array(ids[at + i])).cast(pa.string()) for i in range(k)]
                prefix = pc.binary_join_element_wise(*found[:-1], " ") if k > 1 else pa.array([""] * len(at), pa.string())
                yield _cell_batch(pa.array(names[portion.lang[at]], pa.string()), k, prefix, found[-1], counts)

    cells = texts.mapInArrow(run, "lang string, k int, prefix string, next string, n long")
    return cells.groupBy("lang", "k", "prefix", "next").agg(F.sum("n").alias("a"))


def _cell_batch(lang: pa.Array, k: int, prefix: pa.Array, following: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(counts), k, np.int32)), prefix, following, pa.array(counts, pa.int64())],
                                      names=["lang", "k", "prefix", "next", "n"])


def _joined(words: Column, first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def _with_counts(asked: DataFrame, counts: DataFrame, staged: Staged) -> DataFrame:
    """``asked`` (lang, part, ...) with ``f``, the part's count: every part asked for has one."""
    most = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "part").limit(HOT_PARTS)
    hot = F.broadcast(staged.put(most.select("lang", "part").join(counts, ["lang", "part"]), "hot-parts"))
    return asked.join(hot, ["lang", "part"]).unionByName(asked.join(hot, ["lang", "part"], "left_anti").join(counts, ["lang", "part"]))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SUBSUMED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to 4 words that occur ``least`` times or more."""
    staged, context = Staged(docs.sparkSession), docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text IS NOT NULL")
    filters: list[Broadcast] = []
    for k in range(1, LONGEST + 1):
        often = staged.put(hash_counts(texts, k, filters[-1] if filters else None).where(F.col("n") >= least).select("hash"), "often")
        filters.append(context.broadcast(hash_filter(often)))
        staged.drop(often)
    cells = staged.put(merged_stripes(texts, filters).where((F.col("a") >= least) | (F.col("k") == 0)), "stripes")
    for bits in filters:
        bits.destroy()

    totals = cells.where("k = 0").select(F.col("lang").alias("of"), F.col("a").alias("n"))
    found = cells.where("k > 0").select("lang", "k", "prefix", F.when(F.col("k") == 1, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "a")
    counts = found.where(F.col("k") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    candidates = found.where("k > 1").select("lang", "phrase", "a")
    split = F.split("phrase", " ")
    cut = candidates.withColumn("words", split).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("first"), _joined(F.col("words"), F.lit(1), F.col("cut")).alias("part")),
                              F.struct(F.lit(False).alias("first"), _joined(F.col("words"), F.col("cut") + 1, F.size("words")).alias("part"))))
    asked = cut.withColumn("side", sides).select("lang", "side.part", "phrase", "a", "cut", F.col("side.first").alias("first"))
    answered = _with_counts(asked, counts, staged)
    parts = answered.groupBy("lang", "phrase", "a").agg(*[
        F.max(F.when((F.col("cut") == c) & (F.col("first") == side), F.col("f"))).alias(f"{name}{c}") for c in range(1, LONGEST) for side, name in ((True, "l"), (False, "r"))])

    def at_cut(c: int) -> Column:
        score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div CAST(l{c} + r{c} AS DECIMAL(19,0))")
        return F.when(F.col(f"l{c}").isNotNull(), F.struct(score.alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))

    scored = parts.withColumn("worst", F.array_min(F.array(*map(at_cut, range(1, LONGEST)))))
    # the largest cell on either side: a longer phrase around a candidate never occurs more often than the one-word extension in it
    longer = found.where("k > 2").select("lang", "a", F.explode(F.array("prefix", F.expr("substring(phrase, locate(' ', phrase) + 1)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(most, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share))
    order = [F.desc("worst.score"), F.desc("a"), "phrase"]
    ahead = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)))
    ranked = ahead.where(F.col("place") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
