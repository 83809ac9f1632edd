"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary yields, for each place of a text, the pieces that end there. Dynamic
programming carries the best score and the number of tokens of the best way to that place; no tokens are made.

Tie rules are those of the public unigram tokenizers: places are extended from left to right, a longer way replaces a
shorter one only by a strictly better score, so of equal scores the piece that begins first wins; a character that is
no piece may be unknown, at the vocabulary's least score less 10, considered after all pieces that begin there; unknown
characters next to each other are one token, or one token a UTF-8 byte where the vocabulary has all byte pieces.

Blanks become ``▁`` and a text that does not begin with one gets one in front. No piece holds ``▁`` after another
character (where one does, texts are searched whole), so a text falls into segments at the ``▁`` and its best way is
the best ways of its segments. Segments repeat, and a task keeps the counts of those it has met, in bounded memory.

The vocabulary comes with each piece's score as a model file has it; control, unknown and byte pieces match no text.
Defined results: null and empty texts have no tokens; other columns pass through; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments whose counts a task keeps, and the longest one kept: bound its memory, change no result.
KEPT, KEPT_CHARS = 400_000, 48
#: Characters of all pieces: the automaton of a task takes about 60 bytes each.
VOCABULARY_CHARS = 5_000_000


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]
    least: float
    bytes_known: bool


def load(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in plain], min(model.get_score(i) for i in ids),
                      sum(model.is_byte(i) for i in ids) == 256)


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.least - UNKNOWN_PENALTY
        self.bytes_known = vocabulary.bytes_known
        crossing = re.compile(f"[^{BLANK}]{BLANK}")
        self.whole = BLANK not in self.single or any(crossing.search(p) for p, _ in vocabulary.pieces)
        self.segments = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.kept: dict[str, int] = {}

    def best(self, segment: str) -> int:
        n = len(segment)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(segment) if len(self.automaton) else ():
            ending[end].append(piece)
        scores, counts, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top, start_at = None, -1
            for length, score in sorted(ending[end], reverse=True) if len(ending[end]) > 1 else ending[end]:
                total = score + scores[end + 1 - length]
                if top is None or total > top:
                    top, start_at = total, end + 1 - length
            c = segment[end]
            if c not in self.single:
                total = self.unknown + scores[end]
                if top is None or total > top:
                    scores[end + 1], unknown[end + 1] = total, True
                    counts[end + 1] = counts[end] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes_known else int(not unknown[end]))
                    continue
            scores[end + 1], counts[end + 1] = top, counts[start_at] + 1
        return counts[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        if text[0] != BLANK:
            text = BLANK + text
        if self.whole:
            return self.best(text)
        total, kept = 0, self.kept
        for segment in self.segments.findall(text):
            found = kept.get(segment)
            if found is None:
                found = self.best(segment)
                if len(segment) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[segment] = found
            total += found
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in ``column`` (a column of that name is replaced)."""
    size = sum(len(p) for p, _ in vocabulary.pieces)
    if size > VOCABULARY_CHARS:
        raise ValueError(f"the vocabulary has {size} characters; a task's automaton takes at most {VOCABULARY_CHARS}")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    keep = docs.drop(column)
    names = [f"c{i}" for i in range(len(keep.columns))]
    at = keep.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            found = [counter.count(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, "n"])

    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, keep.dtypes))
    return keep.toDF(*names).mapInArrow(run, f"{schema}, n long").toDF(*keep.columns, column)


def token_totals(counted: DataFrame, by: str, column: str = "n_tokens") -> DataFrame:
    """(by, documents, tokens): totals of a counted table."""
    return counted.groupBy(by).agg(F.count("*").alias("documents"), F.sum(column).alias("tokens"))
