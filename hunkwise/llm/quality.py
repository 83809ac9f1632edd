"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are shares and sizes of its own characters and words and
those of the lines before and after it; the chain's transitions carry a line's label to its neighbours. Forward-backward
gives each line's probability of being good, and a text's score is the mean of these, weighted by the lines' lengths.

Training takes the labelled documents that are not held out (crc32 of the doc_id as text, modulo 5, is not 0), at most
``TRAIN_DOCS`` of them in the order of a hash of their id: each gives its label to all of its lines. That bound is the
only sample; every text is scored, and scores never see labels, lang, source or doc_id.

Defined results: a text without words (null, empty) scores the share of good documents in the training sample, 1 without
labels. Rows with null doc_id or null quality teach nothing; a null doc_id is not held out. Without both labels in the
sample, every score is that share. Lines without words weigh nothing but keep their place in the chain's text order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.shingles import chunks, mix, word_hashes

TRAIN_DOCS = 4_000
FOLDS = 5
THRESHOLD = 0.3

_LETTER_LOW, _LETTER_UP, _DIGIT, _COMMON, _MARK, _HIGH, _BANG, _TERMINAL = range(8)


def _classes() -> np.ndarray:
    """One bit a class of bytes."""
    out = np.zeros(256, np.uint8)
    out[97:123] |= 1 << _LETTER_LOW
    out[65:91] |= 1 << _LETTER_UP
    out[48:58] |= 1 << _DIGIT
    for c in b".,;:'\"?-()":
        out[c] |= 1 << _COMMON
    for c in b"#$%&*|<>{}[]\\/=+~^_@`":
        out[c] |= 1 << _MARK
    out[128:] |= 1 << _HIGH
    out[33] |= 1 << _BANG
    for c in b".?!:":
        out[c] |= 1 << _TERMINAL
    return out


_CLASSES = _classes()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, text number) of every line with words, in order."""
    data = b"\n".join(texts) + b"\n"
    codes = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, starts, side="right")
    words, begins = word_hashes(data)
    word_line = np.searchsorted(ends, begins)
    n_words = np.bincount(word_line, minlength=len(starts))
    keep = n_words > 0
    size = np.maximum(ends - starts, 1).astype(float)
    count = np.maximum(n_words, 1).astype(float)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends] - total[starts]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(word_line, weights=flags, minlength=len(starts)) / count

    bits = _CLASSES[codes]
    low, up, digit, common, mark, high, bang = (per_line((bits >> k) & 1) for k in range(7))
    repeated = per_line(np.concatenate(([False], (codes[1:] == codes[:-1]) & ((bits[1:] & 0b0011_0000) == 0b0001_0000)))
                        | np.concatenate(([False], (codes[1:] == codes[:-1]) & ((bits[1:] >> _BANG) & 1 > 0))))
    space = _SPACE[codes]
    word_ends = np.flatnonzero(~space[:-1] & space[1:]) if len(codes) else np.zeros(0, int)
    word_size = word_ends - begins + 1
    last = bits[word_ends]
    plain_end = (last & ((1 << _LETTER_LOW) | (1 << _LETTER_UP) | (1 << _DIGIT) | (1 << _COMMON) | (1 << _HIGH))) > 0
    alnum = np.concatenate(([0], np.cumsum((bits & ((1 << _LETTER_LOW) | (1 << _LETTER_UP) | (1 << _DIGIT) | (1 << _HIGH))) > 0)))
    empty_word = (alnum[word_ends + 1] - alnum[begins]) == 0
    again = np.concatenate(([False], words[1:] == words[:-1])) if len(words) else np.zeros(0, bool)
    # words, and pairs of neighbouring words, that their text has had before
    of_text = owner[word_line].astype(np.uint64)
    pairs = mix(words ^ mix(np.concatenate((words[1:], np.zeros(1, np.uint64)))[: len(words)]))

    def seen(keys: np.ndarray) -> np.ndarray:
        keyed = mix(keys ^ mix(of_text))
        first = np.zeros(len(keyed), bool)
        first[np.unique(keyed, return_index=True)[1]] = True
        return ~first

    word_seen, pair_seen = per_word(seen(words)), per_word(seen(pairs))
    letters = np.maximum(low + up, 1)
    terminal = np.zeros(len(starts))
    final = np.maximum(ends - 1, 0)
    terminal[:] = (bits[final] >> _TERMINAL) & 1
    shares = [up / letters, digit / size, common / size, mark / size, high / size, bang / size, repeated / size, per_word(~plain_end),
              per_word(empty_word), per_word(again), word_seen, pair_seen, per_word(word_size <= 3)]
    sizes = [np.log1p(size), np.log1p(count), np.bincount(word_line, weights=word_size, minlength=len(starts)) / count / 10, terminal]
    own = np.column_stack(shares + [np.sqrt(x) for x in shares] + sizes)[keep]
    owner = owner[keep]
    same = owner[1:] == owner[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    edge = np.column_stack((np.concatenate(([1.0], ~same)), np.concatenate((~same, [1.0])))) if len(own) else np.zeros((0, 2))
    return np.hstack((own, before, after, edge, np.ones((len(own), 1)))), size[keep], owner


def marginals(scores: np.ndarray, owner: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2, summed), log of the partition functions' product.

    ``scores``: a good line's score, a bad line has 0; ``change``: the score of each pair of neighbouring labels. Lines of
    one text are neighbours; step i handles the i-th line of all texts that have one."""
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    lengths = np.diff(np.concatenate((starts, [n])))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    here = np.column_stack((np.zeros(n), scores))
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    active = [int(np.searchsorted(-lengths, -step, side="left")) for step in range(lengths[0])]
    ahead[starts] = here[starts]
    for step in range(1, lengths[0]):
        at = starts[: active[step]] + step
        ahead[at] = np.logaddexp(ahead[at - 1][:, [0]] + change[0], ahead[at - 1][:, [1]] + change[1]) + here[at]
    total = np.logaddexp(*ahead[starts + lengths - 1].T)
    for step in range(lengths[0] - 2, -1, -1):
        at = starts[: active[step + 1]] + step
        onward = here[at + 1] + back[at + 1]
        back[at] = np.logaddexp(onward[:, [0]] + change[:, 0], onward[:, [1]] + change[:, 1])
    norm = np.zeros(n)
    norm[np.concatenate([s + np.arange(k) for s, k in zip(starts, lengths)])] = np.repeat(total, lengths)
    good = np.exp(np.minimum(ahead[:, 1] + back[:, 1] - norm, 0))
    inner = np.flatnonzero(np.concatenate((owner[1:] == owner[:-1], [False])))
    joint = ahead[inner][:, :, None] + change[None] + (here[inner + 1] + back[inner + 1])[:, None, :] - norm[inner][:, None, None]
    return good, np.exp(np.minimum(joint, 0)).sum(axis=0), float(total.sum())


def _minimise(value, start: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; ``value`` gives a convex function's value and slope."""
    at, (best, slope), past = start, value(start), []
    for _ in range(rounds):
        way, alphas = -slope, []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ way))
            way = way - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            way = way * (s @ y) / (y @ y)
        else:
            way = way / max(1.0, np.linalg.norm(way))
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            way = way + s * (alpha - rho * (y @ way))
        step, downhill = 1.0, slope @ way
        for _ in range(30):
            new, new_slope = value(at + step * way)
            if new <= best + 1e-4 * step * downhill:
                break
            step /= 2
        else:
            break
        moved, turned = step * way, new_slope - slope
        at, gain, best, slope = at + moved, best - new, new, new_slope
        if moved @ turned > 1e-12:
            past = [*past, (moved, turned, 1 / (moved @ turned))][-memory:]
        if gain < 1e-7:
            break
    return at


def fit(features: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = 120, ridge: float = 1e-4, ridge_change: float = 2e-3) -> dict:
    """Weights of the chain by penalised maximum likelihood; ``labels``: 0 or 1 a line."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread == 0] = 1
    mean[-1], spread[-1] = 0, 1
    x = np.clip((features - mean) / spread, -8, 8)
    n, width = x.shape
    same = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][same], labels[1:][same]), 1)
    wanted = x.T @ labels

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        weights, change = at[:width], at[width:].reshape(2, 2)
        good, pairs, total = marginals(x @ weights, owner, change)
        loss = (total - weights @ wanted - (change * seen).sum()) / n + ridge * weights @ weights / 2 + ridge_change * (change * change).sum() / 2
        return loss, np.concatenate(((x.T @ good - wanted) / n + ridge * weights, ((pairs - seen) / n + ridge_change * change).ravel()))

    at = _minimise(value, np.zeros(width + 4), rounds)
    return {"mean": mean, "spread": spread, "weights": at[:width], "change": at[width:].reshape(2, 2)}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
        labels = batch.column(1).to_pylist()
        order = batch.column(2).to_pylist()
        for at, part in chunks(texts):
            x, _, owner = line_features(part)
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(order[at : at + len(part)], pa.int64()), pa.array(labels[at : at + len(part)], pa.int32()),
                pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["place", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> dict | None:
    """The model: at most ``limit`` labelled documents send their line features (not their texts) to the driver."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (known.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
              .withColumn("place", F.xxhash64("id")).orderBy("place", "id", "label").limit(limit))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id")
    rows = texts.select("text", "label", "place").mapInArrow(_feature_batches, "place long, label int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["place"], r["label"], bytes(r["x"])))
    share = float(np.mean([r["label"] for r in rows])) if rows else 1.0
    width = line_features([b"a"])[0].shape[1]
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in rows]
    counts = [len(p) for p in parts]
    if 0 < share < 1 and sum(counts):
        model = fit(np.vstack(parts).astype(float), np.repeat(np.arange(len(parts)), counts), np.repeat([r["label"] for r in rows], counts))
    else:
        model = {}
    return model | {"share": share}


def document_scores(texts: list[bytes | None], model: dict) -> np.ndarray:
    out = np.full(len(texts), model["share"])
    if "weights" not in model:
        return out
    for at, part in chunks(texts):
        x, size, owner = line_features([t or b"" for t in part])
        good, _, _ = marginals(np.clip((x - model["mean"]) / model["spread"], -8, 8) @ model["weights"], owner, model["change"])
        weight = np.bincount(owner, weights=size, minlength=len(part))
        total = np.bincount(owner, weights=size * good, minlength=len(part))
        some = weight > 0
        out[at : at + len(part)][some] = np.clip(total[some] / weight[some], 0, 1)
    return out


def score(docs: DataFrame, labels: DataFrame, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score in ``column`` (a column of that name is replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    keep = docs.drop(column)
    names = [f"c{i}" for i in range(len(keep.columns))]
    at = keep.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = document_scores(batch.column(at).cast(pa.large_binary()).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, keep.dtypes))
    return keep.toDF(*names).mapInArrow(run, f"{schema}, score double").toDF(*keep.columns, column)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is at least THRESHOLD, columns as they were, whatever their names."""
    taken, name = {c.lower() for c in docs.columns}, "quality"
    while name in taken:
        name += "_"
    return score(docs, labels, name).where(F.col(name) >= THRESHOLD).drop(name)
