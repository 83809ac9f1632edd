"""Secret scans: a random forest removes the false positives of a wide candidate search.

A candidate is a run of 16 or more characters of the base64 and identifier alphabets, or a value of ``SHORTEST`` or more
characters of any alphabet that is assigned (after =, : or =>): what stands between quotes on a line, what stands up to
white space, and the parts of it after a further = or :. Candidates may overlap; equal spans are one candidate, and
overlapping secrets are redacted as one. The forest sees a candidate's length, its character classes and transitions, how
much of it dictionary words cover, the path (source) it stands in and the words around it. Dictionary: the ``DICTIONARY`` words that occur in most documents, counted over all texts; the same words give the
usual letter transitions.

The forest is trained from labelled findings. A caller may hand over a table of its own (``labelled``: the columns of
``findings`` and label 0/1). Without one it learns from two parts: the made lines of ``keyforms``, the same for every
corpus, and the corpus' own findings where a rule labels them. Rules on evidence that the features do not hold come first:
1 for an issuer's published key form, 0 for the exact form of a digest or UUID that no name of a secret introduces. Then the
surroundings: 1 for a quoted value assigned to a name such as token or password that mixes letters and digits and has no
blanks, 0 for a value of letters that words explain, of digits only, and for one introduced as a checksum, commit or card.
The rest is left to the forest. It takes at most ``TRAIN_FINDINGS`` findings of each label and form (under 16 characters or
not, hex digits or not: a common form crowds out no other), in the order of a hash; that bound is the only sample. However
many there are, half of what a tree draws are made lines, so the answer on a form does not turn with the corpus.

Defined results: null and empty texts have no findings; a null doc_id is carried as null; repeated rows repeat their
findings; where a caller's findings do not have both labels, the share of label 1 is every finding's score (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm import keyforms
from hunkwise.llm.common import Staged

DICTIONARY = 5_000
TRAIN_FINDINGS = 4_000
TREES, DEPTH = 60, 12
THRESHOLD = 0.5
MARK = "<secret>"
#: Distinct words that a task counts before it hands them on: bounds its memory, changes no result.
WORDS_AT_ONCE = 300_000

#: Characters of the shortest assigned value that is a candidate.
SHORTEST = 6

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
# All three are linear: quoted values of one kind of quote do not overlap, and bare values and parts do not overlap their like.
_QUOTED = re.compile(r"""(?:=>?|:)\s*+(?=(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`((?:[^`\\\n]++|\\.)*+)`))""")
_BARE = re.compile(rf"""(?:=>?|:)\s*+(?:(?:Bearer|Basic|Token)\s++)?+(?!["'`])(\S{{{SHORTEST},}})""")
_PART = re.compile(rf"""(?<=[=:])[^\s=:&;,|"'`<>()\[\]{{}}]{{{SHORTEST},}}""")
_OPENING, _CLOSING = "\\\"'`([{<", "\\\"'`)]}>,;."
_SOLID = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"[^\W\d_]{3,15}")
_ANY = re.compile(r"\w+")
_ASSIGNED = re.compile(r"""(?:=>?|:)\s*(?:(?:Bearer|Basic|Token)\s+)?(["'`]?)\Z""")
#: Names that introduce secrets, and ones that introduce other long values.
_SECRET_WORDS = frozenset("token secret password passwd pwd key apikey credential credentials auth bearer private access".split())
_OTHER_WORDS = frozenset("sha sha1 sha256 md5 hash checksum digest commit rev uuid guid card iban isbn version".split())
_TEST_WORDS = frozenset("test tests example examples sample samples doc docs fixture fixtures mock".split())

N_FEATURES = 30
_FINDING = "doc_id long, start long, end long, value_hash long, weak int, features array<double>"


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(set(_WORD.findall(text.lower())) if text else ())
            if len(counts) > WORDS_AT_ONCE:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[tuple[str, int]]:
    """The ``size`` words of most documents, with their number of documents."""
    counted = docs.select("text").mapInArrow(_word_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [(r["word"], r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans of all candidates, by start and end."""
    spans = {m.span() for m in _RUN.finditer(text)} | {m.span() for m in _PART.finditer(text)} | {m.span(m.lastindex) for m in _QUOTED.finditer(text)}
    for m in _BARE.finditer(text):
        value = m.group(1)
        end = m.start(1) + len(value.rstrip(_CLOSING))
        spans.add((m.end(1) - len(value.lstrip(_OPENING)), end))
    return sorted((a, b) for a, b in spans if b - a >= SHORTEST)


class Judge:
    """Turns texts into findings with features."""

    def __init__(self, words: list[tuple[str, int]]):
        self.automaton = ahocorasick.Automaton()
        for word, _ in words:
            self.automaton.add_word(word, len(word))
        if words:
            self.automaton.make_automaton()
        pairs: Counter = Counter()
        for word, n in words:
            for a, b in zip(word, word[1:]):
                pairs[a, b] += n
        total = sum(pairs.values())
        self.pairs = {k: np.log((n + 1) / (total + 1) * 900) for k, n in pairs.items()}
        self.rare = np.log(900 / (total + 900))

    def covered(self, value: str) -> float:
        if not len(self.automaton):
            return 0.0
        hit = bytearray(len(value))
        for end, n in self.automaton.iter(value):
            hit[end - n + 1 : end + 1] = b"\1" * n
        return sum(hit) / len(value)

    def features(self, text: str, start: int, end: int, path: str) -> tuple[int, list[float]]:
        value = text[start:end]
        n, low = len(value), value.lower()
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
        counts = Counter(value)
        changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1)
        entropy = -sum(k / n * np.log2(k / n) for k in counts.values())
        digits, uppers, lowers = (kinds.count(k) / n for k in "dul")
        before, after = text[max(0, start - 60) : start], text[end : end + 40]
        assigned = _ASSIGNED.search(before)
        quoted = bool(assigned and assigned.group(1) and after[:1] == assigned.group(1))
        near = [part for w in _ANY.findall(before)[-3:] for part in (w.lower(), *w.lower().split("_"))]
        secret, other = float(any(w in _SECRET_WORDS for w in near)), float(any(w in _OTHER_WORDS for w in near))
        steps = [self.pairs.get(p, self.rare) for p in zip(low, low[1:])]
        covered = self.covered(low)
        hexed = all(c in "0123456789abcdef" for c in low)
        parts = re.split(r"[/._-]", path.lower())
        following = _ANY.findall(after)[:1]
        solid = max(_SOLID.findall(value), key=len, default="")
        tail = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in solid]
        solid_counts = Counter(solid)
        solid_entropy = -sum(k / len(solid) * np.log2(k / len(solid)) for k in solid_counts.values()) if solid else 0.0
        lead = _SOLID.match(value)
        lead_length = lead.end() if lead and lead.end() < min(n, 13) else 0
        dashless = low.replace("-", "")
        weak = -1
        if keyforms.issued(value):
            weak = 1
        elif keyforms.public(value) and not (assigned and secret):
            weak = 0
        elif quoted and secret and not other and 0 < digits < 1 and entropy >= 2.5 and not any(map(str.isspace, value)):
            weak = 1
        elif digits == 1 or other or (not digits and (covered >= 0.5 or lowers == 1 or uppers == 1)):
            weak = 0
        return weak, [float(n), float(np.log(n)), entropy, entropy / np.log2(n), changes, digits, uppers, lowers, 1 - digits - uppers - lowers, float(hexed),
                      len(counts) / n, sum(low.count(c) for c in "aeiou") / n, covered, float(np.mean(steps)), float(np.min(steps)), float(bool(assigned)),
                      float(quoted), secret, other, float(len(parts)), float(any(p in _TEST_WORDS for p in parts)),
                      float(len(following[0])) if following else 0.0, float(lead_length), len(solid) / n, float(len(solid)), solid_entropy,
                      float(len(set(tail))), sum(a != b for a, b in zip(tail, tail[1:])) / max(1, len(tail) - 1),
                      float(bool(dashless) and all(c in "0123456789abcdef" for c in dashless)), max(counts.values()) / n]

    def findings(self, text: str | None, path: str | None) -> list[tuple[int, int, str, int, list[float]]]:
        return [(a, b, text[a:b], *self.features(text, a, b, path or "")) for a, b in candidates(text)] if text else []


def findings(docs: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """Every candidate with its place in code points, a hash of its value, its weak label (-1: none) and its features."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            rows = [(doc, a, b, xxhash.xxh3_64_intdigest(value) - (1 << 63), weak, f)
                    for doc, text, path in zip(*(c.to_pylist() for c in batch.columns)) for a, b, value, weak, f in judge.findings(text, path)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             names=["doc_id", "start", "end", "value_hash", "weak", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")).mapInArrow(run, _FINDING)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, nodes: list, depth: int) -> int:
    """Adds the subtree of these rows to ``nodes`` (feature, bound, left, right, share of label 1) and returns its place."""
    at = len(nodes)
    nodes.append([-1, 0.0, 0, 0, float(y.mean())])
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return at
    best = (1e-9, -1, 0.0)
    whole = y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            n = cut + 1.0
            a, b = ones[cut] / n, (ones[-1] - ones[cut]) / (len(y) - n)
            gain = whole - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                low, high = v[cut[k]], v[cut[k] + 1]
                best = (gain[k], f, (low + high) / 2 if (low + high) / 2 < high else low)
    if best[1] < 0:
        return at
    side = x[:, best[1]] <= best[2]
    left = _grow(x[side], y[side], rng, nodes, depth - 1)
    right = _grow(x[~side], y[~side], rng, nodes, depth - 1)
    nodes[at][:4] = [int(best[1]), float(best[2]), left, right]
    return at


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """Trees grown on bootstrap samples, drawn by ``weights`` (None: equal), each split on the best of a random subset of the features."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows, nodes = rng.choice(len(y), len(y), p=weights), []
        _grow(x[rows], y[rows].astype(float), rng, nodes, depth)
        out.append(np.array(nodes))
    return out


def forest_scores(x: np.ndarray, trees: list[np.ndarray], otherwise: float) -> np.ndarray:
    if not trees or not len(x):
        return np.full(len(x), otherwise)
    total = np.zeros(len(x))
    for nodes in trees:
        at = np.zeros(len(x), int)
        while True:
            f = nodes[at, 0].astype(int)
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            here = at[inner]
            left = x[inner, f[inner]] <= nodes[here, 1]
            at[inner] = np.where(left, nodes[here, 2], nodes[here, 3]).astype(int)
        total += nodes[at, 4]
    return total / len(trees)


def made_findings(words: list[tuple[str, int]]) -> list[tuple[int, list[float]]]:
    """(label, features) of the made lines: of each candidate that is the labelled value or a good part of it."""
    judge, out = Judge(words), []
    for label, text, start, end in keyforms.lines([w for w, _ in words]):
        inside = [(a, b) for a, b in candidates(text) if a >= start - 1 and b <= end + 1 and (not label or b - a >= 0.4 * (end - start))]
        out += [(label, judge.features(text, a, b, "")[1]) for a, b in inside or [(start, end)]]
    return out


def train(labelled: DataFrame, made: list[tuple[int, list[float]]] = (), limit: int = TRAIN_FINDINGS) -> tuple[list[np.ndarray], float]:
    """The forest and the share of label 1, from (value_hash, features, label) rows: at most ``limit`` of each label and form,
    which have half the weight at most beside ``made``."""
    rows = list(made)
    short, hexed = F.col("features")[0] < 16, F.col("features")[9] == 1
    for label, a, b in product((0, 1), (False, True), (False, True)):
        part = labelled.where((F.col("label") == label) & (short == a) & (hexed == b)).select("features", F.xxhash64("value_hash", "features").alias("place"))
        rows += [(label, r["features"]) for r in part.orderBy("place").limit(limit).collect()]
    y = np.array([label for label, _ in rows])
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return [], share
    weights = np.ones(len(rows))
    weights[len(made) :] = min(1.0, len(made) / max(1, len(rows) - len(made))) if made else 1.0
    return fit_forest(np.array([f for _, f in rows]), y, weights=weights / weights.sum()), share


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, int]], tuple]:
    """Scored findings (doc_id, start, end, value_hash, score, secret), the dictionary and the forest."""
    staged = Staged(docs.sparkSession)
    words = dictionary(docs)
    found = staged.put(findings(docs, words), "findings")
    model = train(found.where("weak >= 0").withColumn("label", F.col("weak")), made_findings(words)) if labelled is None else train(labelled)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(4).to_pylist(), float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(forest_scores(x, *sent.value), pa.float64())],
                                             names=["doc_id", "start", "end", "value_hash", "score"])

    scored = found.select("doc_id", "start", "end", "value_hash", "features").mapInArrow(
        run, "doc_id long, start long, end long, value_hash long, score double")
    return scored.withColumn("secret", F.col("score") >= THRESHOLD), words, model


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with each secret replaced by MARK, and n_chars (if there is one) brought in line; every row stays."""
    _, words, model = scan(docs, labelled)
    sent = docs.sparkSession.sparkContext.broadcast((words, model))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at, path_at = docs.columns.index("text"), docs.columns.index("source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = sent.value
        judge = Judge(words)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = [(k, f) for k, (text, path) in enumerate(zip(texts, batch.column(path_at).cast(pa.string()).to_pylist())) for f in judge.findings(text, path)]
            scores = forest_scores(np.array([f[4] for _, f in found], float).reshape(-1, N_FEATURES), *model)
            spans: list[list[int]] = []  # (row, start, end), apart and in order
            for (k, (a, b, *_)), s in zip(found, scores):
                if s >= THRESHOLD:
                    if spans and spans[-1][0] == k and a < spans[-1][2]:
                        spans[-1][2] = max(spans[-1][2], b)
                    else:
                        spans.append([k, a, b])
            for k, own in groupby(spans, key=lambda s: s[0]):
                text, pieces, at = texts[k], [], 0
                for _, a, b in own:
                    pieces += [text[at:a], MARK]
                    at = b
                texts[k] = "".join([*pieces, text[at:]])
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, docs.dtypes))
    out = docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
    if "n_chars" not in docs.columns:
        return out
    kind = dict(docs.dtypes)["n_chars"]
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))).select(docs.columns)
