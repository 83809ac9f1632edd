"""Word shingles and similarity sketches of many texts at once, as numpy work inside tasks.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. A text's set holds the 64-bit hashes of its
distinct five-word shingles; a text of one to four words has its whole sequence as the only shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes of text hashed at a time: bounds the arrays of a task, changes no result.
CHUNK_BYTES = 1 << 19

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93
_PLACES = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_COUNT = np.uint64(0x589965CC75374CC3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    upper = (codes >= 65) & (codes <= 90)
    values = mix(np.where(upper, codes + np.uint64(32), codes))
    values[_SPACES] = 0
    return values


_SPACES = np.array([9, 10, 11, 12, 13, 32])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[_SPACES] = True
_VALUES = _byte_values()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS.update(up=_powers(_R, size), down=_powers(pow(_R, -1, 1 << 64), size))
    return _POWERS["up"], _POWERS["down"]


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about CHUNK_BYTES that end at white space, so that no word is cut."""
    at = 0
    while len(data) - at > CHUNK_BYTES:
        cut = at + CHUNK_BYTES
        while cut < len(data) and not _IS_SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and where each begins."""
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in _pieces(data):
        codes = np.frombuffer(piece, np.uint8)
        word = np.concatenate(([False], ~_IS_SPACE[codes], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, last = edges[::2], edges[1::2]
        if len(first):
            up, down = _tables(len(codes) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[codes] * up[: len(codes)], dtype=np.uint64)))
            hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
            begins.append(first + at)
        at += len(piece)
    return np.concatenate(hashes), np.concatenate(begins)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null and for texts without words."""
    data = [t or b"" for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in data])
    words, begins = word_hashes(b"\n".join(data))
    bounds = np.searchsorted(begins, starts)
    n = len(words)
    shingles = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        whole = n - SHINGLE + 1
        total = np.zeros(whole, np.uint64)
        for k in range(SHINGLE):
            total += words[k : k + whole] * _PLACES[k]
        shingles[:whole] = mix(total + _COUNT * np.full(1, SHINGLE, np.uint64))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(shingles[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + _COUNT * np.full(1, b - a, np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of ``t`` coordinates a set (all ones for an empty set): two sets agree on a coordinate with a probability of
    their Jaccard similarity.

    In round i each element falls into a bin with the value (i, its hash in that round), and bins keep their minimum:
    a random bin in the first ``t`` rounds, bin i - t in the later ones, so that 2t rounds fill every bin. Values of later
    rounds are larger, so a set stops as soon as its bins are full; n elements need about t ln t / n rounds.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), empty, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * t):
        if not len(items):
            break
        with np.errstate(over="ignore"):
            drawn = mix(items ^ mix(np.array([i], np.uint64)))
        if i < t:
            bins = ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(items), i - t)
        np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(32)) | (drawn >> np.uint64(32)))
        open_rows = (out == empty).any(axis=1)
        left = open_rows[owner]
        owner, items = owner[left], items[left]
    return out


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band; keys of different bands do not meet."""
    n, t = rows.shape
    width = t // bands
    keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (n, 1))
    for k in range(width):
        keys = mix(keys ^ rows[:, k::width][:, :bands])
    return keys.view(np.int64)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of neighbouring texts of about CHUNK_BYTES, each with its first place."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"") + 1
        if size >= CHUNK_BYTES:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]
