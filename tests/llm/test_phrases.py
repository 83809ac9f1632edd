import random
import re
from collections import Counter

import numpy as np
import pytest

from hunkwise.llm import phrases
from tests.llm.helpers import FOLD, awkward


def brute(rows, least, top):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for s in range(len(p) - m + 1):
                most[lang, p[s : s + m]] = max(most[lang, p[s : s + m]], a)
    found = {}
    for (lang, p), a in candidates.items():
        if 100 * most[lang, p] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, r, n[lang], -s) for lang, all_of in found.items()
                  for rank, (s, a, p, left, r) in enumerate(sorted(all_of)[:top], 1))


def frame(spark, rows, *extra):
    return spark.createDataFrame(rows, "text string, lang string").selectExpr("*", *extra)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "The", "of", "new", "york", "été", "x\x1cy", "<s>", "市", "a-b", "don't"]
    weights = [30, 20, 15, 8, 8, 4, 3, 2, 2, 2, 2]

    def text(size):
        out = []
        for _ in range(size):
            out += rng.choice([["New", "York", "City", "hall"], ["in", "spite", "of"]]) if rng.random() < 0.15 else [rng.choices(words, weights)[0]]
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "! "]))
        return " ".join(out) if rng.random() < 0.1 else "".join(w + " " for w in out)

    some = [(text(rng.randint(0, 60)), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for _ in range(120)]
    return some + [(None, "en"), ("", None), (" \t\n", "zz"), ("word", "yy")] + [("the cat sat on the mat", "en")] * 40 + [(t, "de") for _, t, _ in awkward()]


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 25)])
def test_equals_brute_force(spark, rows, least, top):
    docs = frame(spark, rows, "'x' AS phrase", "1 AS n", "'y' AS prefix", "'z' AS rank").repartition(5)
    want = brute(rows, least, top)
    assert len(want) > 50 if least == 3 else len(want) > 3
    assert sorted(map(tuple, phrases.collocations(docs, least, top).collect())) == want


def test_full_filter_and_tiny_portions_change_nothing(spark, rows, monkeypatch):
    want = brute(rows, 10, 500)
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 10)  # nearly every bit is set: all phrases pass
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), 10, 500).collect())) == want
    monkeypatch.setattr(phrases, "HOT_PARTS", 1)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), 10, 500).collect())) == want


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 64)
    text = ("one two three, " * 40 + "a" * 500 + " b. " + "four five " * 30).encode()
    parts = [(langs, texts) for langs, texts in phrases._portions(["en", "fr"], [text, None])]
    assert b"".join(t for _, texts in parts for t in texts) == text
    assert all(t[-1:] == b"," or t[-1:] == b"." or t.endswith(b"five ") for _, texts in parts for t in texts)


def test_filter_has_no_false_negatives(spark):
    rng = random.Random(4)
    text = ". ".join(f"w{rng.randint(0, 400)} w{rng.randint(0, 400)}" for _ in range(500)).encode()
    portion = phrases.Portion(["en"], [text])
    hashes = portion.hashes(2)[portion.phrases(2)]
    assert len(hashes) == 500
    found = spark.createDataFrame([(int(h),) for h in hashes[::2].view(np.int64)], "hash long").repartition(3)
    bits = phrases.hash_filter(found)
    assert phrases.held(hashes[::2], bits).all() and phrases.held(hashes[1::2], bits).mean() < 0.1


def test_hashes_do_not_depend_on_the_place():
    one = phrases.Portion(["en"], [b"new york city"]).hashes(2)
    two = phrases.Portion(["fr", "en"], ["x é, ".encode(), b"a b. NEW  York\tcity"])
    assert set(one) <= set(two.hashes(2)) and not set(one) & set(phrases.Portion(["fr"], [b"new york city"]).hashes(2))


def test_products_beyond_64_bits(spark, monkeypatch):
    """Cells with counts near 2^45, as a corpus of many terabytes has them."""
    big = 1 << 45
    table = [("en", 0, "", "", 9 * big), ("en", 1, "", "a", 3 * big), ("en", 1, "", "b", 2 * big), ("en", 2, "a", "b", big + 7)]
    monkeypatch.setattr(phrases, "merged_stripes", lambda texts, filters: spark.createDataFrame(table, "lang string, k int, prefix string, next string, a long"))
    out = phrases.collocations(frame(spark, [("a b", "en")])).collect()
    assert [(r["phrase"], r["n"], r["score"]) for r in out] == [("a b", 9 * big, 2_000_000 * (big + 7) // (5 * big))]


def test_empty_table(spark):
    out = phrases.collocations(frame(spark, []))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(frame(spark, [("few words here", "en"), (None, None)])).count() == 0
