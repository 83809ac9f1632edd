import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hunkwise.llm import middle, rankindex
from tests.llm.helpers import awkward, docs_frame

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢😀\t\n\x0b\x0c\r\x1c\xa0", max_size=60), max_size=8))
def test_boundaries_are_token_ends(texts):
    found = rankindex.boundaries([t.encode() for t in texts])
    for i, text in enumerate(texts):
        ends = [len(text[: m.end()].encode()) for m in TOKEN.finditer(text)]
        assert found.offsets[found.first[i] : found.first[i + 1]].tolist() == [0, *ends]
    assert found.tokens.tolist() == [len(TOKEN.findall(t)) for t in texts]


def test_index_is_exact_and_bounded():
    rng = random.Random(1)
    smooth = " ".join("x" * rng.randint(1, 12) for _ in range(20_000))
    jumps = " ".join("y" * rng.choice([1, 2, 3, 5_000]) for _ in range(400))
    found = rankindex.boundaries([smooth.encode(), b"", jumps.encode(), b"one", b"\n"])
    index = rankindex.fit(found)
    at = np.arange(len(found.offsets))
    assert (index.offset(at) == found.offsets).all()
    assert index.rest.dtype == np.int8 and len(index.rest) == len(found.offsets)
    of_smooth = (index.start < found.first[1]).sum()
    assert of_smooth < 200  # 20,000 boundaries, words of 1 to 12 characters
    assert set(found.first[:-1]) <= set(index.start)  # no segment spans two texts


def test_stored_index(spark):
    rows = {r["doc_id"]: r.asDict() for r in rankindex.index_table(docs_frame(spark, awkward())).collect()}
    texts = {d: t or "" for d, t, _ in awkward()}
    for doc_id in (0, 7, 2000, 2001, 2002, 2005, 2006):
        ends = [0] + [len(texts[doc_id][: m.end()].encode()) for m in TOKEN.finditer(texts[doc_id])]
        assert rows[doc_id]["n"] == len(ends) - 1
        assert [rankindex.stored_offset(rows[doc_id], r) for r in range(0, len(ends), 97)] == ends[::97]


@pytest.fixture(scope="module")
def rows():
    marked = [(5000 + i, f"{'<' * (i % 3)}<{'PSMX'[i % 4]}{'>' * (i % 2)} w{i}  end<{' ' * (i % 2)}", None) for i in range(80)]
    spaces = [(6000 + i, "  lead é 漢字\n\n tail \t", "s") for i in range(40)]
    return awkward(150) + marked + spaces


def test_equals_plain_python(spark, rows):
    docs = docs_frame(spark, rows, extra=True).selectExpr("*", "'x' AS n", "'x' AS form", "'x' AS h", "'x' AS plain", "'x' AS output")
    found = middle.fill_in_middle(docs)
    out = found.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows) and {"h", "plain", "c0", "rep"} <= set(found.columns)
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_rates_and_empty_table(spark, rows):
    docs = docs_frame(spark, rows)
    assert {r["form"] for r in middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in middle.fill_in_middle(docs, rate=100, spm=0).collect()} == {"plain", "psm"}
    empty = middle.fill_in_middle(docs_frame(spark, []))
    assert empty.count() == 0 and empty.columns[-5:] == ["n", "form", "prefix_chars", "middle_chars", "output"]
