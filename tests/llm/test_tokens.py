import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from hunkwise.llm import tokens
from hunkwise.llm.queries import VOCABULARY
from tests.llm.helpers import awkward, docs_frame

NASTY = ["", " ", "  a", "日本語 テキスト😀😀 x", "a\nb\tc", "▁x", "    ", "é\x00x", "naïve  café   ", "x" * 3000, "́́", "a▁▁b ▁ c"]


def library(pieces, unknown_at, byte_fallback):
    out = Tokenizer(models.Unigram(pieces, unk_id=unknown_at, byte_fallback=byte_fallback))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.BLANK, prepend_scheme="always", split=False)
    return out


def test_public_vocabulary_against_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    hidden = [(chr(0xF0000 + i) if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    lib, own = library(hidden, 0, True), tokens.Counter(tokens.load(VOCABULARY))
    texts = [t for _, t, _ in awkward() if t] + NASTY
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts)]


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknowns_against_the_library(seed):
    """Small integer scores make ties; some characters are unknown; pieces may hold blanks inside."""
    rng = random.Random(seed)
    letters = "abc" + tokens.BLANK
    pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    if seed % 2:
        pieces = {p for p in pieces if tokens.BLANK not in p[1:]} | {tokens.BLANK}
    scored = [("\U000f0000", 0.0)] + [(p, float(-rng.randint(1, 6))) for p in sorted(pieces)]
    own = tokens.Counter(tokens.Vocabulary(scored[1:], min(s for _, s in scored), False))
    lib = library(scored, 0, False)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts)]


def test_table(spark, monkeypatch):
    rows = awkward()
    vocabulary = tokens.load(VOCABULARY)
    own = tokens.Counter(vocabulary)
    docs = docs_frame(spark, rows, extra=True)
    out = tokens.count_tokens(docs, vocabulary)
    assert out.columns == [*docs.columns, "n_tokens"]
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in out.collect()) == sorted((d or -1, own.count(t)) for d, t, _ in rows)
    assert tokens.count_tokens(docs_frame(spark, []), vocabulary).count() == 0
    totals = tokens.token_totals(out, "source").collect()
    assert sum(r["documents"] for r in totals) == len(rows)
    monkeypatch.setattr(tokens, "KEPT", 3)
    small = tokens.Counter(vocabulary)
    assert [small.count(t) for _, t, _ in rows] == [own.count(t) for _, t, _ in rows]


def test_vocabulary_is_measured(spark):
    with pytest.raises(ValueError):
        tokens.count_tokens(docs_frame(spark, []), tokens.Vocabulary([("x" * 6_000_000, 1.0)], 0.0, False))
