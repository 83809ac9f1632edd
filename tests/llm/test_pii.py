import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hunkwise.llm import pii
from hunkwise.llm.queries import op6_personal_data
from tests.llm.helpers import awkward, docs_frame, sha

#: The contract's patterns.
KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    double = [int(c) * 2 - 9 if int(c) > 4 else int(c) * 2 for c in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(x) <= 255 for x in value.split(".")) if kind == "ip" else None,
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS for m in re.finditer(p, text or "") if valid(k, m.group())]


NASTY = ["a@b@c.d x_y@z.w.v-@q", "a@b.com_x@c.d.", "é😀 joe+1@mail.example.com, 1.2.3.4.5.6.7.8 256.1.1.1 00001.002.3.255 9.9.9.2555",
         "4111 1111-1111 1111 4111111111111112 0 1 2 3", "+1 (437) 555-0689) +44.. 20 7946 0958-- +1--- ++1234567890 +12345678901234567", "@", "+", "5", "1.1.1.1@x.y",
         "4111111111111111" * 3, ". ".join(["7@7.7"] * 40)]


def documents():
    rng = random.Random(9)
    pieces = ["joe@a.bc", "1.2.3.4", "300.1.1.1", "4111111111111111", "+1 (437) 555-0689", "@", ".", "-", "_", "é", "x", "7", " ", "  ", "word", "\n", "+"]
    rows = [(8000 + i, t, "s") for i, t in enumerate(NASTY)]
    rows += [(8100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))), "s") for i in range(200)]
    return rows + awkward()


def test_base_spans_against_python(spark):
    rows = documents()
    got = defaultdict(list)
    for r in pii.find(docs_frame(spark, rows, extra=True)).collect():
        got[r["doc_id"]].append([(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]])
    for d, t, _ in rows:
        assert base(t) in got[d], t
    assert sum(map(len, got.values())) == len(rows)


def test_long_runs_are_linear(spark):
    texts = ["a" * 300_000, "a@" * 100_000, "1." * 150_000, "1 " * 150_000, "+1" + "." * 300_000, "a.b" * 100_000 + "@" + "c.d" * 60_000, "1@2.3 " * 4_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sizes = {r["doc_id"]: len(r["base"]) for r in pii.find(docs_frame(spark, rows)).collect()}
    assert sizes == {0: 0, 1: 0, 2: sizes[2], 3: 0, 4: 0, 5: 1, 6: 4000} and sizes[2] > 30_000


def disclosing_pairs(rows):
    """Brute force over whole texts: (value, term) with both in two documents, or next to each other in one."""
    word = re.compile(r"[^\W\d_]{3,}")
    n_t, n_c, n_ct, beside = Counter(), Counter(), Counter(), set()
    for _, text, _ in rows:
        terms, found = {w.lower() for w in word.findall(text or "")}, base(text)
        values = {text[s:e].lower() for _, s, e in found}
        n_t.update(terms)
        n_c.update(values)
        n_ct.update((v, t) for v in values for t in terms)
        for kind, s, e in found:
            of_kind = [m.span() for m in re.finditer(dict(KINDS)[kind], text)]
            left = max([y for x, y in of_kind if y <= s], default=0)
            right = min([x for x, y in of_kind if x >= e], default=len(text))
            for first, last in ((max(left, s - pii.NEAR), s), (e, min(right, e + pii.NEAR))):
                for w in word.finditer(text):
                    if first <= max(w.start(), first if first == left else 0) and w.end() > first and w.start() < last:
                        x, y = max(w.start(), left), min(w.end(), right)  # words end where a match stands
                        if x >= first and y <= last and y - x >= 3:
                            beside.add((text[s:e].lower(), text[x:y].lower()))
    n = len(rows)
    return {(c, t) for (c, t), k in n_ct.items() if n_c[c] < n and (k > 1 or (c, t) in beside)
            and math.log(n * k / (n_c[c] * n_t[t])) >= pii.DISCLOSED * math.log(n / n_c[c]) - 1e-12}


def test_whole_texts_against_brute_force(spark):
    """Values of one and of several documents, several a text, terms far from them, values that share terms, rare words of one document."""
    rng = random.Random(4)
    common = [f"wort{c}" for c in "abcdefghijklm"]
    values = ["joe@a.bc", "Ann@b.cd", "10.0.0.7", "+49 30 1234567", "x@only.one"]
    friend = {"joe@a.bc": "Xavier", "Ann@b.cd": "Yolanda", "10.0.0.7": "gateway", "+49 30 1234567": "Berlin", "x@only.one": "Zebulon"}
    rows = []
    for i in range(150):
        parts = [rng.choice(common) for _ in range(60)] + [f"selten{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        held = [v for j, v in enumerate(values[:4]) if i % (9 + 4 * j) == 0] + ([values[4]] if i == 77 else [])
        for v in held:
            parts.insert(rng.randrange(len(parts)), v)
            if rng.random() < 0.9:
                parts.insert(0, friend[v])  # mostly far from the value
        rows.append((i, " ".join(parts), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, rows[0][1], "s")]
    pairs, word = disclosing_pairs(rows), re.compile(r"[^\W\d_]{3,}")
    assert {("joe@a.bc", "xavier"), ("ann@b.cd", "yolanda"), ("10.0.0.7", "gateway")} <= pairs
    out = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in pii.find(docs_frame(spark, rows)).collect()}
    for d, t, _ in rows:
        at = base(t)
        told = {term for _, s, e in at for c, term in pairs if c == t[s:e].lower()}
        assert out[d] == [w.span() for w in word.finditer(t or "") if w.group().lower() in told and not any(s < w.end() and w.start() < e for _, s, e in at)], d


def test_disclosing_terms(spark):
    rng = random.Random(2)
    common = [f"wort{c}" for c in "abcdefghij"]
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(common) for _ in range(30))
        if i % 20 == 0:
            text += " chief Xavier joe@secret.org leads " + " ".join(rng.choice(common) for _ in range(40)) + " Xavier"
        rows.append((i, text, "s"))
    out = {r["doc_id"]: r for r in pii.find(docs_frame(spark, rows)).collect()}
    disclosing = {t for (_, t) in disclosing_pairs(rows)}
    word = re.compile(r"[^\W\d_]{3,}")
    assert {"xavier", "chief", "leads"} <= disclosing
    texts = {d: t for d, t, _ in rows}
    found = {texts[d][s["start"] : s["end"]].lower() for d, r in out.items() for s in r["terms"]}
    assert found == disclosing - {"joe", "secret", "org"}  # words of the value itself stand in base spans only
    for d, r in out.items():
        base_at = base(texts[d])
        marked = [(w.start(), w.end()) for w in word.finditer(texts[d]) if base_at and w.group().lower() in disclosing
                  and not any(s < w.end() and w.start() < e for _, s, e in base_at)]
        assert [(s["start"], s["end"]) for s in r["terms"]] == marked
    assert all(not out[i]["terms"] for i in range(200) if i % 20)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_frame(spark, rows)).collect()}
    assert clean[1] == texts[1] and "<term> <term> <email> <term>" in clean[20] and "joe@" not in clean[20] and clean[20].endswith("<term>")
    assert "Xavier" not in clean[20]


def test_values_of_one_document_are_protected(spark):
    common = [f"wort{c}" for c in "abcdefghij"]
    rows = [(i, " ".join(common), "s") for i in range(100)]
    rows += [(200, "worta Zebulon uno@secret.org wortb", "s"), (201, "worta Ottilie due@secret.org wortb", "s"), (202, "worta Ruprecht due@secret.org wortb", "s")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_frame(spark, rows)).collect()}
    assert [clean[i] for i in (200, 201, 202)] == ["worta <term> <email> wortb"] * 3 and clean[7] == rows[7][1]


def test_query_columns_and_empty_table(spark, tmp_path):
    docs_frame(spark, documents()).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_personal_data(spark, str(tmp_path)).collect()
    texts = {d: t for d, t, _ in documents() if d and d >= 8000}
    for r in (r for r in rows if r["doc_id"] in texts):
        b = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert r["base_sha256"] == sha(joined) and (r["spans"] + ",").startswith(joined)
        assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(x[0] == k for x in b) for k, _ in KINDS]
    assert pii.find(docs_frame(spark, [])).count() == 0
    assert pii.sanitise(docs_frame(spark, [])).count() == 0


def test_running_sums(spark):
    sizes = [0, 1, 255, 256, 257, 1000, 50_000]
    df = spark.range(1).select(*(pii.running_sums(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias(f"n{n}") for n in sizes))
    row = df.first()
    for n in sizes:
        assert len(row[f"n{n}"]) == n and (n == 0 or row[f"n{n}"][-1] == n * (n + 1) // 2)
