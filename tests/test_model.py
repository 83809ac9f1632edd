import json

from hunkwise.operators import model
from tests.conftest import rows

KEYS = ["review", "category"]


def found(spark, *raws):
    df = spark.createDataFrame([(i, "security", r) for i, r in enumerate(raws)], "review int, category string, raw string")
    decoded = model.decode_replies(df)
    return decoded, model.model_findings(model.explode_items(decoded, KEYS), KEYS)


def reply(*items):
    return json.dumps({"summary": "s", "findings": list(items)})


FULL = {
    "file": "services/payment.py", "line_start": 12, "line_end": 14, "symbol_name": "PaymentService.charge", "severity": "high",
    "title": "Missing Permission Check", "message": "No check.", "suggested_fix": "verify(user)", "confidence_score": 0.95,
}


def test_valid_and_low_confidence(spark):
    decoded, got = found(spark, reply(FULL, {**FULL, "confidence_score": 0.5}))
    assert decoded.first().summary == "s"
    (r,) = got.collect()
    assert {k: r[k] for k in FULL} == FULL and r.item_ord == 0


def test_shapes(spark):
    decoded, got = found(spark, "not json", "[1]", '{"findings": null}', '{"summary": "x"}', '{"summary": null, "findings": []}', '{"findings": {"a": 1}}')
    assert rows(decoded.select("review", "reply_status", "summary"), "review") == [
        (0, "not_json", "Failed to parse LLM response."), (1, "bad_shape", None), (2, "bad_shape", None), (3, "ok", "x"),
        (4, "ok", ""), (5, "bad_shape", None)]
    assert rows(model.quarantine(decoded).select("review"), "review") == [(0,), (1,), (2,), (5,)]
    assert got.count() == 0


def one(spark, **changes):
    item = {k: v for k, v in {**FULL, **changes}.items() if v is not ...}
    got = found(spark, reply(item))[1].collect()
    return got[0] if got else None


def test_missing_null_quoted(spark):
    cases = [
        ({"severity": None}, "severity", "medium"), ({"severity": ...}, "severity", "medium"), ({"severity": "HIGH"}, "severity", "high"),
        ({"severity": "severe"}, "severity", "medium"), ({"severity": 3}, "severity", "medium"),
        ({"confidence_score": ...}, "confidence_score", 1.0), ({"confidence_score": "0.9"}, "confidence_score", 0.9),
        ({"confidence_score": 1}, "confidence_score", 1.0), ({"confidence_score": True}, "confidence_score", 1.0),
        ({"confidence_score": 0.7}, "confidence_score", 0.7), ({"confidence_score": " 0.8 "}, "confidence_score", 0.8),
        ({"title": None}, "title", "None"), ({"title": ...}, "title", "Review Finding"), ({"title": 5}, "title", "5"),
        ({"title": True}, "title", "True"), ({"message": ...}, "message", ""), ({"message": None}, "message", "None"),
        ({"file": ...}, "file", "unknown"), ({"file": None}, "file", "None"),
        ({"line_start": 12.7}, "line_start", 12), ({"line_start": "7"}, "line_start", 7), ({"line_start": ...}, "line_start", 1),
        ({"line_start": True}, "line_start", 1), ({"line_end": ...}, "line_end", 12), ({"line_end": "9"}, "line_end", 9),
        ({"symbol_name": None}, "symbol_name", None), ({"symbol_name": ...}, "symbol_name", None), ({"suggested_fix": None}, "suggested_fix", None),
    ]
    got = found(spark, *[reply({k: v for k, v in {**FULL, **c}.items() if v is not ...}) for c, _, _ in cases])[1]
    by_review = {r.review: r for r in got.collect()}
    for i, (change, name, want) in enumerate(cases):
        assert by_review[i][name] == want, change


def test_unreadable_items_are_dropped_alone(spark):
    bad = [
        {"confidence_score": None}, {"confidence_score": "high"}, {"confidence_score": 1.1}, {"confidence_score": -1}, {"confidence_score": "0.9f"},
        {"line_start": None}, {"line_start": "12.7"}, {"line_start": "x"}, {"line_start": [1]}, {"line_end": None},
        {"suggested_fix": 3}, {"symbol_name": ["a"]}, {"suggested_fix": {"a": 1}},
    ]
    items = [7, "text", None, [FULL]] + [{**FULL, **b} for b in bad] + [FULL]
    got = found(spark, reply(*items))[1].collect()
    assert [r.item_ord for r in got] == [len(items) - 1]


def test_merge(spark):
    rules = spark.createDataFrame([(1, "security", "a.py", 2, "rule"), (1, "security", "a.py", 2, "rule again")],
                                  "review int, category string, file string, line_start int, title string")
    items = spark.createDataFrame(
        [(1, "security", "a.py", 2, "model", 0), (1, "security", "a.py", 3, "later", 2), (1, "security", "a.py", 3, "first", 1),
         (1, "bug_risk", "a.py", 2, "other agent", 0), (2, "security", "a.py", 2, "other review", 0)],
        "review int, category string, file string, line_start int, title string, item_ord int")
    merged = model.merge_findings(rules, items, KEYS)
    assert sorted(r.title for r in merged.collect()) == ["first", "other agent", "other review", "rule", "rule again"]


def test_merge_many_items_at_one_place(spark):
    items = spark.range(50_000).selectExpr(
        "1 AS review", "'security' AS category", "'unknown' AS file", "1 AS line_start", "cast(id AS string) AS title", "cast(id AS int) AS item_ord")
    none = spark.createDataFrame([], "review int, category string, file string, line_start int, title string")
    assert [r.title for r in model.merge_findings(none, items, KEYS).collect()] == ["0"]


def test_repeated_keys_take_the_last(spark):
    raw = '{"summary": "a", "summary": "b", "findings": [], "findings": ' + json.dumps([FULL])[:-2] + ', "title": "Later"}]}'
    decoded, got = found(spark, raw)
    assert (decoded.first().reply_status, decoded.first().summary) == ("ok", "b")
    assert [r.title for r in got.collect()] == ["Later"]
