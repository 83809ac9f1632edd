import copy
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from hunkwise.functions.hmac import hmac_sha256_hex
from hunkwise.operators import events
from hunkwise.schemas import PR_EVENTS_DDL
from hunkwise.streaming.intake import judged_rows, read_judged, start_intake
from tests.conftest import rows

SECRET = "s3cret"
PAYLOAD = {
    "action": "opened", "number": 731,
    "pull_request": {
        "number": 731, "title": "Split the parser", "state": "open", "head": {"sha": "77aa10c2e94b5d31", "ref": "parser/split"},
        "base": {"sha": "0b3fd1529c6e8a47", "ref": "main"}, "user": {"login": "mara", "id": 412},
        "html_url": "https://example.org/shop/till/pull/731", "diff_url": "https://example.org/shop/till/pull/731.diff",
        "patch_url": "https://example.org/shop/till/pull/731.patch", "additions": 48, "deletions": 21, "changed_files": 5,
    },
    "repository": {"id": 64, "name": "till", "full_name": "shop/till", "clone_url": "https://example.org/shop/till.git", "default_branch": "main"},
    "sender": {"login": "tove", "id": 77}, "installation": {"id": 8086},
}


def sign(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def changed(path, value=...):
    out = copy.deepcopy(PAYLOAD)
    at = out
    *head, last = path.split(".")
    for name in head:
        at = at[name]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return json.dumps(out).encode()


def judge(spark, deliveries):
    data = [(str(i), kind, sig, bytearray(body), None) for i, (kind, sig, body) in enumerate(deliveries)]
    return events.with_disposition(spark.createDataFrame(data, PR_EVENTS_DDL), SECRET)


def dispositions(spark, deliveries):
    got = {r.delivery_id: r.disposition for r in judge(spark, deliveries).collect()}
    return [got[str(i)] for i in range(len(deliveries))]


def signed(*bodies):
    return [("pull_request", sign(b), b) for b in bodies]


@pytest.mark.parametrize("secret", ["", "k", "k" * 64, "k" * 65, "schlüssel" * 20])
def test_hmac(spark, secret):
    bodies = [b"", b"x", "é".encode(), bytes(range(256)) * 5]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary")
    got = {r.i: r.h for r in df.select("i", hmac_sha256_hex(secret, F.col("b")).alias("h")).collect()}
    assert [got[i] for i in range(len(bodies))] == [hmac.new(secret.encode(), b, hashlib.sha256).hexdigest() for b in bodies]


def test_order_of_checks(spark):
    body, ping = json.dumps(PAYLOAD).encode(), b'{"zen":"x"}'
    assert dispositions(spark, [
        ("pull_request", None, body), ("pull_request", "", body), ("pull_request", "md5=1", body), ("pull_request", "sha256", body),
        ("pull_request", "sha256=bad", body), ("pull_request", sign(body, "other"), body), ("ping", sign(ping), ping), (None, sign(ping), ping),
        ("ping", "sha256=bad", ping), ("pull_request", sign(ping), ping), ("pull_request", sign(body), body),
        ("pull_request", sign(body).replace("=", "=="), body),
    ]) == ["missing", "missing", "malformed", "malformed", "mismatch", "mismatch", "ignored_event", "ignored_event", "mismatch",
           "invalid_payload", "accepted", "mismatch"]


def test_payload_validation(spark):
    bad = [
        changed("action"), changed("number"), changed("number", "x"), changed("number", 1.5), changed("pull_request.title"),
        changed("pull_request.title", 5), changed("pull_request.title", None), changed("pull_request", 7), changed("pull_request.head.sha"),
        changed("pull_request.html_url", "ftp://x/y"), changed("pull_request.html_url", "not a url"), changed("pull_request.user.id"),
        changed("repository.clone_url"), changed("repository.default_branch", None), changed("sender.login"), changed("sender", None),
        changed("installation", {}), changed("installation", 5), changed("pull_request.additions", None), changed("pull_request.additions", "x"),
        changed("pull_request.head.repo", {"id": 1}), changed("pull_request.body", 3), b"[1]", b"7", b"not json", b"\xff\xfe", b"",
    ]
    assert dispositions(spark, signed(*bad)) == ["invalid_payload"] * len(bad)
    good = [
        changed("number", "10"), changed("number", 10.0), changed("installation", None), changed("installation"),
        changed("repository.default_branch"), changed("pull_request.additions"), changed("pull_request.body", None),
        changed("pull_request.body", "text"), changed("pull_request.head.repo", None),
        changed("pull_request.head.repo", PAYLOAD["repository"]), changed("extra", [1]), changed("action", "reopened"),
    ]
    assert dispositions(spark, signed(*good)) == ["accepted"] * len(good)
    # validation comes before the action filter
    both = json.loads(changed("pull_request.title"))
    both["action"] = "closed"
    assert dispositions(spark, signed(changed("action", "closed"), json.dumps(both).encode())) == ["ignored_action", "invalid_payload"]


def test_context(spark):
    (r,) = events.review_contexts(judge(spark, signed(json.dumps(PAYLOAD).encode()))).collect()
    assert r.asDict() == {
        "installation_id": 8086, "repo_full_name": "shop/till", "repo_clone_url": "https://example.org/shop/till.git", "pr_number": 731,
        "pr_title": "Split the parser", "head_sha": "77aa10c2e94b5d31", "head_branch": "parser/split", "base_branch": "main",
        "author_login": "tove", "additions": 48, "deletions": 21, "changed_files": 5}
    (r,) = events.review_contexts(judge(spark, signed(changed("installation", None)))).collect()
    assert r.installation_id is None


@pytest.mark.parametrize("url,want", [
    ("HTTPS://Example.ORG:443", "https://example.org/"), ("http://a.b:80/x", "http://a.b/x"), ("http://a.b:8080", "http://a.b:8080/"),
    ("https://u:p@A.b/C?d#e", "https://u:p@a.b/C?d#e"), ("https://a.b?x=1", "https://a.b/?x=1")])
def test_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(events.is_http_url(F.col("u")), events.normal_url(F.col("u"))).first()[:] == (True, want)


def test_json_is_parsed_once(spark):
    plan = judge(spark, signed(json.dumps(PAYLOAD).encode())).where("disposition = 'accepted'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_stream_equals_batch(spark, tmp_path):
    body = json.dumps(PAYLOAD).encode()
    all_rows = [(str(i), "pull_request" if i % 3 else "ping", sign(body) if i % 4 else None, bytearray(body), None) for i in range(30)]
    source = str(tmp_path / "in")
    for part in (all_rows[:10], all_rows[10:]):
        spark.createDataFrame(part, PR_EVENTS_DDL).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(PR_EVENTS_DDL).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    run = start_intake(stream, SECRET, str(tmp_path / "out"), str(tmp_path / "ckpt"), lambda ctx, n: seen.append((n, ctx.count())))
    run.awaitTermination()
    batch = judged_rows(spark.createDataFrame(all_rows, PR_EVENTS_DDL), SECRET)
    got = read_judged(spark, str(tmp_path / "out")).select(batch.columns)
    assert rows(got, "delivery_id") == rows(batch, "delivery_id")
    assert [n for n, _ in seen] == [0, 1] and sum(c for _, c in seen) == batch.where("disposition = 'accepted'").count()
    # a second run finds nothing new, and a repeated batch replaces its folder
    start_intake(stream, SECRET, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    start_intake(stream, SECRET, str(tmp_path / "out"), str(tmp_path / "ckpt2")).awaitTermination()
    assert read_judged(spark, str(tmp_path / "out")).count() == 30


def test_repeated_keys_take_the_last(spark):
    text = json.dumps(PAYLOAD)
    twice = text[:-1] + ', "action": "closed", "number": 5, "sender": {"login": "x", "login": "y", "id": 3}}'
    assert dispositions(spark, signed(text.encode(), twice.encode())) == ["accepted", "ignored_action"]
