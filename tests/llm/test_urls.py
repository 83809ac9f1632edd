import datetime
import random
from urllib.parse import urlsplit

from hunkwise.llm import urls
from hunkwise.llm.common import salted_join

DAY = datetime.date(2024, 1, 1)


def host(url):
    try:
        return ((urlsplit(url.lower()).hostname or "").rstrip(".") or None) if url and "://" in url else None
    except ValueError:
        return None


def listed(changes, entry, category, day):
    """Whether the last change up to ``day`` is an addition; a removal wins a tie."""
    past = [(c, a) for e, k, c, a in changes if e and k and c and a and (e.lower(), k) == (entry, category) and c <= day]
    return bool(past) and max(past)[1] == "add"


def test_against_brute_force(spark):
    rng = random.Random(8)
    names = ["a.com", "b.a.com", "c.b.a.com", "x.org", "localhost", "deep.er.x.org"]
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'user:pw@'])}{rng.choice(names).upper() if i % 5 == 0 else rng.choice(names)}{rng.choice(['', ':80', '.', '/p?q=1', '#f'])}",
             DAY + datetime.timedelta(rng.randrange(400))) for i in range(600)]
    rows += [(700, None, DAY), (701, "no url", DAY), (702, "http://a.com", None), (703, "http:///x", DAY), (None, "http://a.com", DAY), rows[0], rows[0]]
    changes = [(rng.choice(names + ["A.com"]), rng.choice(["ads", "bad"]), DAY + datetime.timedelta(rng.randrange(380)), rng.choice(["add", "remove"])) for _ in range(40)]
    changes += [("x.org", "ads", DAY, "add"), ("x.org", "ads", DAY, "remove"), (None, "ads", DAY, "add"), ("a.com", None, DAY, "add"), ("a.com", "ads", None, "add"), changes[0]]
    captures = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, fetched date, cell string, categories string")
    out = urls.judge(captures, spark.createDataFrame(changes, "entry string, category string, changed date, action string"), "page_id").collect()
    assert len(out) == len(rows)
    want = []
    for p, u, day in rows:
        h, active = host(u), set()
        if h and day:
            labels = h.split(".")
            for i in range(max(1, len(labels) - 1)):
                e = ".".join(labels[i:])
                active |= {(e, k) for k in ("ads", "bad") if listed(changes, e, k, day)}
        want.append((p or -1, h or "", bool(active), sorted({k for _, k in active}), sorted({e for e, _ in active})))
    assert sorted((r["page_id"] or -1, r["host"] or "", r["blocked"], r["categories"], r["entries"]) for r in out) == sorted(want)
    assert any(w[2] for w in want) and not all(w[2] for w in want)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, fetched date")
    changes = spark.createDataFrame([("a.com", "ads", DAY, "add")], "entry string, category string, changed date, action string")
    assert urls.judge(captures.where("false"), changes, "page_id").count() == 0
    assert [r["blocked"] for r in urls.judge(captures, changes.where("false"), "page_id").collect()] == [False]
    assert [r["blocked"] for r in urls.judge(captures, changes, "page_id").collect()] == [True]


def test_intervals_do_not_overlap(spark):
    day = [DAY + datetime.timedelta(i) for i in range(10)]
    rows = [("h", "k", day[1], "add"), ("h", "k", day[3], "add"), ("h", "k", day[5], "remove"), ("h", "k", day[6], "remove"), ("h", "k", day[8], "add")]
    spans = urls.intervals(spark.createDataFrame(rows, "entry string, category string, changed date, action string")).orderBy("valid_from").collect()
    assert [(s["valid_from"], s["valid_to"]) for s in spans] == [(day[1], day[5]), (day[8], None)]


def test_times_are_not_cut_to_days(spark):
    """A change at 18:00 says nothing about a capture of 09:00; dates count as their midnight."""
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    changes = spark.createDataFrame([("a.com", "ads", at(5, 18), "add"), ("a.com", "ads", at(7, 12), "remove")],
                                    "entry string, category string, changed timestamp, action string")
    times = [at(5, 9), at(5, 18), at(6, 0), at(7, 11), at(7, 12), at(9, 0)]
    captures = spark.createDataFrame([(i, "http://a.com/", t) for i, t in enumerate(times)], "page_id long, url string, fetched timestamp")
    got = {r["page_id"]: (r["fetched"], r["blocked"]) for r in urls.judge(captures, changes, "page_id").collect()}
    assert got == {i: (t, i in (1, 2, 3)) for i, t in enumerate(times)}
    days = spark.createDataFrame([(i, "http://a.com/", datetime.date(2024, 1, i)) for i in range(4, 9)], "page_id long, url string, fetched date")
    assert [r["page_id"] for r in urls.judge(days, changes, "page_id").orderBy("page_id").collect() if r["blocked"]] == [6, 7]


def test_timestamps_against_brute_force(spark):
    rng = random.Random(9)
    time = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(200 * 1440))
    names = ["a.com", "b.a.com", "x.org"]
    rows = [(i, f"https://{rng.choice(names)}/", time()) for i in range(400)]
    changes = [(rng.choice(names), rng.choice(["ads", "bad"]), time(), rng.choice(["add", "remove"])) for _ in range(60)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, fetched timestamp"),
                     spark.createDataFrame(changes, "entry string, category string, changed timestamp, action string"), "page_id")
    got = {r["page_id"]: r["categories"] for r in out.collect()}
    for p, u, at in rows:
        parents = [e for e in names if (h := host(u)) == e or h.endswith("." + e)]
        assert got[p] == sorted({k for k in ("ads", "bad") for e in parents if listed(changes, e, k, at)})
    assert any(got.values()) and not all(got.values())


def test_salted_join_equals_plain_join(spark):
    """A key with a third of the rows, null keys, keys of one side only, a key that is repeated on the right side."""
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 40) END AS k", "id % 2 AS j")
    right = spark.createDataFrame([("hot", 0, "x"), ("hot", 0, "y"), ("hot", 1, "z"), ("k1", 1, "a"), ("gone", 0, "b"), (None, 0, "c")], "k string, j long, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["k", "j"], how).collect()))
        joined = salted_join(left, right, ["k", "j"], how, salt_rows=64)
        assert sorted(map(str, joined.collect())) == want
        assert joined.columns == left.join(right, ["k", "j"], how).columns
    empty = left.where("false")
    assert salted_join(empty, right, ["k", "j"], "left").count() == 0 and salted_join(left, right.where("false"), ["k", "j"], "left").count() == 3000
