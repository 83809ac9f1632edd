"""Personal data: base patterns, and information-theoretic sanitisation of what stands around them. Built-in functions only.

Base spans are the leftmost non-overlapping matches of each kind's pattern over the whole text that pass the kind's check.
The patterns are possessive and start only where a match may start, so they are linear in the text and do not recurse.

The method protects every base value as an entity c. Over the whole corpus, and in whole texts, it counts the documents with c
(n_c), those with a term t, a word of three letters or more (n_t), and those with both (n_ct). The pointwise mutual information
log(N n_ct / n_c n_t) is what t reveals about c; c's own information is log(N / n_c). A term that reveals at least
``DISCLOSED`` of it discloses c: all its occurrences in every text that holds c become spans of kind term, except inside
base spans. One shared document is no evidence by itself, or every rare word of that document would disclose each of its values:
a pair is judged if it shares two documents or more, wherever t stands in them, or if t stands next to c somewhere (within
``NEAR`` characters, up to the next match of its kind). For a value of one document the words next to it are judged, by n_t alone. Words inside
a value are words of its text.

Since n_ct is n_c at most, t can disclose c only if n_t <= n_c (N / n_c) ** (1 - DISCLOSED). Terms beyond that are left out before
a text's terms meet its values, which loses nothing and leaves the rare ones. Joins on an entity or a pair are salted.
``sanitise`` replaces every span by its kind.

Defined results: null texts count as empty, null doc_ids are carried; repeated rows are rows (and documents) of their own;
an entity in all documents has no information and is disclosed by nothing; places are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.steps import computed_once
from hunkwise.llm.common import Staged, salted_join, small_side

#: Fixed values of the contract, in possessive form: the same matches, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text with a match must contain; spares the other texts the search.
_NEEDLES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}

NEAR = 80
DISCLOSED = 0.8
#: Steps of one stretch of a running sum.
STRETCH = 256

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPAN = "struct<kind:int,start:int,end:int,value:string,left:string,right:string>"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: inside functions of arrays, a plain column is computed again at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sums of the first 1, 2, ... of an array of integers, in stretches so that long arrays stay cheap."""
    zero = F.lit(0)

    def sums(array: Column, start: Column) -> Column:
        begin = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(array, begin, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all")), lambda s: s["all"])

    def cut(array: Column) -> Column:
        last = F.floor((F.size(array) - 1) / STRETCH).cast("int")
        return F.transform(F.sequence(zero, last), lambda i: F.slice(array, i * STRETCH + 1, F.lit(STRETCH)))

    def joined(stretches: Column) -> Column:
        totals = sums(F.transform(stretches, lambda s: F.aggregate(s, zero, lambda a, x: a + x)), zero)
        return let(F.concat(F.array(zero), totals), lambda starts: F.flatten(F.transform(stretches, lambda s, i: sums(s, F.get(starts, i)))))

    return let(numbers, lambda array: F.when(F.size(array) > 0, let(cut(array), joined)).otherwise(F.array().cast("array<int>")))


def _ends(pieces: Column, values: Column) -> Column:
    return running_sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.length(p) + F.length(v)))


def located(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` as (value, start, end, left, right): left and right are what stands between a match and its
    neighbours, at most NEAR characters."""
    def places(found: Column) -> Column:
        pieces, values = found["pieces"], found["values"]
        rows = F.arrays_zip(values.alias("value"), _ends(pieces, values).alias("end"), F.slice(pieces, F.lit(1), F.size(values)).alias("left"),
                            F.slice(pieces, F.lit(2), F.size(values)).alias("right"))
        return F.transform(rows, lambda r: F.struct(
            r["value"].alias("value"), (r["end"] - F.length(r["value"])).alias("start"), r["end"].alias("end"),
            _near(r["left"], -1).alias("left"), _near(r["right"], 1).alias("right")))

    return let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), places)


def _near(piece: Column, side: int) -> Column:
    """The NEAR characters of ``piece`` on the match's side; a word that the limit cuts is left out (as blanks)."""
    if side < 0:
        cut = F.right(piece, F.lit(NEAR))
        whole = F.regexp_replace(cut, r"\A\p{L}+", "")
        return F.when(F.length(piece) <= NEAR, piece).otherwise(whole)
    cut = F.left(piece, F.lit(NEAR))
    return F.when(F.length(piece) <= NEAR, piece).otherwise(F.regexp_replace(cut, r"\p{L}+\z", ""))


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by kind, then start: array of (kind, start, end, value, left, right), kind being a place in KINDS."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of_kind(place: int, kind: str, pattern: str) -> Column:
        needle = _NEEDLES[kind]
        may = text.contains(needle) if len(needle) == 1 else text.rlike(needle)
        found = F.filter(located(text, pattern), lambda r: _valid(kind, r["value"]))
        spans = F.transform(found, lambda r: F.struct(F.lit(place).alias("kind"), r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"),
                                                      r["left"].alias("left"), r["right"].alias("right")))
        return F.when(may, spans).otherwise(none)

    return F.concat(*(of_kind(i, *kind) for i, kind in enumerate(PATTERNS.items())))


def _terms(context: Column, origin: Column) -> Column:
    """The terms of a short context, with their places; ``origin`` is the place of the context's first character."""
    word = r"\p{L}{3,}+"

    def places(found: Column) -> Column:
        pieces, values = found["pieces"], found["values"]
        return F.transform(F.arrays_zip(values.alias("v"), _ends(pieces, values).alias("e")), lambda r: F.struct(
            F.lower(r["v"]).alias("term"), (origin + r["e"] - F.length(r["v"])).alias("start"), (origin + r["e"]).alias("end")))

    return let(F.struct(F.split(context, word, -1).alias("pieces"), F.regexp_extract_all(context, F.lit(word), F.lit(0)).alias("values")), places)


def _distinct_terms(text: str) -> Column:
    """The distinct terms of a whole text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}{3,}+"), F.lit(0))), F.lower))


def find(docs: DataFrame, staged: Staged | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, base (array of (kind, start, end)) and terms (array of (start, end))."""
    staged = staged or Staged(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = computed_once(docs.select("doc_id", text.alias("text")), "spans", base_spans(F.col("text")))
    # Only texts with base spans are read again, to mark terms in them.
    held = F.when(F.size("spans") > 0, F.col("text")).alias("held")
    rows = staged.put(rows.select("doc_id", "spans", held).withColumn("row", F.monotonically_increasing_id()), "spans")
    near = rows.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select(
        "row", F.lower("s.value").alias("entity"),
        F.concat(_terms(F.col("s.left"), F.col("s.start") - F.length("s.left")), _terms(F.col("s.right"), F.col("s.end"))).alias("terms"))
    near = staged.put(near.select("row", "entity", F.explode_outer("terms").alias("t")).select("row", "entity", "t.term", "t.start", "t.end"), "near")
    total = F.lit(rows.count()).cast("double")
    holders = staged.put(near.select("row", "entity").distinct(), "holders")
    entities = staged.put(holders.groupBy("entity").agg(F.count("*").alias("n_c")), "entities")
    known = staged.put(salted_join(holders, entities, ["entity"], counted=entities.withColumnRenamed("n_c", "n")), "known")
    beside = staged.put(near.where("term IS NOT NULL").select("entity", "term").distinct(), "beside")
    several = known.where("n_c > 1").select("row").distinct()
    held_terms = staged.put(rows.where("held IS NOT NULL").join(several, "row", "left_semi").select("row", F.explode(_distinct_terms("held")).alias("term")),
                            "held-terms")
    asked = staged.put(held_terms.select("term").union(beside.select("term")).distinct(), "asked")
    words = docs.select(F.explode(_distinct_terms("text")).alias("term"))
    with_term = staged.put(words.join(small_side(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")), "with-term")
    within = F.col("n_t") <= F.col("n_c") * F.pow(total / F.col("n_c"), F.lit(1 - DISCLOSED)) * (1 + 1e-9)
    shared = (held_terms.join(with_term, "term").join(known.where("n_c > 1"), "row").where(within)
              .groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t")))
    shared = shared.join(beside.withColumn("beside", F.lit(True)), ["entity", "term"], "left").where("n_ct > 1 OR beside").drop("beside")
    alone = beside.join(entities.where("n_c = 1"), "entity").join(with_term, "term").withColumn("n_ct", F.lit(1).cast("long"))
    told = F.log(total * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    own = F.log(total / F.col("n_c"))
    disclosing = staged.put(shared.unionByName(alone).where((own > 0) & (told >= DISCLOSED * own)).select("entity", "term"), "disclosing")
    telling = staged.put(disclosing.select("term").distinct(), "telling")
    told_at = staged.put(rows.where("held IS NOT NULL").select("row", F.explode(_terms(F.col("held"), F.lit(0))).alias("t")).select("row", "t.*")
                         .join(small_side(telling), "term", "left_semi"), "told-at")
    met = staged.put(told_at.select("row", "term").distinct().join(holders, "row"), "met")
    wanted = salted_join(met, disclosing, ["entity", "term"]).select("row", "term").distinct()
    spans = told_at.join(wanted, ["row", "term"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("terms"))
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(spans, "row", "left").select(
        "doc_id", "row", base.alias("base"), F.coalesce(apart, F.array().cast("array<struct<start:int,end:int>>")).alias("terms"))


def span_text(spans: Column, name) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_name(span: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), span["kind"])


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text with its spans replaced by <kind>; spans that overlap are replaced as one, by the first's kind."""
    staged = Staged(docs.sparkSession)
    source = staged.put(docs.select("doc_id", "text"), "sanitise")
    numbered = staged.put(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = find(numbered.select(F.col("row").alias("doc_id"), "text"))
    marks = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind_name(s).alias("kind"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("term").alias("kind")))))
    spans = found.select(F.col("doc_id").alias("row"), marks.alias("marks")).where(F.size("marks") > 0)
    text = F.col("text")

    def step(s: Column, m: Column) -> Column:
        apart = F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit("<"), m["kind"], F.lit(">"))
        return F.struct(F.when(m["start"] >= s["at"], apart).otherwise(s["out"]).alias("out"), F.greatest(s["at"], m["end"]).alias("at"))

    clean = F.aggregate("marks", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return numbered.join(spans, "row", "left").select("doc_id", F.when(F.col("marks").isNull(), text).otherwise(clean).alias("text"))
