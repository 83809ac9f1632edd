"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

Texts with equal shingle sets form a class, found by a 128-bit digest; the rest works on one representative a class. Each
representative gets a sketch of 128 coordinates from rounds of hashed bin placement (``shingles.sketches``), cut into 32
bands of 4. Representatives that share a band are candidates, and a link needs 75 % of the union of the FULL shingle sets,
computed from the whole texts: two sets of exactly that similarity miss all bands once in 200,000 pairs.

Buckets of any size are resolved without emitting all their pairs. First each bucket's smallest member is compared with the
others. Components of the links so far then tell which buckets still hold members of different components: near copies
are one component by now, and what is left are mostly texts that share a common passage but are not alike enough. Those
go through an exact prefix filter: with each set's shingles in one order, commonest last, two sets can only link if they share
a shingle among the first n - ceil(6n/7) + 1 of the smaller and the first n - ceil(3n/4) + 1 of the larger set, which a
common passage does not reach. The order comes from a histogram of all their shingles over 2^20 cells, so its size is fixed. Each
shared prefix shingle is a bucket; rounds compare a few of its members with the rest, eight times as many each round, from the
smallest components first and only where the shingle stands early enough for the sizes of both, until what is left of every bucket is in one component. So no pair is skipped unless it
cannot link or is already connected. Comparisons with a centre are dealt out in blocks, so a centre of many members is no
single task.

Defined results: null and wordless texts have no shingles and link with nothing. Rows that share a doc_id are one
document: what links to one of them links to all. Rows without doc_id link with nothing (component_id null, kept true).
Columns other than doc_id and text are not read; ``drop_near_duplicates`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm import shingles
from hunkwise.llm.common import Staged, small_side
from hunkwise.llm.components import components

COORDINATES, BANDS = 128, 32
#: A link: 100 * intersection >= 75 * union.
SHARE = 75
#: Members compared with one centre in one block.
BLOCK = 64

_SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
        for at, part in shingles.chunks(texts):
            sets = shingles.shingle_sets(part)
            keys = shingles.band_keys(shingles.sketches(sets, COORDINATES), BANDS)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                ids.slice(at, len(part)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, full)], pa.binary()),
                pa.array([k if ok else None for k, ok in zip(keys, full)], pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "digest", "bands"])


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) for every row; digest and bands are null where there is no shingle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_sketch_batches, _SKETCH)


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, block, b, text) by (a, block), the centre's own texts (b null) first: the links of each block."""
    key, centres = None, []
    for batch in batches:
        a, block, b = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3).cast(pa.large_binary()).to_pylist()
        found = []
        for at, part in shingles.chunks(texts):
            for i, own in enumerate(shingles.shingle_sets(part), at):
                if key != (a[i], block[i]):
                    key, centres = (a[i], block[i]), []
                if b[i] is None:
                    centres.append(own)
                    continue
                for centre in centres:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    if both and 100 * both >= SHARE * (len(own) + len(centre) - both):
                        found.append((a[i], b[i]))
                        break
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                                         names=["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a centre, b) whose full sets are similar enough."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block"))
    own = degree.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    left = own.join(texts, own.a == texts.doc_id).select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    right = dealt.join(texts, dealt.b == texts.doc_id).select("a", "block", "b", "text")
    rows = left.union(right).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare_batches, "a long, b long").distinct()


def _can_link(n: str, m: str) -> Column:
    """Sizes that a link allows: the smaller set is at least 75 % of the larger."""
    return 100 * F.least(n, m) >= SHARE * F.greatest(n, m)


def _first_round(members: DataFrame) -> DataFrame:
    centre = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"))
    return (members.join(centre, "key").where((F.col("rep") != F.col("c.rep")) & _can_link("n", "c.n"))
            .select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct())


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.withColumnRenamed("node", "rep")
    return members.drop("root").join(known, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _open_members(members: DataFrame) -> DataFrame:
    """The members of buckets that hold different components, and one that may be a centre."""
    found = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("leads").alias("leads"))
    return members.join(found.where("lo <> hi AND leads").select("key"), "key", "left_semi")


def _centres(members: DataFrame, many: int) -> DataFrame:
    """(key, centre, centre_n, centre_root): up to ``many`` leading members a bucket, from its smallest components."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("size"))
    by_size = Window.partitionBy("key").orderBy("size", "rep")
    ranked = members.where("leads").join(sizes, ["key", "root"]).withColumn("place", F.row_number().over(by_size))
    return ranked.where(F.col("place") <= many).select(
        "key", F.col("rep").alias("centre"), F.col("n").alias("centre_n"), F.col("at").alias("centre_at"), F.col("root").alias("centre_root"))


def _may_share_enough() -> Column:
    """A link of sets of n and m needs ceil(3 (n + m) / 7) common shingles, so its first one stands early enough in both."""
    needed = F.expr("(3 * (n + centre_n) + 6) div 7")
    return (F.col("at") + needed <= F.col("n") + 1) & (F.col("centre_at") + needed <= F.col("centre_n") + 1)


#: Cells of the histogram that orders shingles.
CELLS = 1 << 20


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, part in shingles.chunks(batch.column(0).cast(pa.large_binary()).to_pylist()):
            for own in shingles.shingle_sets(part):
                np.add.at(counts, (own & np.uint64(CELLS - 1)).astype(np.int64), 1)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], names=["cell", "n"])


def _prefixes(texts: DataFrame) -> DataFrame:
    """(key, rep, n, at, leads): the prefix shingles of each text with their place (from 1); leads where the text may be the
    smaller of a pair."""
    seen = texts.select("text").mapInArrow(_count_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[seen["cell"].to_numpy()] = seen["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_pylist()
            for at, part in shingles.chunks(batch.column(1).cast(pa.large_binary()).to_pylist()):
                keys, owners, sizes, places, leads = [np.zeros(0, np.uint64)], [], [], [], []
                for rep, own in zip(reps[at:], shingles.shingle_sets(part)):
                    n = len(own)
                    order = np.lexsort((own, sent.value[(own & np.uint64(CELLS - 1)).astype(np.int64)]))
                    reach = n + (-SHARE * n // 100) + 1 if n else 0
                    keys.append(own[order[:reach]])
                    owners += [rep] * reach
                    sizes += [n] * reach
                    places += range(1, reach + 1)
                    leads += [k < n + (-2 * SHARE * n // (100 + SHARE)) + 1 for k in range(reach)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64()),
                                                  pa.array(places, pa.int64()), pa.array(leads, pa.bool_())], names=["key", "rep", "n", "at", "leads"])

    return texts.select("doc_id", "text").mapInArrow(run, "key long, rep long, n long, at long, leads boolean")


def near_duplicates(docs: DataFrame, stays: Staged | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    spark = docs.sparkSession
    staged = stays or Staged(spark)
    rows = staged.put(sketch(docs), "sketch")
    classes = staged.put(
        rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes")
    bucketed = classes.select(F.explode("bands").alias("key"), "rep", "n")
    shared = bucketed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    members = staged.put(bucketed.join(shared, "key").select("key", "rep", "n").distinct(), "members")
    wanted = staged.put(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    texts = staged.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                       .join(small_side(wanted), "doc_id", "left_semi"), "texts")
    staged.drop(wanted)

    # one doc_id in several classes: its classes are one document
    repeated = staged.put(rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    same = (rows.join(small_side(repeated), "doc_id", "left_semi").where("digest IS NOT NULL")
            .join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))

    pairs = staged.put(_first_round(members), "pairs")
    links = staged.put(_links(pairs, texts).union(same), "links")
    checked = [pairs]
    roots = components(links, staged)
    # the first centre of each bucket has been compared with all of it
    firsts = members.groupBy("key").agg(F.min("rep").alias("rep"))
    rest = _with_roots(members, roots).join(firsts, ["key", "rep"], "left_anti").withColumn("leads", F.lit(True))
    rest = staged.put(_open_members(rest).select(F.col("rep").alias("doc_id")).distinct(), "rest")
    left = staged.put(texts.join(small_side(rest), "doc_id", "left_semi"), "left")
    prefixes = staged.put(_prefixes(left), "prefixes")
    fresh = staged.put(_open_members(_with_roots(prefixes, roots)), "members")
    staged.drop(members, prefixes, rest)
    members, many = fresh, 8
    while members.head(1):
        centres = staged.put(_centres(members, many), "centres")
        new = (members.join(centres, "key").where((F.col("root") != F.col("centre_root")) & _may_share_enough())
               .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
        for old in checked:
            new = new.join(old.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        pairs = staged.put(new, "pairs")
        checked.append(pairs)
        found = staged.put(links.union(_links(pairs, left)), "links")
        staged.drop(links, roots)
        links = found
        roots = components(links, staged)
        after = _with_roots(members.join(centres.select("key", F.col("centre").alias("rep")), ["key", "rep"], "left_anti"), roots)
        fresh = staged.put(_open_members(after), "members")
        staged.drop(members, centres)
        members, many = fresh, many * 8
    staged.drop(texts, left, members, links, *checked)

    top = classes.join(roots, classes.rep == roots.node, "left").select("digest", F.coalesce("root", "rep").alias("component"))
    alone = roots.select(F.col("node").alias("doc_id"), "root")
    out = rows.select("doc_id", "n_shingles", "digest").join(top, "digest", "left")
    out = out.join(repeated.join(alone, "doc_id"), "doc_id", "left")  # documents of several classes
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group, all columns kept; of rows that share a doc_id one
    stays. Rows without doc_id stay."""
    spark = docs.sparkSession
    staged = Staged(spark)
    work = Staged(spark)
    found = staged.put(near_duplicates(docs, work).select("doc_id", "kept"), "kept")
    work.clear()
    gone = staged.put(found.where("NOT kept").select("doc_id").distinct(), "gone")
    repeated = staged.put(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    left = docs.join(small_side(gone), "doc_id", "left_anti")
    twice = small_side(repeated)
    if not repeated.head(1):
        return left.select(docs.columns)
    once = left.join(twice, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
