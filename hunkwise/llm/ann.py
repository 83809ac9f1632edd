"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors form a class and one vector stands for it, so thousands of copies of a vector neither crowd the graph nor hide
their neighbours. Representatives are hashed into shards of about ``SHARD`` vectors (as many shards as that takes). A shard's
graph starts with random edges; then batches of points search it greedily from the shard's entry points, and each point
keeps, of what its search has met, the nearest neighbour, drops every candidate that is ``ALPHA`` times nearer to that
neighbour than to the point, takes the nearest of the rest, and so on: few, diverse edges. Edges get their reverse, and a
point with too many is pruned alike. The finished index is a table.

Every query goes to every shard, in blocks of ``QUERY_BLOCK`` queries, and a beam search there returns the nearest
representatives with distances in double precision; copies are then listed by smallest id, and all shards' answers are ranked.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components, and rows without vec_id,
take no part. Only vectors of a query's length are its candidates. Repeated rows count once; a vec_id with several vectors has
each of them as a query and a candidate, and is never its own candidate. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import Staged

SHARD = 4096
DEGREE, SLACK = 32, 16
BEAM_BUILD, BEAM = 64, 128
ALPHA = 1.2
ENTRIES = 16
BATCH = 256
QUERY_BLOCK = 16_384

_FAR = np.inf
#: The search works on vectors scaled to at most about 1; a query far outside a shard is clipped here, so that no square overflows.
_OUTSIDE = 1e120


def scale_of(x: np.ndarray) -> float:
    """A power of two near the largest component."""
    most = float(np.abs(x).max()) if x.size else 0.0
    return 2.0 ** np.floor(np.log2(most)) if most > 0 else 1.0


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest points met (padded with -1), nearest first, and the points that were expanded."""
    n, m = len(x), len(q)
    rows = np.arange(m)[:, None]
    met = np.zeros((m, n), bool)
    met[:, entries] = True

    def distance(ids: np.ndarray) -> np.ndarray:
        apart = x[ids] - q[:, None]  # differences: a common offset of the vectors does not cancel
        return np.einsum("mkd,mkd->mk", apart, apart)

    ids = np.full((m, beam), -1)
    ids[:, : len(entries)] = entries
    dist = np.full((m, beam), _FAR)
    dist[:, : len(entries)] = distance(ids[:, : len(entries)])
    done = np.zeros((m, beam), bool)
    expanded = []
    while True:
        waiting = np.where(done, _FAR, dist)
        best = waiting.argmin(axis=1)
        live = waiting[np.arange(m), best] < _FAR
        if not live.any():
            break
        point = np.where(live, ids[np.arange(m), best], -1)
        done[np.arange(m)[live], best[live]] = True
        expanded.append(point)
        near = np.where(live[:, None], graph[point], -1)
        fresh = (near >= 0) & ~met[rows, near]
        met[np.broadcast_to(rows, near.shape)[fresh], near[fresh]] = True
        far = np.where(fresh, distance(near), _FAR)
        all_ids, all_dist = np.hstack((ids, near)), np.hstack((dist, far))
        all_done = np.hstack((done, np.zeros(near.shape, bool)))
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = all_ids[rows, order], all_dist[rows, order], all_done[rows, order]
        ids[dist == _FAR] = -1
    return ids, np.column_stack(expanded) if expanded else np.full((m, 1), -1)


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point out of its pool (-1: nothing), padded with -1."""
    pool = np.where(pool == points[:, None], -1, pool)
    order = np.sort(pool, axis=1)
    pool = np.where(np.column_stack((np.zeros(len(pool), bool), order[:, 1:] == order[:, :-1])), -1, order)
    vectors = x[pool] - x[points][:, None]
    squares = (vectors * vectors).sum(axis=2)
    own = np.where(pool < 0, _FAR, squares)
    between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1)
    alive, rows = own.copy(), np.arange(len(points))
    for k in range(degree):
        best = alive.argmin(axis=1)
        ok = alive[rows, best] < _FAR
        if not ok.any():
            break
        out[ok, k] = pool[rows, best][ok]
        alive[(ALPHA * ALPHA) * between[rows, best] <= own] = _FAR
        alive[rows, best] = _FAR
    return out


def build_graph(x: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, entry points) of a shard's vectors."""
    n, width = len(x), DEGREE + SLACK
    rng = np.random.default_rng(seed)
    graph = np.full((n, width), -1)
    if n > 1:
        graph[:, :DEGREE] = rng.integers(0, n, (n, DEGREE))
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    entries = np.unique(np.concatenate(([middle], rng.choice(n, min(n, ENTRIES), replace=False))))
    for part in np.array_split(rng.permutation(n), max(1, -(-n // BATCH))):
        ids, expanded = beam_search(x, graph, entries, x[part], BEAM_BUILD)
        chosen = robust_prune(x, part, np.hstack((ids, expanded, graph[part])), DEGREE)
        graph[part] = -1
        graph[part, :DEGREE] = chosen
        sources, targets = np.repeat(part, DEGREE), chosen.ravel()
        real = targets >= 0
        order = np.argsort(targets[real], kind="stable")
        sources, targets = sources[real][order], targets[real][order]
        names, first, counts = np.unique(targets, return_index=True, return_counts=True)
        full, pools = [], []
        for t, at, k in zip(names, first, counts):
            old = graph[t][graph[t] >= 0]
            both = np.unique(np.concatenate((old, sources[at : at + k])))
            if len(both) <= width:
                graph[t] = -1
                graph[t, : len(both)] = both
            else:
                full.append(t)
                pools.append(both)
        for at in range(0, len(full), BATCH):
            group = pools[at : at + BATCH]
            pool = np.full((len(group), max(map(len, group))), -1)
            for i, p in enumerate(group):
                pool[i, : len(p)] = p
            here = np.array(full[at : at + BATCH])
            graph[here] = -1
            graph[here, :DEGREE] = robust_prune(x, here, pool, DEGREE)
    return graph, entries


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0)


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rep", "cls"], kind="stable").reset_index(drop=True)
    vectors = np.stack(pdf["vector"].to_numpy())
    graph, entries = build_graph(vectors / scale_of(vectors))
    place = pd.Series(range(len(pdf)))
    return pd.DataFrame({"size": pdf["size"], "shard": pdf["shard"], "place": place, "cls": pdf["cls"], "rep": pdf["rep"], "vector": pdf["vector"],
                         "near": [row[row >= 0].tolist() for row in graph], "entry": place.isin(entries)})


def _searcher(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "query": [], "cls": [], "score": []})
        index = index.sort_values("place").reset_index(drop=True)
        x = np.stack(index["vector"].to_numpy())
        graph = np.full((len(x), max(1, index["near"].map(len).max())), -1)
        for i, near in enumerate(index["near"]):
            graph[i, : len(near)] = near
        entries, reps, classes = np.flatnonzero(index["entry"]), index["rep"].to_numpy(), index["cls"].to_numpy()
        scale, beam = scale_of(x), max(BEAM, k, len(entries))
        scaled = x / scale
        out = []
        for at in range(0, len(queries), BATCH):
            part = queries.iloc[at : at + BATCH]
            q = np.stack(part["vector"].to_numpy())
            with np.errstate(over="ignore"):
                ids, _ = beam_search(scaled, graph, entries, np.clip(q / scale, -_OUTSIDE, _OUTSIDE), beam)
            apart = x[ids] - q[:, None]
            score = np.sqrt(np.cumsum(apart * apart, axis=2)[:, :, -1])  # summed from first to last component
            score[ids < 0] = np.inf
            order = np.lexsort((reps[ids], score))[:, :k]
            for i, (qid, number) in enumerate(zip(part["query_id"], part["query"])):
                keep = order[i][score[i][order[i]] < np.inf]
                out.append(pd.DataFrame({"query_id": qid, "query": number, "cls": classes[ids[i][keep]], "score": score[i][keep]}))
        return pd.concat(out)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``vectors`` (vec_id, embedding) that ``is_query``
    marks, among all other rows."""
    staged = Staged(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # a query needs at most k + 1 ids of one vector: the smallest, cut before the shuffle; repeated rows are one id
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    copies = rows.distinct().withColumn("copy", first).where(F.col("copy") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = staged.put(copies.select("vector", F.size("vector").alias("size"), "ids", F.col("ids")[0].alias("rep"))
                         .withColumn("cls", F.monotonically_increasing_id()), "vectors")
    counts = classes.groupBy("size").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = classes.join(F.broadcast(counts), "size").withColumn("shard", F.pmod(F.xxhash64("vector"), "shards").cast("int"))
    index = staged.put(dealt.select("size", "shard", "cls", "rep", "vector").groupBy("size", "shard").applyInPandas(
        _index, "size int, shard int, place int, cls long, rep long, vector array<double>, near array<int>, entry boolean"), "index")

    queries = rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("size"))
    queries = staged.put(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).join(F.broadcast(counts), "size")
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))
    blocked = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ("size", "shard", "block")
    found = blocked.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_searcher(k + 1), "query_id long, query long, cls long, score double")
    members = found.join(classes.select("cls", F.explode("ids").alias("vec_id")), "cls").where("vec_id <> query_id")
    ranked = members.select("query_id", "query", "vec_id", "score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
