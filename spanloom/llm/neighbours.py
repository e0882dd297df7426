"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node.  The first graph comes from several random partitions: signs
of random projections, then a hash, give blocks of bounded size, and each vector takes
the best of its blocks.  Then it is improved in rounds: each node joins its neighbours,
both ways, with their vectors, compares these neighbours of neighbours with each other,
and tells every one of them which others are nearer than the worst it has, until few lists
change.  A query starts at its own node and walks greedily: in a round it opens the
unopened nodes of its beam and looks at all their neighbours, until all queries have opened
their whole beam.  The best of what it has seen are measured again on
the original vectors in double precision.

Graph work uses half-precision copies of the unit vectors; groups are bounded by block
size, list length and beam, so no hub or block fills a task.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; vectors are compared with those of their own length only; of rows with the same
vec_id the first by vector counts; fewer than five candidates give fewer rows; an empty
table gives no rows; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import stored

# Neighbours kept by a node, neighbours that lead to it considered beside them, random partitions for the first
# graph, vectors in a block, and finds that a node passes on for each neighbour in a round.
DEGREE, BACK, PARTITIONS, BLOCK, TELL = 32, 16, 10, 2_048, 8
# Rounds end when one has changed no more than this share of all list entries.
DELTA = 0.001
# Best nodes that a search must have opened when it ends, and finds measured exactly.
BEAM, MEASURED = 96, 24
EVERY, NEAREST = 50, 5


def top(name: str, by: list[Column], n: int, rows: DataFrame) -> DataFrame:
    """The first n rows of each ``name``; most are dropped where they lie, before they are sent."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*by))).where(
        F.col("_n") <= n).drop("_n")


def usable(vectors: DataFrame) -> DataFrame:
    """id, raw (array of doubles) of the vectors that take part."""
    raw = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), raw.alias("raw")).where(
        F.col("id").isNotNull() & F.col("raw").isNotNull())
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("raw", lambda x: x != 0.0)).groupBy("id").agg(F.min("raw").alias("raw"))


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("raw").to_pylist()
        out = []
        for values in raw:
            v = np.array(values, float)
            v = v / np.abs(v).max()  # so that no square overflows
            out.append((v / np.linalg.norm(v)).astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(r) for r in raw], pa.int32()),
                                          pa.array(out, pa.binary())], ["id", "dim", "v"])


def matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f2").reshape(-1, dim).astype(np.float32)


def best_of(scores: np.ndarray, n: int) -> np.ndarray:
    n = min(n, scores.shape[1])
    return np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.broadcast_to(
        np.arange(n), (len(scores), n))


# -- the first graph -------------------------------------------------------------------------------

def first_lists(units: DataFrame, n: int, degree: int, partitions: int, block: int) -> DataFrame:
    """id, near, score: each vector's best in every random partition, one row a partition."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / block))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            codes = np.zeros((partitions, len(dims)), np.int64)
            values = batch.column("v").to_pylist()
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((dim, partitions * max(bits, 1)))
                rows = np.flatnonzero(dims == dim)
                signs = (matrix([values[r] for r in rows], int(dim)) @ planes[dim]).reshape(
                    len(rows), partitions, -1)[:, :, :bits] > 0
                codes[:, rows] = (signs @ (1 << np.arange(bits, dtype=np.int64))).T
            for p in range(partitions):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("dim"), batch.column("v"),
                     pa.array(np.full(len(dims), p), pa.int32()), pa.array(codes[p])], ["id", "dim", "v", "p", "code"])

    dealt = units.mapInArrow(deal, "id long, dim int, v binary, p int, code long")
    key = ["dim", "p", "code"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # A block that is too large is split by a hash, another one in each partition.
    parted = dealt.join(sizes, key).withColumn(
        "part", F.pmod(F.xxhash64("id", "p"), F.ceil(F.col("n") / (2 * block))))

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["id"].to_numpy(), matrix(rows["v"], int(rows["dim"].iloc[0]))
        near, scores = [], []
        for k in range(0, len(ids), 1024):
            s = x[k : k + 1024] @ x.T
            s[np.arange(len(s)), k + np.arange(len(s))] = -9
            at = best_of(s, degree)
            got = np.take_along_axis(s, at, 1)
            for a, g in zip(at, got, strict=True):
                near.append(ids[a[g > -9]])
                scores.append(g[g > -9])
        return pd.DataFrame({"id": ids, "near": near, "score": scores})

    return parted.groupBy(*key, "part").applyInPandas(within, "id long, near array<long>, score array<float>")


def joined_lists(lists: DataFrame, degree: int) -> DataFrame:
    """id, near, score: of several lists of a node the best ``degree``, the best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, scores = [], []
            for lists_near, lists_score in zip(batch.column("nears").to_pylist(), batch.column("scores").to_pylist(),
                                               strict=True):
                ids = np.array([x for y in lists_near for x in y], np.int64)
                got = np.array([x for y in lists_score for x in y], np.float32)
                ids, first = np.unique(ids, return_index=True)
                order = np.lexsort((ids, -got[first]))[:degree]
                near.append(ids[order])
                scores.append(got[first][order])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32()))],
                ["id", "near", "score"])

    return lists.groupBy("id").agg(F.collect_list("near").alias("nears"), F.collect_list("score").alias("scores")).mapInArrow(
        run, "id long, near array<long>, score array<float>")


# -- rounds of NN-descent --------------------------------------------------------------------------

def both_ways(graph: DataFrame, degree: int, back: int) -> DataFrame:
    """u, w, score: a node's neighbours, and the best that have it as theirs, each once."""
    out = graph.select(F.col("id").alias("u"), F.explode(F.arrays_zip("near", "score")).alias("x")).select(
        "u", F.col("x.near").alias("w"), F.col("x.score").alias("score"))
    into = top("u", [F.desc("score"), F.col("w")], back, out.select(F.col("w").alias("u"), F.col("u").alias("w"), "score"))
    return out.unionByName(into).groupBy("u", "w").agg(F.max("score").alias("score"))


def told(edges: DataFrame, graph: DataFrame, units: DataFrame, degree: int, tell: int) -> DataFrame:
    """id, near, score of the finds that neighbours of a node pass on to each other."""
    worst = graph.select("id", F.when(F.size("score") < degree, F.lit(-9.0)).otherwise(F.array_min("score")).cast(
        "float").alias("worst"))
    ends = units.select(F.col("id").alias("w"), "dim", "v").join(worst.withColumnRenamed("id", "w"), "w")
    groups = edges.select("u", "w").join(ends, "w").groupBy("u", "dim").agg(
        F.collect_list(F.struct("w", "worst", "v")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                dims = np.array(batch.column("dim").to_pylist())
                lists = batch.column("x")
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                ids, least = flat.field("w").to_numpy(), flat.field("worst").to_numpy()
                values, start = flat.field("v").to_pylist(), np.cumsum(sizes) - sizes
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    size = sizes[rows]
                    m = int(size.max())
                    inside = np.arange(m) < size[:, None]
                    at = np.where(inside, start[rows][:, None] + np.arange(m), 0)
                    x = matrix([values[a] for a in at[inside]], int(dim))
                    cube = np.zeros((len(rows), m, int(dim)), np.float32)
                    cube[inside] = x
                    s = cube @ cube.transpose(0, 2, 1)
                    s[~(inside[:, :, None] & inside[:, None, :])] = -9
                    s[:, np.arange(m), np.arange(m)] = -9
                    s[s <= least[at][:, :, None]] = -9
                    n = min(tell, m)
                    best = np.argpartition(-s, n - 1, axis=2)[:, :, :n]
                    got = np.take_along_axis(s, best, 2)
                    good = got > -9
                    to = np.broadcast_to(ids[at][:, :, None], got.shape)[good]
                    found = ids[np.take_along_axis(np.broadcast_to(at[:, None, :], s.shape), best, 2)[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(found), pa.array(got[good])],
                                                     ["id", "near", "score"])

    finds = groups.mapInArrow(run, "id long, near long, score float").groupBy("id", "near").agg(
        F.max("score").alias("score"))
    return top("id", [F.desc("score"), F.col("near")], degree, finds).groupBy("id").agg(
        F.collect_list("near").alias("near"), F.collect_list("score").alias("score"))


def changed_share(before: DataFrame, after: DataFrame) -> float:
    """Share of the list entries that were not there before."""
    both = after.select("id", "near").join(before.select("id", F.col("near").alias("old")), "id")
    new, every = both.agg(F.sum(F.size(F.array_except("near", "old"))), F.sum(F.size("near"))).first()
    return new / every if every else 0.0


def build_graph(units: DataFrame, degree: int = DEGREE, back: int = BACK, partitions: int = PARTITIONS,
                block: int = BLOCK, rounds: int | None = None, tell: int = TELL, delta: float = DELTA) -> DataFrame:
    """id, near, score of every node; None rounds: until few entries change, which ends since lists only get better."""
    graph = stored(joined_lists(first_lists(units, units.count(), degree, partitions, block), degree), "graph")
    for _ in itertools.count() if rounds is None else range(rounds):
        finds = told(both_ways(graph, degree, back), graph, units, degree, tell)
        before, graph = graph, stored(joined_lists(graph.unionByName(finds), degree), "graph")
        if changed_share(before, graph) <= delta:
            break
    return graph


# -- search ----------------------------------------------------------------------------------------

def unopened(beam: int) -> Column:
    return F.array_except(F.slice("seen", 1, beam), "done")


def opened(states: DataFrame, neighbours: DataFrame, units: DataFrame, beam: int, keep: int) -> DataFrame:
    """One step of every search: q, dim, qv, seen, scores (the best ``keep`` first), done (opened ones)."""
    ahead = states.select("q", F.explode(unopened(beam)).alias("u"))
    met = ahead.join(neighbours, "u").select("q", F.explode("around").alias("c")).where("c <> q").distinct()
    found = met.join(units.select(F.col("id").alias("c"), "v"), "c").groupBy("q").agg(
        F.collect_list(F.struct("c", "v")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                seen_all, score_all, done_all = [], [], []
                for row in batch.to_pylist():
                    q = matrix([row["qv"]], row["dim"])[0]
                    old = dict(zip(row["seen"], row["scores"], strict=True))
                    if row["x"]:
                        new = matrix([y["v"] for y in row["x"]], row["dim"]) @ q
                        for y, s in zip(row["x"], new.tolist(), strict=True):
                            old[y["c"]] = s
                    done = set(row["done"])
                    before = [c for c in row["seen"][:beam] if c not in done]
                    order = sorted(old, key=lambda c: (-old[c], c))[:keep]
                    seen_all.append(order)
                    score_all.append([old[c] for c in order])
                    done_all.append(row["done"] + before)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q"), batch.column("dim"), batch.column("qv"), pa.array(seen_all, pa.list_(pa.int64())),
                     pa.array(score_all, pa.list_(pa.float32())), pa.array(done_all, pa.list_(pa.int64()))],
                    ["q", "dim", "qv", "seen", "scores", "done"])

    return states.join(found, "q", "left").mapInArrow(
        run, "q long, dim int, qv binary, seen array<long>, scores array<float>, done array<long>")


def search(queries: DataFrame, graph: DataFrame, units: DataFrame, beam: int = BEAM,
           measured: int = MEASURED, back: int = BACK) -> DataFrame:
    """q, c: the best ``measured`` nodes that each query (a node's id) comes upon, itself not among them."""
    neighbours = stored(both_ways(graph, 0, back).groupBy("u").agg(F.collect_list("w").alias("around")), "around")
    states = queries.select(F.col("id").alias("q")).join(units.select(
        F.col("id").alias("q"), "dim", F.col("v").alias("qv")), "q").join(
        graph.select(F.col("id").alias("q"), F.col("near").alias("seen"), F.col("score").alias("scores")), "q").select(
        "q", "dim", "qv", "seen", "scores", F.array().cast("array<long>").alias("done"))
    while states.where(F.size(unopened(beam)) > 0).limit(1).count():
        states = stored(opened(states, neighbours, units, beam, 4 * beam), "search")
    return states.select("q", F.explode(F.slice("seen", 1, measured)).alias("c"))


def cosine(a: pa.Array, b: pa.Array) -> list[float]:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        u, v = np.array(x, float), np.array(y, float)
        with np.errstate(over="ignore", invalid="ignore"):
            s = float(u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)))
        if not np.isfinite(s):  # squares out of range
            u, v = u / np.abs(u).max(), v / np.abs(v).max()
            s = float(u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)))
        out.append(s)
    return out


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id ``every`` divides."""
    raw = stored(usable(vectors).withColumn("same", F.xxhash64("raw")), "vectors")
    # A node is the least id of equal vectors; k + 1 of its ids are enough for any query.
    node = raw.groupBy("same", "raw").agg(F.min("id").alias("node"))
    named = stored(raw.select("id", "same", "raw").join(node, ["same", "raw"]).select("id", "node", "raw"), "nodes")
    alone = named.where("id = node")
    units = stored(alone.mapInArrow(unit_rows, "id long, dim int, v binary"), "units")
    members = top("node", [F.col("id")], k + 1, named.select("node", "id"))
    asked = named.where(F.col("id") % every == 0)
    graph = build_graph(units)
    found = search(asked.select(F.col("node").alias("id")).distinct(), graph, units)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("c"), pa.array(cosine(batch.column("a"), batch.column("b")), pa.float64())],
                ["q", "c", "score"])

    mine = alone.select(F.col("id").alias("q"), F.col("raw").alias("a"))
    pairs = found.unionByName(found.select("q", F.col("q").alias("c"))).distinct() \
        .unionByName(asked.select(F.col("node").alias("q"), F.col("node").alias("c"))).distinct() \
        .join(alone.select(F.col("id").alias("c"), F.col("raw").alias("b")), "c").join(mine, "q")
    scored = pairs.select("q", "c", "a", "b").mapInArrow(measure, "q long, c long, score double")
    # The k best nodes hold the k best rows, with the query's own node beside them.
    kept = top("q", [F.desc("score"), F.col("c")], k + 1, scored).withColumnRenamed("c", "node")
    rows = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(kept, "q").join(
        members, "node").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("id"))
    return rows.select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias("vec_id"), "score").where(
        F.col("rank") <= k)
