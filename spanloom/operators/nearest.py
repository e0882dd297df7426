"""Exact nearest neighbours among earlier frames of the same recording.

Vectors are taken as unit vectors, where half the squared straight distance is a lower
bound of the cosine distance, so the triangle inequality can rule out whole tiles:

1. A recording with more rows than a tile holds gets pivots: of a bounded sample, the ones
   farthest from each other.  Every entry belongs to the cell of its nearest pivot, and a
   cell is cut along the frames into tiles of ``tile_rows`` rows (a frame stays whole).  A
   tile's summary is its pivot, the least and greatest distance to it, and its first frame.
2. A query first meets the two latest tiles of the nearest cell that has earlier frames.
   Its k-th distance there bounds what is left to find.
3. From the summaries follow the tiles that may hold something nearer, and only these are
   met: a query at distance d of a pivot whose tile spans [lo, hi] is at least d - hi and
   lo - d away, and the plane between two pivots gives another bound.

Queries of one first tile, and of the next ones, travel together, ``ASKED`` to ``ASKED_MOST`` in a part.  Which of
a part's queries need a tile is one bit each, and the tiles of a part come in chunks of at most about
``HELD_MOST`` entries, so vectors are copied once a part and once a chunk, never once a query and tile.  How much
pruning saves depends on the data: vectors that repeat few objects need few tiles, vectors without any structure
need all, since the answer is exact.  A recording of one tile has one step only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.vectors import NORM_FLOOR
from spanloom.operators.prefix import prefix_sum
from spanloom.session import scratch_dir

# Distances are compared at this precision, so rounding noise never orders ties.
DISTANCE_DIGITS = 9
# Entries of a tile, queries that meet it together, rows multiplied at a time.
TILE_ROWS, ASKED, BLOCK_ROWS = 4096, 8192, 1024
# A recording's queries make up to PARTS groups of at least ASKED, then larger ones; so do entries in CHUNKS of HELD.
PARTS, ASKED_MOST, CHUNKS, HELD, HELD_MOST = 24, 65_536, 8, 4096, 65_536
# Found rows that wait before they are reduced to the k nearest, pairs whose vectors are multiplied one by one.
WAITING, SINGLE = 1 << 18, 1 << 16
# Pivots of a recording, rows of the sample they come from, rows compared with them in one task.
PIVOTS, SAMPLE, ROUTED = 256, 2048, 16_384
# Pairs of a query and a tile that one task of the routing looks at.
LOOKED = 1 << 22
# Latest tiles of the nearest cell that a query meets first.
FIRST = 2
# What rounding may add to a bound.
SLACK = 1e-7

KEY = "analysis_id"


def unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.vstack(vectors.to_numpy()).astype(np.float64)
    return matrix / np.clip(np.linalg.norm(matrix, axis=1, keepdims=True), NORM_FLOOR, None)


def straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances of rows of ``a`` from rows of ``b``."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def best_rows(distance: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's columns are its k least, equal ones in their order; infinite ones never."""
    cut = min(k, distance.shape[1]) - 1
    worst = np.partition(distance, cut, axis=1)[:, cut, None]
    nearer, equal = distance < worst, distance == worst
    places = cut + 1 - nearer.sum(axis=1, keepdims=True)
    return (nearer | (equal & (equal.cumsum(axis=1) <= places))) & np.isfinite(distance)


def _sorted_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join by sorting.  Written rows would be judged by the size of their file, a small part of their own, and be
    broadcast through the driver whole."""
    return left.join(right.hint("merge"), on, how)


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# -- meeting a tile ----------------------------------------------------------------

def _meet(asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Each asked row (KEY, tile, part, q, frame, v) with its k nearest of that tile."""
    pairs = asked.select(KEY, "tile", "part").distinct()
    known = entries.select(F.col(KEY).alias("e_key"), F.col("tile").alias("e_tile"), F.col("frame").alias("e_frame"),
                           F.col("class_id").alias("e_id"), F.col("v").alias("e_v"))
    known = _sorted_join(known, pairs, (F.col("e_key") == F.col(KEY)) & (F.col("e_tile") == F.col("tile"))).select(
        "e_key", "e_tile", "e_frame", "e_id", "e_v", F.col("part").alias("e_part"))
    schema = f"q long, frame long, class_id {entries.schema['class_id'].dataType.simpleString()}, distance double"

    def compare(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or held.empty:
            return pd.DataFrame(columns=["q", "frame", "class_id", "distance"])
        held = held.sort_values(["e_frame", "e_id"])
        frames, ids, vectors = held["e_frame"].to_numpy(), held["e_id"].to_numpy(), unit(held["e_v"]).T
        blocks = []
        for first in range(0, len(asks), BLOCK_ROWS):
            some = asks.iloc[first : first + BLOCK_ROWS]
            distance = np.round(np.maximum(1.0 - unit(some["v"]) @ vectors, 0.0), DISTANCE_DIGITS)
            distance[frames[None, :] >= some["frame"].to_numpy()[:, None]] = np.inf
            rows, cols = np.nonzero(best_rows(distance, k))
            blocks.append(pd.DataFrame({"q": some["q"].to_numpy()[rows], "frame": frames[cols], "class_id": ids[cols],
                                        "distance": distance[rows, cols]}))
        return pd.concat(blocks)

    return asked.groupBy(KEY, "tile", "part").cogroup(known.groupBy("e_key", "e_tile", "e_part")).applyInPandas(
        compare, schema)


def _least(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "frame", "class_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# -- pivots, cells and tiles ---------------------------------------------------------

def _pivots(rows: DataFrame, sizes: DataFrame, tile_rows: int) -> DataFrame:
    """KEY, pivots (arrays of doubles): of a sample by hash, greedily the ones farthest from those chosen."""
    by_hash = Window.partitionBy(KEY).orderBy(F.xxhash64("frame", "class_id"), "frame", "class_id")
    sample = rows.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= SAMPLE)
    kind = rows.schema[KEY].dataType.simpleString()

    def choose(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        vectors = unit(some.sort_values("n")["v"])
        wanted = int(min(PIVOTS, -(-int(some["size"].iloc[0]) // tile_rows), len(vectors)))
        chosen, far = [0], straight(vectors, vectors[:1])[:, 0]
        while len(chosen) < wanted and far.max() > SLACK:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, straight(vectors, vectors[chosen[-1:]])[:, 0])
        return pd.DataFrame({KEY: [key[0]], "pivots": [[v.tolist() for v in vectors[chosen]]]})

    return _sorted_join(sample, sizes, KEY).select(KEY, "n", "size", "v").groupBy(KEY).applyInPandas(
        choose, f"{KEY} {kind}, pivots array<array<double>>")


def _by_pieces(rows: DataFrame, pieces: Column, per_key: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on bounded pieces of a recording's rows, each beside the recording's one row of ``per_key``."""
    dealt = rows.withColumn("piece", pieces)
    there = dealt.select(KEY, "piece").distinct().withColumnRenamed(KEY, "p_key").withColumnRenamed("piece", "p_piece")
    beside = _sorted_join(there, per_key.withColumnRenamed(KEY, "k_key"), F.col("p_key") == F.col("k_key")).drop("k_key")
    return dealt.groupBy(KEY, "piece").cogroup(beside.groupBy("p_key", "p_piece")).applyInPandas(work, schema)


def _tiled(rows: DataFrame, sizes: DataFrame, pivots: DataFrame, tile_rows: int) -> DataFrame:
    """Entries with cell, tile and distance to the cell's pivot."""
    kind, of = rows.schema[KEY].dataType.simpleString(), rows.schema["class_id"].dataType.simpleString()

    def nearest_pivot(some: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        distance = straight(unit(some["v"]), np.vstack(beside["pivots"].iloc[0]))
        cell = distance.argmin(axis=1)
        return some.drop(columns=["piece", "size"]).assign(cell=cell, far=distance[np.arange(len(cell)), cell])

    piece = F.pmod(F.xxhash64("frame", "class_id"), F.ceil(F.col("size") / ROUTED))
    celled = _written(_by_pieces(_sorted_join(rows, sizes, KEY), piece, pivots, nearest_pivot,
                                 f"{KEY} {kind}, frame long, class_id {of}, v array<float>, cell long, far double"), "cells")
    counts = celled.groupBy(KEY, "cell", "frame").agg(F.count(F.lit(1)).alias("n"))
    slabs = prefix_sum(counts, [KEY, "cell"], "frame", "n", "before").select(
        KEY, "cell", "frame", F.floor(F.col("before") / tile_rows).cast("long").alias("slab"))
    return _sorted_join(celled, slabs, [KEY, "cell", "frame"]).withColumn(
        "tile", F.col("cell") * F.lit(1 << 40) + F.col("slab")).drop("slab")


def _summaries(tiled: DataFrame, pivots: DataFrame) -> DataFrame:
    """One row a recording: its pivots, and the tiles as (first frame, tile, cell, lo, hi, entries)."""
    tiles = tiled.groupBy(KEY, "tile", "cell").agg(F.min("frame").alias("first"), F.min("far").alias("lo"),
                                                   F.max("far").alias("hi"), F.count(F.lit(1)).alias("n"))
    listed = tiles.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("first", "tile", "cell", "lo", "hi", "n"))).alias("tiles"))
    return _sorted_join(listed, pivots, KEY)


class Summary:
    """The tiles of one recording, by first frame, as arrays."""

    def __init__(self, beside: pd.DataFrame) -> None:
        tiles = pd.DataFrame([dict(t) if isinstance(t, dict) else t.asDict() for t in beside["tiles"].iloc[0]])
        self.first, self.tile, self.cell, self.n = (tiles[c].to_numpy(np.int64) for c in ("first", "tile", "cell", "n"))
        self.lo, self.hi = tiles["lo"].to_numpy(), tiles["hi"].to_numpy()
        self.pivots = np.vstack(beside["pivots"].iloc[0])
        self.between = straight(self.pivots, self.pivots)

    def first_tiles(self, far: np.ndarray, frame: np.ndarray) -> list[np.ndarray]:
        """Per query the places of the latest FIRST tiles of its nearest cell with earlier frames."""
        began = np.full(far.shape[1], np.iinfo(np.int64).max)
        np.minimum.at(began, self.cell, self.first)
        open_ = np.where(began[None, :] < frame[:, None], far, np.inf)
        home = open_.argmin(axis=1)
        of_cell = {c: np.flatnonzero(self.cell == c) for c in np.unique(home)}
        out = []
        for q, c in enumerate(home):
            if not np.isfinite(open_[q, c]):
                out.append(np.empty(0, np.int64))
                continue
            mine = of_cell[c]
            out.append(mine[: np.searchsorted(self.first[mine], frame[q])][-FIRST:])
        return out

    def may_hold(self, far: np.ndarray, frame: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """queries x tiles: whether a tile may hold an earlier entry within the bound (a cosine distance)."""
        own = far.argmin(axis=1)
        nearest = far[np.arange(len(own)), own]
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > SLACK, (far**2 - nearest[:, None] ** 2) / (2 * apart), 0.0)
        to = far[:, self.cell]
        least = np.maximum(np.maximum(to - self.hi, self.lo - to), plane[:, self.cell])
        least = np.maximum(least - SLACK, 0.0)
        return (least**2 / 2 <= bound[:, None] + SLACK) & (self.first[None, :] < frame[:, None])


def _routes(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """KEY, q, tile, home of ``rows`` (KEY, q, frame, v): the first tiles to meet."""
    kind = rows.schema[KEY].dataType.simpleString()

    def route(some: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        if some.empty or beside.empty:
            return pd.DataFrame(columns=[KEY, "q", "tile", "home"])
        summary = Summary(beside)
        out = []
        for start in range(0, len(some), BLOCK_ROWS):
            part = some.iloc[start : start + BLOCK_ROWS]
            first = summary.first_tiles(straight(unit(part["v"]), summary.pivots), part["frame"].to_numpy())
            rows_, cols = np.repeat(np.arange(len(part)), [len(f) for f in first]), np.concatenate(first)
            homes = np.array([summary.tile[f[-1]] if len(f) else -1 for f in first], np.int64)
            out.append(pd.DataFrame({KEY: part[KEY].to_numpy()[rows_], "q": part["q"].to_numpy()[rows_],
                                     "tile": summary.tile[cols.astype(np.int64)], "home": homes[rows_]}))
        return pd.concat(out)

    asked = _sorted_join(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("asked")), summaries.select(KEY), KEY)
    dealt = _sorted_join(rows, asked.select(KEY, F.ceil(F.col("asked") / ROUTED).alias("pieces")), KEY)
    return _by_pieces(dealt, F.pmod(F.xxhash64("q"), F.col("pieces")), summaries, route,
                      f"{KEY} {kind}, q long, tile long, home long")


def _grouped(met: DataFrame) -> DataFrame:
    """With ``part``: queries of one first tile together, with those of the next first tiles while they are fewer than
    ASKED (more in a recording of very many), so a tile goes to no more groups than that takes."""
    sizes = met.groupBy(KEY, "home").agg(F.count_distinct("q").alias("n"))
    totals = sizes.groupBy(KEY).agg(F.sum("n").alias("total"))
    wide = F.greatest(F.lit(ASKED), F.least(F.lit(ASKED_MOST), F.ceil(F.col("total") / PARTS)))
    placed = _sorted_join(prefix_sum(sizes, [KEY], "home", "n", "before"), totals.select(KEY, wide.alias("wide")), KEY).withColumn(
        "parts", F.ceil(F.col("n") / F.col("wide")))
    of = F.when(F.col("parts") > 1, F.concat_ws(":", F.lit("home"), "home", F.pmod(F.xxhash64("q"), F.col("parts")).cast("string")))
    part = F.coalesce(of, F.floor(F.col("before") / F.col("wide")).cast("string"))
    return _sorted_join(met, placed.select(KEY, "home", "before", "wide", "parts"), [KEY, "home"]).withColumn("part", part).drop(
        "home", "before", "wide", "parts")


def _looking(met: DataFrame, plain: DataFrame) -> DataFrame:
    """What meets a tile, with the query's frame and vector."""
    return _sorted_join(met, plain.select("q", "frame", "v"), "q")


# -- meeting all other tiles that may hold more ----------------------------------------

def _wanted(asking: DataFrame, summaries: DataFrame) -> DataFrame:
    """KEY, part, tile, chunk, who: the tiles that some of a part's queries still need, and these queries as bits in the order of q.

    However many tiles a recording has, about ``LOOKED`` pairs are looked at together.
    """
    kind = asking.schema[KEY].dataType.simpleString()

    def look(some: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        if some.empty or beside.empty:
            return pd.DataFrame(columns=[KEY, "part", "tile", "chunk", "who"])
        summary, some = Summary(beside), some.sort_values("q")
        place = pd.Series(np.arange(len(summary.tile)), summary.tile)
        # Whole bytes.
        block = max(8, min(BLOCK_ROWS, LOOKED // 4 // len(summary.tile)) // 8 * 8)
        bits = []
        for start in range(0, len(some), block):
            part = some.iloc[start : start + block]
            chosen = summary.may_hold(straight(unit(part["v"]), summary.pivots), part["frame"].to_numpy(), part["bound"].to_numpy())
            done = part["done"].to_list()
            chosen[np.repeat(np.arange(len(part)), [len(d) for d in done]), place[np.concatenate(done)]] = False
            bits.append(np.packbits(chosen, axis=0))
        who = np.concatenate(bits)
        needed = np.flatnonzero(who.any(axis=0))
        needed = needed[np.argsort(summary.tile[needed], kind="stable")]
        held = min(HELD_MOST, max(HELD, int(summary.n.sum()) // CHUNKS))
        return pd.DataFrame({KEY: some[KEY].iloc[0], "part": some["part"].iloc[0], "tile": summary.tile[needed],
                             "chunk": (summary.n[needed].cumsum() - summary.n[needed]) // held,
                             "who": [who[:, t].tobytes() for t in needed]})

    beside = _sorted_join(asking.select(F.col(KEY).alias("p_key"), F.col("part").alias("p_part")).distinct(),
                          summaries.withColumnRenamed(KEY, "k_key"), F.col("p_key") == F.col("k_key")).drop("k_key")
    return asking.groupBy(KEY, "part").cogroup(beside.groupBy("p_key", "p_part")).applyInPandas(
        look, f"{KEY} {kind}, part string, tile long, chunk long, who binary")


def _pairs(wanted: DataFrame) -> DataFrame:
    """The single pairs of a query and a tile, for whoever counts them; ``place`` is the query's in its part."""
    def single(batches):
        for rows in batches:
            places = [np.flatnonzero(np.unpackbits(np.frombuffer(w, np.uint8))) for w in rows["who"]]
            yield rows.drop(columns="who").loc[np.repeat(rows.index, [len(p) for p in places])].assign(
                place=np.concatenate([np.empty(0, np.int64), *places]))

    kind = wanted.schema[KEY].dataType.simpleString()
    return wanted.select(KEY, "part", "tile", "who").mapInPandas(single, f"{KEY} {kind}, part string, tile long, place long")


class Found:
    """The k nearest of each query so far, and the distance beyond which nothing counts any more."""

    def __init__(self, k: int, bound: np.ndarray) -> None:
        self.k, self.bound = k, bound.astype(np.float64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.least = 0, WAITING

    def add(self, query: np.ndarray, distance: np.ndarray, frame: np.ndarray, ids: np.ndarray) -> None:
        self.rows.append((query, distance, frame, ids))
        self.waiting += len(query)
        if self.waiting >= self.least:
            self.reduced()

    def reduced(self) -> tuple[np.ndarray, ...]:
        query, distance, frame, ids = (np.concatenate(c) for c in zip(*self.rows, strict=True)) if self.rows else (
            np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.lexsort((ids, frame, distance, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = order[place == self.k - 1]
        order = order[place < self.k]
        # Each query's k-th distance, where it has as many.
        self.bound[query[place == self.k - 1]] = np.minimum(self.bound[query[place == self.k - 1]], distance[last])
        query = query[place < self.k]
        self.rows = [(query, distance[order], frame[order], ids[order])]
        self.waiting, self.least = len(query), max(WAITING, 2 * len(query))
        return self.rows[0]


def _nearest_of_tile(found: Found, who: np.ndarray, asked: np.ndarray, rough: np.ndarray, before: np.ndarray, vectors: np.ndarray,
                     frames: np.ndarray, ids: np.ndarray) -> None:
    """The queries ``who`` (by frame) meet one tile (rows by frame and id): by single precision and its error, then what is left exactly."""
    slack = 2.0 ** -23 * (vectors.shape[1] + 8) + 10.0 ** -DISTANCE_DIGITS
    rough_tile = vectors.astype(np.float32).T
    block = max(1, min(BLOCK_ROWS, LOOKED // 4 // len(frames)))
    for start in range(0, len(who), block):
        some = who[start : start + block]
        earlier = np.searchsorted(frames, before[some[-1]])
        if not earlier:
            continue
        # A similarity as great as this may be within the bound.
        least = np.nextafter((1.0 - found.bound[some] - slack).astype(np.float32), np.float32(-np.inf))
        near = rough[some] @ rough_tile[:, :earlier] >= least[:, None]
        rows, cols = np.divmod(np.flatnonzero(near), earlier)
        if len(rows) * 8 > near.size:
            # Copies, or queries without a bound: all pairs at once are cheaper.
            distance = np.round(np.maximum(1.0 - asked[some] @ vectors[:earlier].T, 0.0), DISTANCE_DIGITS)
            distance[frames[None, :earlier] >= before[some][:, None]] = np.inf
            rows, cols = np.nonzero(best_rows(distance, found.k))
            distance = distance[rows, cols]
        else:
            kept = frames[cols] < before[some[rows]]
            rows, cols = rows[kept], cols[kept]
            distance = np.empty(len(rows))
            for at in range(0, len(rows), SINGLE):
                r, c = some[rows[at : at + SINGLE]], cols[at : at + SINGLE]
                distance[at : at + SINGLE] = np.einsum("ij,ij->i", asked[r], vectors[c])
            distance = np.round(np.maximum(1.0 - distance, 0.0), DISTANCE_DIGITS)
        counts = distance <= found.bound[some[rows]]
        rows, cols = rows[counts], cols[counts]
        found.add(some[rows], distance[counts], frames[cols], ids[cols])


def _meet_wanted(asking: DataFrame, wanted: DataFrame, tiled: DataFrame, k: int) -> DataFrame:
    """Each asking row (KEY, part, q, frame, v, bound) with its k nearest of each chunk of its part's tiles, each tile for those who need it."""
    of = tiled.schema["class_id"].dataType.simpleString()
    # Once a chunk.
    asks = _sorted_join(asking.select(KEY, "part", "q", "frame", "bound", "v"), wanted.select(KEY, "part", "chunk").distinct(),
                        [KEY, "part"])
    known = _sorted_join(tiled.select(KEY, "tile", "frame", "class_id", "v"), wanted.select(KEY, "tile", "part", "chunk"),
                         [KEY, "tile"])
    held = known.unionByName(wanted.select(KEY, "tile", "part", "chunk", "who"), allowMissingColumns=True)
    held = held.select(*[F.col(c).alias("e_" + c) for c in (KEY, "part", "chunk", "tile", "frame", "class_id", "v", "who")])

    def compare(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or held.empty:
            return pd.DataFrame(columns=["q", "frame", "class_id", "distance"])
        bits = held["e_who"].notna()
        who, held, asks = held[bits], held[~bits].sort_values(["e_tile", "e_frame", "e_class_id"]), asks.sort_values("q")
        frames, ids, tiles = held["e_frame"].to_numpy(np.int64), held["e_class_id"].to_numpy(), held["e_tile"].to_numpy(np.int64)
        vectors, asked = unit(held["e_v"]), unit(asks["v"])
        rough, before = asked.astype(np.float32), asks["frame"].to_numpy(np.int64)
        found, by_frame = Found(k, asks["bound"].to_numpy()), np.argsort(before, kind="stable")
        for tile, needs in zip(who["e_tile"], who["e_who"], strict=True):
            here = slice(*np.searchsorted(tiles, [tile, tile + 1]))
            needs = np.unpackbits(np.frombuffer(needs, np.uint8))[by_frame] > 0
            _nearest_of_tile(found, by_frame[needs], asked, rough, before, vectors[here], frames[here], ids[here])
        query, distance, frame, ids = found.reduced()
        return pd.DataFrame({"q": asks["q"].to_numpy()[query], "frame": frame, "class_id": ids, "distance": distance})

    return asks.groupBy(KEY, "part", "chunk").cogroup(held.groupBy("e_" + KEY, "e_part", "e_chunk")).applyInPandas(
        compare, f"q long, frame long, class_id {of}, distance double")


def steps(queries: DataFrame, entries: DataFrame, k: int, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(found rows by q, queries by q, what was asked: queries with their tiles, step by step).

    The driver holds no rows; a task of the routing holds the summary of one recording, a few
    numbers a tile.
    """
    asks = _written(queries.where("analysis_id IS NOT NULL AND frame IS NOT NULL AND embedding IS NOT NULL").select(
        F.monotonically_increasing_id().alias("q"), KEY, "query_id", F.col("frame").cast("long").alias("frame"),
        F.col("embedding").cast("array<float>").alias("v")), "asks")
    rows = entries.where("analysis_id IS NOT NULL AND frame IS NOT NULL AND embedding IS NOT NULL").select(
        KEY, F.col("frame").cast("long").alias("frame"), "class_id", F.col("embedding").cast("array<float>").alias("v"))
    sizes = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("size"))
    plain = asks.select(KEY, "q", "frame", "v")
    if (sizes.agg(F.max("size")).first()[0] or 0) <= tile_rows:
        asked = plain.withColumn("tile", F.lit(0)).withColumn(
            "part", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-asks.count() // ASKED)))).cast("string"))
        return _meet(asked, rows.withColumn("tile", F.lit(0)), k), asks, [asked]
    pivots = _written(_pivots(rows, sizes, tile_rows), "pivots")
    tiled = _written(_tiled(rows, sizes, pivots, tile_rows), "tiles")
    summaries = _written(_summaries(tiled, pivots), "summaries")
    met = _written(_grouped(_routes(plain, summaries)), "first")
    near = _written(_least(_meet(_looking(met, plain), tiled, k), k), "near")
    bounds = near.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    # A query without a first tile has no earlier entries.
    begun = met.groupBy("q").agg(F.min("part").alias("part"), F.collect_set("tile").alias("done"))
    asking = _written(_sorted_join(_sorted_join(plain, begun, "q"), bounds, "q", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf")))), "asking")
    wanted = _written(_wanted(asking, summaries), "further")
    found = near.drop("place").unionByName(_meet_wanted(asking, wanted, tiled, k))
    return found, asks, [met, _pairs(wanted)]


def nearest_earlier(queries: DataFrame, entries: DataFrame, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For each query the k entries of its recording with smaller frame and least distance.

    ``queries``: analysis_id, query_id, frame, embedding.  ``entries``: analysis_id, frame,
    class_id, embedding.  Equal distances go by frame and class_id.  Rows without recording,
    frame or vector take no part.
    """
    found, asks, _ = steps(queries, entries, k, tile_rows)
    return _sorted_join(_least(found, k), asks.select("q", KEY, "query_id", F.col("frame").alias("query_frame")), "q").select(
        KEY, "query_id", "query_frame", "frame", F.col("class_id").cast("int").alias("class_id"), "distance", "place")
