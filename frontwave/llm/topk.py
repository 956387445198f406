"""Exact top-k by integer inner product, over a pivot-distance index.

Vectors are scaled to integers. With one more coordinate, ``sqrt(M - |x|^2)`` for rows (M the largest squared norm) and 0 for
queries, all rows have one norm, so the largest inner products are the smallest distances, and distances obey the triangle
inequality. Index: every row is keyed by its nearest pivot and its distance to it; rows sorted by that key are cut into
blocks, each an annulus [low, high] around its pivot, and written to the shared folder. Pivots are chosen far apart from a
bounded sample; every row is indexed.

Search: queries are indexed the same way into query blocks. A query at distance d from a pivot cannot be nearer to an
annulus's rows than ``max(0, d - high, low - d)``, so no row there can score more than ``(|q|^2 + M - gap^2) / 2``. A query block looks
at its nearest annuli first and goes outwards in rounds, each of four times as many annuli; before a round, annuli whose bound
is below the k-th score of the block's worst-off query are dropped, and rows below their query's own k-th score do not leave
a task. In a round an annulus's rows cross the shuffle once, and its query blocks come to it. Bounds are floating-point with
a margin for rounding, scores are integers, so the result is exact, ties included. A stated query set meets all rows in
blocks; a pair of blocks that no query of the block can gain from is never joined.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, neither as rows nor as
queries; vectors of fewer components than the longest are padded with zeros; an empty vector scores 0 with all; fewer than k
other rows give fewer results; equal scores are ranked by the smaller id, then by place among repeated rows; a query is every row whose id
is divisible by ``every``; rows with a null id take no part; all rows that share the query's id are left out of its candidates; an empty table gives an
empty result. Extra columns are not read. Scores are exact as long as the largest squared norm is below 2**63 (beyond 2**53 by 64-bit
products in place of floating-point ones); beyond that, where a score may not fit 64 bits, an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, hash_unit, written


@dataclass(frozen=True)
class TopSettings:
    """``sample`` rows at most are looked at to choose ``pivots``; blocks hold at most ``block`` rows, query blocks ``queries``."""

    k: int = 5
    every: int = 50
    scale: float = 256.0
    pivots: int = 32
    sample: int = 2048
    block: int = 4096
    queries: int = 512
    near: int = 2


def integers(vectors: DataFrame, settings: TopSettings, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (integer components), norm of the rows that take part."""
    real = F.transform(F.col(vector), lambda x: x.cast("double"))
    fit = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(real, lambda x: F.floor(x * settings.scale)).alias("x"))
    return whole.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _dense(arrays: list, dim: int) -> np.ndarray:
    if all(len(x) == dim for x in arrays):
        return np.array(arrays, np.float64).reshape(len(arrays), dim)
    out = np.zeros((len(arrays), dim))
    for i, x in enumerate(arrays):
        out[i, : len(x)] = x
    return out


def choose_pivots(rows: DataFrame, settings: TopSettings, dim: int, most: float) -> np.ndarray:
    """Pivots in the lengthened space, farthest first, from a bounded sample."""
    got = rows.withColumn("_u", hash_unit(F.col("vec_id"), 1)).orderBy("_u", "vec_id").limit(settings.sample).select("x", "norm").toPandas()
    if not len(got):
        return np.zeros((1, dim + 1))
    points = _lengthened(_dense(list(got["x"]), dim), got["norm"].to_numpy(float), most)
    chosen = [points.mean(axis=0)]
    gap = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(settings.pivots, len(points)) and gap.max() > 0:
        chosen.append(points[int(gap.argmax())])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _lengthened(x: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - norm, 0))])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """By differences, so that the relative error stays that of a sum, however near a point is."""
    return np.column_stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots])


def _kind(most: float) -> str:
    """The type of a stored component."""
    return "<i4" if most < 2.0**61 else "<i8"


def index(rows: DataFrame, pivots: np.ndarray, dim: int, most: float, size: int, parts: int, name: str, query: bool = False) -> DataFrame:
    """Blocks of at most ``size`` rows: block, pivot, low, high, n, ids, data. Written, so that a block keeps its number."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(1).to_pylist(), dim)
            norm = batch.column(2).to_numpy().astype(float)
            d = _distances(_lengthened(x, norm if not query else np.full(len(x), most), most), shared.value)
            near = d.argmin(axis=1)
            data = [r.tobytes() for r in x.astype(_kind(most))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(data, pa.binary())], ["vec_id", "pivot", "distance", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> dict:
            rows = sorted(rows, key=lambda r: r[0])  # by id, so that places in a block rank ties
            return {"pivot": rows[0][1], "low": min(r[2] for r in rows), "high": max(r[2] for r in rows), "n": len(rows), "ids": np.array([r[0] for r in rows], "<i8").tobytes(), "data": b"".join(r[3] for r in rows)}

        schema = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            out = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (held[-1][1] != r[1] or len(held) >= size):
                    out.append(block(held))
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([block(held)], schema)

    keyed = rows.mapInArrow(key, "vec_id long, pivot int, distance double, data binary")
    blocks = keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id").mapInArrow(cut, "pivot int, low double, high double, n int, ids binary, data binary")
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), name)


def _matrix(data: bytes, n: int, dim: int, most: float) -> np.ndarray:
    """A block's vectors, in a type in which inner products are exact."""
    return np.frombuffer(data, _kind(most)).reshape(n, dim).astype(np.float64 if most < 2.0**53 else np.int64)


def bounds(queries: DataFrame, annuli: DataFrame, pivots: np.ndarray, dim: int, most: float) -> DataFrame:
    """block_q, block, bound: the most that any query of a block could score in an annulus, and how far away the annulus is.

    Annuli meet query blocks by pivot: a query block works out its distances to all pivots (a fixed number) once.
    """
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            out = []
            for block, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = _matrix(data, n, dim, most).astype(float)
                d = _distances(np.column_stack([x, np.zeros(n)]), shared.value)
                own = float((x**2).sum(axis=1).max())
                out += [(block, p, float(d[:, p].min()), float(d[:, p].max()), own) for p in range(d.shape[1])]
            types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], ["block_q", "pivot", "near", "far", "own"])

    sides = queries.select("block", "n", "data").mapInArrow(over, "block_q long, pivot int, near double, far double, own double")
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("high"), F.col("low") - F.col("far"))
    whole = F.col("own") + F.lit(most)
    bound = (whole - gap * gap) / 2 + whole * F.lit(1e-14 * (dim + 16)) + 1
    return sides.join(annuli.select("block", "pivot", "low", "high"), "pivot").select("block_q", "block", bound.alias("bound"), gap.alias("gap"), F.abs((F.col("near") + F.col("far")) / 2 - (F.col("low") + F.col("high")) / 2).alias("away"))


def _highest(score: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each row are among its k highest (ties to the first places), not its own and not below its floor."""
    score = np.where(own, np.iinfo(np.int64).min, score)
    n = score.shape[1]
    keep = (score >= floor[:, None]) & ~own
    if k < n:
        least = np.partition(score, n - k, axis=1)[:, n - k, None]
        more, equal = score > least, score == least
        keep &= more | (equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True)))
    return keep


def search(pairs: DataFrame, queries: DataFrame, annuli: DataFrame, floors: DataFrame, settings: TopSettings, dim: int, most: float, meet: int = 64) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in each annulus of ``pairs`` (block_q, block), but for scores below the query's floor (``floors`` has block_q, floors: one for each query of the block).

    An annulus goes to one task for each ``meet`` query blocks that look at it, followed by these.
    """
    k = settings.k

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own_ids, own = None, np.empty(0, np.int64), None
        for batch in bounded(batches, 6):
            out: list[list[np.ndarray]] = []
            for block, part, asks, floor, n, ids, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if not asks:
                    place, own_ids, own = (block, part), np.frombuffer(ids, "<i8"), _matrix(data, n, dim, most)
                    continue
                if place != (block, part):
                    raise ValueError("an annulus is missing")
                q_ids = np.frombuffer(ids, "<i8")
                score = (_matrix(data, n, dim, most) @ own.T).astype(np.int64)
                row, column = np.nonzero(_highest(score, q_ids[:, None] == own_ids[None, :], np.array(floor, np.int64), k))
                out.append([q_ids[row], own_ids[column], score[row, column]])
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    asked = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / meet).cast("long").alias("parts"))
    dealt = pairs.select("block_q", "block").join(asked, "block").select("block_q", "block", F.pmod(F.xxhash64("block_q"), F.col("parts")).alias("part"))
    comes = queries.select(F.col("block").alias("block_q"), "n", "ids", "data").join(floors, "block_q")
    asks = dealt.join(comes, "block_q").select("block", "part", F.lit(True).alias("asks"), "floors", "n", "ids", "data")
    held = annuli.join(asked, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), F.lit(None).cast("array<long>").alias("floors"), "n", "ids", "data")
    return held.unionByName(asks).repartition("block", "part").sortWithinPartitions("block", "part", "asks").mapInArrow(over, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; the window's group limit cuts each task's rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, settings: TopSettings = TopSettings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = written(integers(vectors, settings, key, vector), "vectors")
    n, dim, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    if most >= 2.0**63:
        raise ValueError("vectors so long that a score may not fit 64 bits")
    pivots = choose_pivots(rows, settings, dim, most)
    parts = lambda count, size: max(1, -(-count // (4 * size)))
    annuli = index(rows, pivots, dim, most, settings.block, parts(n, settings.block), "annuli")
    asked = rows.where(F.col("vec_id") % settings.every == 0)
    queries = index(asked, pivots, dim, most, settings.queries, parts(asked.count(), settings.queries), "queries", query=True)
    nearest = Window.partitionBy("block_q").orderBy("gap", "away", "block")
    left = written(bounds(queries, annuli, pivots, dim, most).withColumn("place", F.row_number().over(nearest)), "bounds")
    member = written(queries.select(F.col("block").alias("block_q"), "ids").mapInArrow(_members, "block_q long, place int, query_id long"), "members")
    found, upto = None, settings.near
    while True:
        floor = F.lit(np.iinfo(np.int64).min)
        known = member.withColumn("floor", floor) if found is None else member.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")), "query_id", "left").withColumn("floor", F.when(F.col("c") >= settings.k, F.col("least")).otherwise(floor))
        # a block's queries are at most settings.queries
        floors = written(known.groupBy("block_q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "floor"))), lambda x: x["floor"]).alias("floors")), "floors")
        left = left.join(floors.select("block_q", F.array_min("floors").cast("double").alias("floor")), "block_q").where("bound >= floor").select("block_q", "block", "bound", "place")
        now = search(left.where(F.col("place") <= upto), queries, annuli, floors, settings, dim, most)
        found = written(best(now if found is None else found.unionByName(now), settings.k).select("query_id", "vec_id", "score"), "found")
        left = written(left.where(F.col("place") > upto), "bounds")
        if left.isEmpty():
            return best(found, settings.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        upto *= 4


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [np.frombuffer(raw, "<i8") for raw in batch.column(1).to_pylist()]
        size = [len(x) for x in held]
        place = np.concatenate([np.arange(n) for n in size]) if held else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size), pa.int64()), pa.array(place, pa.int32()), pa.array(np.concatenate(held) if held else np.empty(0, np.int64))], ["block_q", "place", "query_id"])


def report_sql(embeddings: str = "embeddings", settings: TopSettings = TopSettings()) -> str:
    """DuckDB SQL for the same rows, by brute force."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({settings.scale} * x::DOUBLE)) AS x FROM {embeddings}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {settings.every} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {settings.k}"""
