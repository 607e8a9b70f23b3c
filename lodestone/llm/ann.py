"""Nearest neighbours: several shifted Hilbert curves bound each query's distances, then all blocks within a bound are searched."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Vectors from which projections and key ranges are fitted.
SAMPLE = 4096
#: Projected dimensions and bits of each in a key (at most 62 bits in all).
AXES, BITS = 12, 5
#: Curves, vectors in a block of a curve, neighbours that a block names for a query, and those reranked for a query. These only
#: settle how tight a query's first bound is; what lies within the bound is searched whole.
CURVES, BLOCK, NAMED, RERANKED = 16, 2048, 24, 64
#: Queries that one pass over all vectors carries, and vectors that it bounds together.
ASKED, TOGETHER = 4096, 1024


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (a row each, unsigned) along the Hilbert curve, by Skilling's transposition."""
    x, n, one = x.astype(np.uint64), x.shape[1], np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            up = (x[:, i] & bit) != 0
            swap = np.where(up, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, n - 1] >> np.uint64(b)) & one != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[:, i] >> np.uint64(b)) & one
    return key.astype(np.int64)


@dataclass
class Curves:
    """For each curve a projection, and the shifted box in which its points are numbered."""

    mean: np.ndarray
    scale: float
    turn: np.ndarray  # curves x dimensions x axes
    low: np.ndarray
    span: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, curves: int, seed: int = 5) -> Curves:
        draw, d = np.random.default_rng(seed), sample.shape[1]
        mean, axes = sample.mean(axis=0), min(AXES, sample.shape[1])
        # Directions of most spread first: a curve takes random ones of their leading span.
        lead = np.linalg.svd(sample - mean, full_matrices=True)[2].T[:, : max(axes, min(d, 4 * axes))]
        turn = np.stack([lead @ np.linalg.qr(draw.normal(size=(lead.shape[1], lead.shape[1])))[0][:, :axes] for _ in range(curves)])
        points = np.einsum("nd,cda->cna", sample - mean, turn)
        low, high = np.quantile(points, [0.005, 0.995], axis=1)
        room = np.maximum(high - low, 1e-12)
        return cls(mean, max(1e-30, float(np.abs(sample - mean).mean())), turn, low - room / 2 * draw.random(low.shape), 1.5 * room)

    def keys(self, v: np.ndarray) -> Iterator[np.ndarray]:
        for turn, low, span in zip(self.turn, self.low, self.span, strict=True):
            at = ((v - self.mean) @ turn - low) / span
            yield hilbert(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _places(reps: DataFrame, fitted: Curves) -> DataFrame:
    """rep, wanted, code (half-precision vector less the mean), curve, and the block and rank of its place on that curve.

    Keys are range-partitioned and sorted in Spark. Rows before a partition's are counted to number a curve's rows from 0,
    so a block holds BLOCK rows, however many share a key.
    """
    shared = reps.sparkSession.sparkContext.broadcast(fitted)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Curves = shared.value
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                v = _vectors(part.column(2))
                code = pa.array([x.tobytes() for x in np.clip((v - own.mean) / own.scale, -6e4, 6e4).astype(np.float16)], pa.binary())
                for c, k in enumerate(own.keys(v)):
                    yield pa.record_batch([part.column(0), part.column(1), code, pa.array(np.full(len(v), c, np.int32)), pa.array(k)], names=["rep", "wanted", "code", "curve", "key"])

    keyed = reps.select("rep", "wanted", "vector").mapInArrow(key, "rep long, wanted boolean, code binary, curve int, key long")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = keyed.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    line = written(line.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    ends = line.groupBy("curve", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A row for each partition and curve.
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.col("at") - F.col("first")
    return line.join(ends, ["curve", "part"]).select("rep", "wanted", "code", "curve", F.floor(rank / BLOCK).alias("block"))


def _named(places: DataFrame) -> DataFrame:
    """query, rep, near: for each query and each of the three blocks about its place on a curve, the NAMED nearest by code.

    A group is one block's rows and the queries of it and its two neighbours: at most 4 * BLOCK rows.
    """
    schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("near", pa.float32())])

    def near(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids = group.column("rep").to_numpy()
        code = np.frombuffer(b"".join(group.column("code").to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)
        v, q, vid, qid = code[~asks], code[asks], ids[~asks], ids[asks]
        out: list[list[np.ndarray]] = [[], [], []]
        own = (v**2).sum(axis=1)
        for i in range(0, len(q) if len(v) else 0, 256):
            d = own[None] - 2 * (q[i : i + 256] @ v.T)
            best = np.argpartition(d, NAMED, axis=1)[:, :NAMED] if len(v) > NAMED else np.broadcast_to(np.arange(len(v)), d.shape)
            out[0].append(np.repeat(qid[i : i + 256], best.shape[1]))
            out[1].append(vid[best].ravel())
            out[2].append((np.take_along_axis(d, best, 1) + (q[i : i + 256] ** 2).sum(axis=1)[:, None]).ravel())
        return pa.table([pa.array(np.concatenate([*x, np.zeros(0, t.to_pandas_dtype())]), t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    around = F.explode(F.array(*(F.col("block") + k for k in (-1, 0, 1)))).alias("block")
    asked = places.where("wanted").select("rep", "code", "curve", around, F.lit(True).alias("asks"))
    given = places.select("rep", "code", "curve", "block", F.lit(False).alias("asks"))
    return given.union(asked).groupBy("curve", "block").applyInArrow(near, "query long, rep long, near float")


def _along(points: DataFrame, fitted: Curves) -> DataFrame:
    """points in the order of the first curve, so that rows which stand together are close."""
    shared = points.sparkSession.sparkContext.broadcast(fitted)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(next(shared.value.keys(_vectors(batch.column(3)))))], names=[*batch.schema.names, "key"])

    points = points.select("rep", "ids", "wanted", "vector")
    keyed = points.mapInArrow(key, "rep long, ids array<long>, wanted boolean, vector array<double>, key long")
    return keyed.repartitionByRange(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "rep").sortWithinPartitions("key", "rep").drop("key")


def squares(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances row by row, added up in the order of the components."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += (v[:, j] - q[:, j]) ** 2
    return out


def closest(v: np.ndarray, q: np.ndarray, most: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and distance of all pairs that can be among a query's `keep` nearest and are no farther than `most`.

    Queries beyond `most` of the ball about all of v are left out. Products are of vectors less their mean; pairs within their
    rounding error of the bound are kept, and their distances taken from differences.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    middle = v.mean(axis=0)
    cv, cq = v - middle, q - middle
    vv, qq = (cv**2).sum(axis=1), (cq**2).sum(axis=1)
    ball, away = np.sqrt(vv.max()), np.sqrt(qq)
    # Subtracting the mean rounds by the size of what is subtracted.
    unit, size = np.finfo(np.float64).eps * (2 * v.shape[1] + 16), np.abs(middle).max() * np.sqrt(v.shape[1])
    blur = unit * (size + ball + away)
    near = np.flatnonzero(~(away - ball - 2 * blur > most))
    found = [none]
    for at in (near[i : i + 512] for i in range(0, len(near), 512)):
        d = vv[None] + qq[at, None] - 2 * (cq[at] @ cv.T)
        reach = away[at] + ball
        error = unit * reach**2 + 4 * blur[at] * reach + 4 * blur[at] ** 2
        limit = most[at] ** 2
        if d.shape[1] > keep:
            limit = np.minimum(limit, np.partition(d, keep - 1, axis=1)[:, keep - 1] + error)
        a, b = np.nonzero(~(d > (limit + error)[:, None]))
        for i in range(0, len(a), 100_000):
            x, y = at[a[i : i + 100_000]], b[i : i + 100_000]
            far = np.sqrt(squares(v[y], q[x]))
            fits = far <= most[x]
            found.append((x[fits], y[fits], far[fits]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _searched(points: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """query, rep, score: each query's `keep` nearest of all points, or more; asked has query, asked (its vector) and most.

    Queries are dealt over passes of about ASKED, so what a pass broadcasts does not grow. A task keeps `keep` a query.
    """
    sc, schema = points.sparkSession.sparkContext, pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
    passes = -(-asked.count() // ASKED)
    found = []
    for n in range(passes):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == n).toPandas()
        if not len(some):
            continue
        shared = sc.broadcast((some["query"].to_numpy(np.int64), np.array(some["asked"].to_list(), np.float64), some["most"].to_numpy(np.float64)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, most = shared.value
            most, held = most.copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                reps = batch.column(0).to_numpy()
                for i in range(0, batch.num_rows, TOGETHER):
                    row, near, far = closest(_vectors(batch.column(1).slice(i, TOGETHER)), q, most, keep)
                    if not len(row):
                        continue
                    row, rep, far = (np.concatenate(x) for x in zip(held, (row, reps[i : i + TOGETHER][near], far), strict=True))
                    order = np.lexsort((rep, far, row))
                    row, rep, far = row[order], rep[order], far[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    full = place == keep - 1
                    most[row[full]] = np.minimum(most[row[full]], far[full])
                    held = tuple(x[place < keep] for x in (row, rep, far))
            if len(held[0]):
                yield pa.record_batch([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], schema=schema)

        found.append(written(points.select("rep", "vector").mapInArrow(search, "query long, rep long, score double")))
        shared.unpersist()
    return reduce(DataFrame.union, found)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`, by Euclidean distance.

    Equal vectors are one point that holds its k + 1 least ids, so copies cost nothing and ties go to the smaller id. Every
    point lies on `curves` Hilbert curves of randomly turned and shifted projections, fitted on SAMPLE vectors. A query
    meets its block and both neighbours on each curve by half-precision codes; what the curves name merges and is reranked
    on original vectors in double precision. The distance of the last of those is a bound within which the query then meets
    all points, in blocks of which only those wholly beyond the bound are skipped: the result is exact at every size.
    Defined results: null, empty and zero vectors and those with null or non-finite components take no part; neither do
    null ids. Vectors of different lengths have no distance: each length is searched by itself, one after another. Rows that
    repeat an id and vector are one candidate. With fewer candidates than k a query has them all. Other columns, whatever
    their names, are not read. An empty table gives an empty table.
    """
    vector = F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
    # A row for each length that queries have.
    lengths = rows.where(F.col("id") % every == 0).select(F.size("vector").alias("n")).distinct().orderBy("n").collect()
    found = [_nearest_of(rows.where(F.size("vector") == r.n), k, every, curves) for r in lengths]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of(rows: DataFrame, k: int, every: int, curves: int) -> DataFrame:
    """nearest() among id, vector rows of one length; some are queries."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"].to_list()
    fitted = Curves.fitted(np.array(some, np.float64), curves)
    rows = rows.distinct()

    first = W.partitionBy("vector").orderBy("id")
    points = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(F.col("id") % every == 0)
    wanted = asked.select(F.col("vector").alias("asked")).distinct()
    points = points.join(wanted, F.col("vector") == F.col("asked"), "left").select(F.col("ids")[0].alias("rep"), "ids", F.col("asked").isNotNull().alias("wanted"), "vector")
    points = written(_along(points, fitted))

    found = _named(_places(points, fitted)).groupBy("query", "rep").agg(F.min("near").alias("near"))
    found = found.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("near", "rep"))).where(F.col("n") <= RERANKED)
    pairs = written(found.select("query", "rep"))
    far = F.sqrt(F.aggregate(F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    query = points.where("wanted").select(F.col("rep").alias("query"), F.col("vector").alias("asked"))
    close = pairs.join(query, "query").join(points.select("rep", "ids", "vector"), "rep").select("query", "ids", far.alias("score"))
    close = close.select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy("score", "vec_id")
    bound = close.withColumn("n", F.row_number().over(order)).where(F.col("n") == k + 1).select("query", (F.col("score") * (1 + 1e-12)).alias("most"))
    bounded = written(query.join(bound, "query", "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))))
    close = _searched(points, bounded, k + 1).join(points.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    close = close.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "vec_id", "score")

    mine = asked.join(query, F.col("vector") == F.col("asked")).select(F.col("id").alias("query_id"), "query")
    last = mine.join(close, "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return last.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER near)::INT AS rank, vec_id, score FROM pair WINDOW near AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER near <= 10
"""
