"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

_BLOCK = "block long, pivot int, low double, high double, top double, ids binary, dists binary, norms binary, vectors binary, q_ids binary, q_vectors binary, r_query binary, r_vec binary, r_score binary"
_FLOOR = np.iinfo(np.int64).min
_MOST = 1 << 62  # components saturate here, scores at the ends of a long
MAX_BLOCKS = 1 << 20  # of which the driver and each task hold 40 bytes each


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of each component, at most 2**62 in size; rows that can't be scored are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    most = F.lit(float(_MOST))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c.cast("double"), most), -most)).cast("long"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(x.isNotNull() & finite, whole).alias("v"))
    return rows.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros to ``width``."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    flat, at = flat[at[0] : at[-1]], at - at[0]
    out, sizes = np.zeros((len(lists), width), np.int64), np.diff(at)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1], sizes)] = flat
    return out


def choose_pivots(sample: np.ndarray, m: int, rounds: int = 5) -> np.ndarray:
    """k-means centres of the sample, started from its far points."""
    centres = [sample[0].astype(float)]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(m, len(sample)) and near.max() > 0:
        centres.append(sample[int(near.argmax())].astype(float))
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(axis=1))
    c = np.stack(centres)
    for _ in range(rounds):
        of = distances(sample, c).argmin(axis=1)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers: by floating point where that is exact, and saturated where they leave 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    top = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if top < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if top < 2**62:
        return q @ x.T
    whole = q.astype(object) @ x.T.astype(object)
    return np.clip(whole, _FLOOR + 1, np.iinfo(np.int64).max).astype(np.int64)


def best(q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of each query's k highest scores, ties to smaller ids, its own id left out."""
    rows, cols, found = [], [], []
    for i in range(len(q_ids)):
        s, pos = scores[i], np.flatnonzero((ids != q_ids[i]) & (scores[i] > _FLOOR))
        if len(pos) > k:
            edge = np.partition(s[pos], len(pos) - k)[len(pos) - k]
            pos = pos[s[pos] >= edge]
        pos = pos[np.lexsort((ids[pos], -s[pos]))][:k]
        rows.append(np.full(len(pos), i))
        cols.append(pos)
        found.append(s[pos])
    return (np.concatenate(rows), np.concatenate(cols), np.concatenate(found)) if rows else (np.zeros(0, np.int64),) * 3


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 4096, block_rows: int = 4096, max_pivots: int = 1024, first: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other rows.

    Queries are the rows whose id is divisible by ``every``. Components become floor(scale * x), saturating at 2**62 in size, and
    scores saturate at the ends of a long; vectors
    that are null or hold null or non-finite components take no part, nor do rows without id.
    Repeated ids stand for one row (the least vector, if they differ); a shorter vector counts as padded
    with zeros. Ties go to the smaller id; a query with fewer other rows gets them all. An
    empty table gives no rows. Only the two columns are read.

    Pivots (k-means of a sample of sample_rows rows) are the index: rows are sorted by nearest pivot and distance and cut into
    annuli of at most block_rows rows, or as many as keep the annuli under MAX_BLOCKS. An annulus gives its own queries their first
    k answers. By |<q,x>| = (|q|^2 + |x|^2 - d(q,x)^2) / 2 and d(q,x) >= |d(q,p) - d(x,p)| every annulus has a bound for a query. A
    query then goes to the ``first`` annuli of highest bound, which raises its floor, its k-th score so far, and after that to
    those of the others alone whose bound still reaches the floor.
    """
    spark = df.sparkSession
    base = materialise(integer_vectors(df, id_col, vector_col, scale), "topk-vectors")
    n, width, reach = base.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    item, block_rows = np.int32 if (reach or 0) < 2**31 else np.int64, max(block_rows, -(-n // MAX_BLOCKS))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    pivots = choose_pivots(matrix(sample["v"].combine_chunks(), width), int(min(max_pivots, max(4, math.sqrt(n) / 4))))
    shared = spark.sparkContext.broadcast(pivots)
    filed_kind = pa.schema([("vec_id", pa.int64()), ("pivot", pa.int32()), ("dist", pa.float64()), ("vector", pa.binary())])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), width)
                d = distances(x, shared.value)
                of = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of.astype(np.int32)), pa.array(d[np.arange(len(d)), of]), pa.array([r.tobytes() for r in x.astype(item)], pa.binary())], schema=filed_kind)

    filed = materialise(base.mapInArrow(file, "vec_id long, pivot int, dist double, vector binary"), "topk-filed")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = pa.Table.from_batches([], schema=filed_kind), 0
        start = TaskContext.get().partitionId() << 32
        for b in itertools.chain(batches, [None]):
            held = pa.concat_tables([held, pa.Table.from_batches([b]).cast(filed_kind)]) if b is not None else held
            while held.num_rows and (b is None or held.num_rows > block_rows):
                same = int(np.searchsorted(held["pivot"].to_numpy(), held["pivot"][0].as_py(), side="right"))
                cut = min(same, block_rows)
                yield block(held.slice(0, cut), start + made)
                held, made = held.slice(cut), made + 1

    def block(t: pa.Table, number: int) -> pa.RecordBatch:
        ids, dist = t["vec_id"].to_numpy(), t["dist"].to_numpy()
        x = np.frombuffer(b"".join(t["vector"].to_pylist()), item).reshape(len(ids), width).astype(np.int64)
        asks, norm = np.flatnonzero(ids % every == 0), (x.astype(float) ** 2).sum(axis=1)
        rows, cols, found = best(ids[asks], ids, products(x[asks], x), k)
        packed = (ids, dist, norm, x.astype(item), ids[asks], x[asks].astype(item), ids[asks][rows], ids[cols], found)
        head = [pa.array([number], pa.int64()), pa.array([t["pivot"][0].as_py()], pa.int32()), *(pa.array([float(v)]) for v in (dist[0], dist[-1], norm.max()))]
        return pa.RecordBatch.from_arrays([*head, *(pa.array([_packed(c)], pa.binary()) for c in packed)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = filed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    blocks = materialise(ordered.mapInArrow(build, _BLOCK), "topk-blocks")
    table = spark.sparkContext.broadcast({c: x.to_numpy() for c, x in zip(("block", "pivot", "low", "high", "top"), blocks.select("block", "pivot", "low", "high", "top").toArrow().columns, strict=True)})

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, ids, vectors in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), number)), pa.array([vectors[i * width * np.dtype(item).itemsize : (i + 1) * width * np.dtype(item).itemsize] for i in range(len(ids))], pa.binary())], names=["query_id", "home", "vector"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in found], schema=answer_kind)

    answer_kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    asked = blocks.select("block", "q_ids", "q_vectors").mapInArrow(questions, "query_id long, home long, vector binary")
    found = blocks.select("r_query", "r_vec", "r_score").mapInArrow(at_home, "query_id long, vec_id long, score long")
    held = blocks.select("block", "ids", "dists", "norms", "vectors")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for skip, take in ((0, first), (first, None)):
        found = materialise(found.withColumn("rank", rank).where(F.col("rank") <= k), "topk-found")  # two rounds
        floors = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(_FLOOR).alias("floor"))
        wanted = asked.join(floors, "query_id", "left").select("query_id", "home", "vector", F.coalesce("floor", F.lit(_FLOOR)).alias("floor"))
        sent = wanted.mapInArrow(_sender(shared, table, width, item, skip, take), "block long, a_ids binary, a_vectors binary, a_floor binary, a_dist binary")
        more = sent.join(held, "block").drop("block").mapInArrow(_searcher(width, item, k), "query_id long, vec_id long, score long")
        found = found.select("query_id", "vec_id", "score").unionByName(more)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sender(shared, table, width: int, item: type, skip: int, take: int | None):
    """Deal queries (query_id, home, vector, floor) to annuli: of each query's, in the order of their bounds, the ``take`` after the
    first ``skip``, as far as the bound reaches the floor."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pivots = table.value, shared.value
        at_once = max(16, min(4096, (1 << 23) // max(len(t["block"]), 1)))
        for b in batches:
            for a in range(0, b.num_rows, at_once):
                part = b.slice(a, at_once)
                ids, home, floor = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
                q = np.frombuffer(b"".join(part.column(2).to_pylist()), item).reshape(len(ids), width)
                d = distances(q.astype(np.int64), pivots)[:, t["pivot"]]
                size = (q.astype(float) ** 2).sum(axis=1)[:, None] + t["top"]
                bound = (size - np.maximum(0, np.maximum(t["low"] - d, d - t["high"])) ** 2) / 2 + 1e-6 * size + 1e-3
                bound[home[:, None] == t["block"]] = -np.inf
                goes = bound >= np.maximum(floor, -_MOST).astype(float)[:, None] * (1 - np.sign(floor)[:, None] * 1e-12)
                goes &= bound > -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")
                np.put_along_axis(goes, order[:, :skip], False, axis=1)
                if take is not None:
                    np.put_along_axis(goes, order[:, skip + take :], False, axis=1)
                for j in np.flatnonzero(goes.any(axis=0)).tolist():
                    s = goes[:, j]
                    yield pa.RecordBatch.from_arrays([pa.array(t["block"][[j]]), *(pa.array([_packed(c)], pa.binary()) for c in (ids[s], q[s], floor[s], d[s, j]))], names=["block", "a_ids", "a_vectors", "a_floor", "a_dist"])

    return send


def _searcher(width: int, item: type, k: int):
    """Answers of the queries that met an annulus, from the part of it whose distances can reach their floors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                raw = {name: b.column(name)[row].as_py() for name in b.schema.names}
                a_ids, floor, a_dist = np.frombuffer(raw["a_ids"], np.int64), np.frombuffer(raw["a_floor"], np.int64), np.frombuffer(raw["a_dist"])
                q = np.frombuffer(raw["a_vectors"], item).reshape(len(a_ids), width).astype(np.int64)
                ids, dist, norm = np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["dists"]), np.frombuffer(raw["norms"])
                x = np.frombuffer(raw["vectors"], item).reshape(len(ids), width)
                # gap^2 <= |q|^2 + max|x|^2 - 2 floor, so only distances this near d(q,p) can reach the floor
                size = (q.astype(float) ** 2).sum(axis=1) + norm.max()
                slack = np.sqrt(np.maximum(size - 2 * np.maximum(floor, -_MOST).astype(float), 0) + 1e-6 * size) + 1e-3
                low, high = np.searchsorted(dist, a_dist - slack), np.searchsorted(dist, a_dist + slack, side="right")
                live = np.flatnonzero(low < high)
                if not len(live):
                    continue
                a, z = int(low[live].min()), int(high[live].max())
                scores = products(q[live], x[a:z].astype(np.int64))
                scores[scores < floor[live, None]] = _FLOOR
                rows, cols, found = best(a_ids[live], ids[a:z], scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[live][rows]), pa.array(ids[a:z][cols]), pa.array(found)], names=["query_id", "vec_id", "score"])

    return search
