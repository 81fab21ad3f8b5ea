"""Shards of near-equal bytes: a k-d tree over document metadata, cut at weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

ROW_BYTES = 16
_BITS = 40  # of a place along a dimension: 20 of the coordinate, then 20 of the text's hash
_BINS = 11  # bits that one histogram resolves


_NODES = 100_000  # of which a table of some bytes a row may be broadcast


def _beside(rows: DataFrame, said: list[tuple], kind: str, how: str = "inner") -> DataFrame:
    """rows with what ``said`` (one tuple a node, at most as many as shards) says of their node."""
    nodes = rows.sparkSession.createDataFrame(said, f"node long, {kind}")
    return rows.join(F.broadcast(nodes) if len(said) <= _NODES else nodes, "node", how)


def _first_over(bins: DataFrame) -> list:
    """Of each node (bin, w, goal, below): the first bin with which the weight passes the goal, and the last; 2048 bins a node at most."""
    run = F.sum("w").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    seen = bins.withColumn("upto", F.col("below") + run)
    hit = F.min(F.when(F.col("upto") > F.col("goal"), F.struct("bin", "w", "upto")))
    return seen.groupBy("node").agg(F.first("dim").alias("dim"), F.first("goal").alias("goal"), hit.alias("hit"), F.max(F.struct("bin", "upto")).alias("last")).collect()


def split_points(points: DataFrame, dims: list[str], shards: int, tolerance: float = 0.002) -> DataFrame:
    """Add ``shard`` to points of places ``dims`` (longs under 2**40) and ``weight``.

    All open nodes of a level are cut together. One aggregate gives histograms of 2048 bins and the bounds of every node and
    dimension; the widest is cut where the bins' running weight passes the goal, and where the bin with the cut outweighs the tolerance it is
    resolved by up to three further histograms. Bins stay tables: the driver gets one row a node, so at most as many as shards.
    """
    total = points.agg(F.sum("weight")).first()[0] or 0
    allowed = tolerance * total / shards
    at = points.withColumn("node", F.lit(0).cast("long"))
    nodes = {0: (shards, 0)}  # shards that each holds, and the first of them
    while open_ := [(k, n) for k, (n, _) in nodes.items() if n > 1]:
        shift = _BITS - _BINS
        each = F.inline(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("place")) for i, d in enumerate(dims)]))
        bins = _beside(at, open_, "shards int").select("node", "shards", "weight", each).groupBy("node", "shards", "dim", F.shiftright("place", shift).alias("bin"))
        bins = bins.agg(F.sum("weight").alias("w"), F.min("place").alias("a"), F.max("place").alias("z"))
        own, axis = W.partitionBy("node"), W.partitionBy("node", "dim")
        width = F.struct((F.max("z").over(axis) - F.min("a").over(axis)).alias("width"), (-F.col("dim")).alias("late"))
        bins = bins.withColumn("width", width).withColumn("widest", F.max("width").over(own)).where("widest.late = -dim")
        goal = F.sum("w").over(own) * F.floor(F.col("shards") / 2) / F.col("shards")
        found = _first_over(bins.select("node", "dim", "bin", "w", goal.alias("goal"), F.lit(0.0).alias("below")))
        low, cut, dim = {r.node: 0 for r in found}, {}, {r.node: r.dim for r in found}
        for depth in range(1, 5):
            todo = []
            for r in found:
                weight = r.hit.w if r.hit else 0
                before = r.hit.upto - weight if r.hit else r.last.upto
                edge = low[r.node] + ((r.hit.bin if r.hit else r.last.bin + 1) << shift)
                if weight <= allowed or shift == 0:
                    cut[r.node] = edge + (1 << shift if weight and r.goal - before > weight / 2 else 0)  # the nearer side of the bin
                else:
                    low[r.node] = edge
                    todo.append((r.node, r.dim, edge, r.goal, float(before)))
            if not todo:
                break
            span, shift = _BITS - _BINS * depth, max(_BITS - _BINS * (depth + 1), 0)
            rows = _beside(at, todo, "dim int, low long, goal double, below double").withColumn("off", F.element_at(F.array(*dims), F.col("dim") + 1) - F.col("low"))
            finer = rows.where((F.col("off") >= 0) & (F.col("off") < (1 << span))).groupBy("node", "dim", "goal", "below", F.shiftright("off", shift).alias("bin"))
            found = _first_over(finer.agg(F.sum("weight").alias("w")))
        goes = 2 * F.col("node") + F.when(F.element_at(F.array(*dims), F.col("dim") + 1) < F.col("cut"), 1).otherwise(2)
        cuts = _beside(at, [(k, dim[k], c) for k, c in cut.items()] or [(-1, 0, 0)], "dim int, cut long", "left")
        at = materialise(cuts.select(*points.columns, F.when(F.col("cut").isNull(), F.col("node")).otherwise(goes).alias("node")), "shard-level", replaces=at)
        for k, n in open_:
            _, first = nodes.pop(k)
            nodes |= {2 * k + 1: (n // 2, first), 2 * k + 2: (n - n // 2, first + n // 2)}
    return _beside(at, [(k, first) for k, (_, first) in nodes.items()], "shard int").drop("node")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Deal documents into shards of near-equal bytes: (doc_id, size, text_crc32, shard, slot).

    Give the number of shards or the bytes of one. size is the text's UTF-8 bytes (0 for null)
    plus 16. Equal texts form one point of the tree, with their summed bytes as its weight, and
    so stay together, except where a group outweighs a quarter of a shard: such a group is
    dealt by id into points of about a five-hundredth, which lie next to each other along
    every dimension, as no shard could else be near the others in bytes. Dimensions: size, smallest
    id and the ``metadata`` columns that docs has (by their hash). slot counts a shard's rows
    from 0 without gaps. Null ids, texts and metadata are places of their own; repeated rows each
    get a slot; an empty table gives no rows.
    """
    here = [c for c in metadata if c in docs.columns]
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.length(raw) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("text_hash"),
            *[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"m{k}") for k, c in enumerate(here)],
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    shards = shards or max(1, math.ceil((total or 0) / target_bytes))
    part = max(1, (total or 0) // (shards * 500))
    group = ["text_hash", "text_crc32", "size"]
    heavy = rows.groupBy(*group).count().where(4 * F.col("count") * F.col("size") * F.lit(shards) > (total or 0)).select(*group, F.ceil(F.col("count") * F.col("size") / part).cast("int").alias("parts"))
    heavy = materialise(heavy, "shard-heavy")
    dealt = rows.join(heavy, group, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    dealt = materialise(dealt, "shard-dealt")
    metas = [F.min(f"m{k}").alias(f"m{k}") for k in range(len(here))]
    points = dealt.groupBy(*group, "part").agg(F.sum("size").alias("weight"), F.min("doc_id").alias("first"), *metas)
    low, high = points.agg(F.min("first"), F.max("first")).first()
    ratio = lambda c, a, b: ((c.cast("double") - a) / max(b - a, 1) * ((1 << 20) - 1)).cast("long")
    coordinates = {
        "d_size": (F.log2(F.col("size").cast("double")) / 63 * ((1 << 20) - 1)).cast("long"),
        "d_first": F.coalesce(ratio(F.col("first"), low or 0, high or 0), F.lit(0)),
    } | {f"d_m{k}": F.pmod(F.col(f"m{k}"), F.lit(1 << 20)) for k in range(len(here))}
    tail = F.pmod(F.xxhash64("text_hash", "part"), F.lit(1 << 20))
    placed = points.select(*group, "part", "weight", *[(F.shiftleft(c, 20) + tail).alias(d) for d, c in coordinates.items()])
    found = split_points(materialise(placed, "shard-points"), list(coordinates), shards).select(*group, "part", "shard")
    sharded = materialise(dealt.join(found, [*group, "part"]).select("doc_id", "size", "text_crc32", "shard"), "shard-dealt")
    bins = max(1, math.ceil((n or 0) / (shards * 20_000)))
    sharded = sharded.withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)))
    before = sharded.groupBy("shard", "bin").count().select("shard", "bin", (F.sum("count").over(W.partitionBy("shard").orderBy("bin")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32")) - 1
    return sharded.withColumn("place", place).join(before, ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))
