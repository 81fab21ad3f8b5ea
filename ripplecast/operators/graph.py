"""Queries on snapshots (snapshot_id, node_id ...; source_id, target_id ...): reach, degree, rank, features, messages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.storage import bucketed, discard, numbered, small_tasks, stored

NODE_TYPES = ("file", "class", "function", "module", "service")


def seeds_for_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(snapshot_id, node_id) of file:<path> and of every node of that path, for paths (path)."""
    direct = nodes.join(paths.select(C.node_id("file", F.col("path")).alias("node_id")).distinct(), "node_id", "left_semi")
    inside = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return direct.select("snapshot_id", "node_id").unionByName(inside.select("snapshot_id", "node_id")).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """R2: (nodes with depth, edges) within max_depth undirected steps of known seeds.

    Edges are those met while nodes nearer than max_depth are expanded. Each level is one join of the
    frontier with the edges and one anti-join with what was seen; levels are stored, so
    their plans stay short. With max_nodes a snapshot visits the nearest nodes only (ties by id), the known ones of which stay, with the edges
    between them. What a level may still add is carried from level to level: a task passes on no more than that many neighbours, even of
    a hub, and expansion ends where nothing may be added.
    """
    key = ["snapshot_id", "node_id"]
    known = nodes.select(*key)
    edges = stored(edges.select("snapshot_id", "source_id", "target_id", "edge_type", "weight"), "bfs-edges")  # made once, not by every level
    both = edges.select("snapshot_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("other")).unionByName(edges.select("snapshot_id", F.col("target_id").alias("node_id"), F.col("source_id").alias("other")))
    by_id = W.partitionBy("snapshot_id").orderBy("node_id")

    def within(new: DataFrame, seen: DataFrame | None) -> DataFrame:
        """The first new nodes of each snapshot that it has room for; a dense rank under a constant is cut in each task, before the shuffle."""
        if max_nodes is None:
            return new.distinct()
        new = new.withColumn("__n", F.dense_rank().over(by_id)).where(F.col("__n") <= max_nodes).select(*key).distinct()
        if seen is not None:
            room = seen.groupBy("snapshot_id").agg((max_nodes - F.count("*")).alias("__room"))
            new = new.withColumn("__n", F.row_number().over(by_id)).join(room, "snapshot_id").where(F.col("__n") <= F.col("__room")).select(*key)
        return new

    seen = stored(within(seeds.select(*key).join(known, key, "left_semi"), None).withColumn("depth", F.lit(0)), "bfs")
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select(*key)
        if max_nodes is not None:
            open_ = seen.groupBy("snapshot_id").count().where(F.col("count") < max_nodes).select("snapshot_id")
            front = front.join(open_, "snapshot_id", "left_semi")
        if front.isEmpty():
            break
        new = both.join(front, key).select("snapshot_id", F.col("other").alias("node_id")).join(seen, key, "left_anti")
        seen = stored(seen.unionByName(within(new, seen).withColumn("depth", F.lit(depth))), "bfs", replaces=seen)
    near = seen.where(F.col("depth") < max_depth).select(*key)
    met = edges.join(near.withColumnRenamed("node_id", "source_id"), ["snapshot_id", "source_id"], "left_semi").unionByName(edges.join(near.withColumnRenamed("node_id", "target_id"), ["snapshot_id", "target_id"], "left_semi"), allowMissingColumns=True)
    found = seen.join(known, key, "left_semi")
    if max_nodes is not None:
        found = stored(found, "bfs-cut")
        for end in ("source_id", "target_id"):
            met = met.join(found.select("snapshot_id", F.col("node_id").alias(end)), ["snapshot_id", end], "left_semi")
    met = met.groupBy("snapshot_id", "source_id", "target_id", "edge_type").agg(F.max("weight").alias("weight"))
    return found, met.select("snapshot_id", "source_id", "target_id", "edge_type", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, in_degree, out_degree) of every endpoint, known or not. One aggregate over both ends.

    It is stored by small tasks, as a task that makes edges distinct and counts their ends holds both in memory.
    """
    ends = edges.select("snapshot_id", F.inline(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    with small_tasks(edges.sparkSession, reads=edges):
        return stored(ends.groupBy("snapshot_id", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")), "degrees")


def max_degree(degree: DataFrame) -> DataFrame:
    """(snapshot_id, max_degree), at least 1."""
    return degree.groupBy("snapshot_id").agg(F.greatest(F.max("in_degree"), F.max("out_degree"), F.lit(1)).alias("max_degree"))


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, hub: int = 100_000) -> DataFrame:
    """(snapshot_id, node_id, rank): fixed rounds, dangling mass spread over all nodes, divided by the largest.

    Edges with an unknown end are skipped; parallel ones count. All snapshots at once. What dangling nodes lose returns to all nodes of a
    snapshot alike, so the rank is a weighted sum of the powers of the damped links applied to the even start: a round is one
    join of the last power with the links and one aggregate, stored, and the weights follow, a row a snapshot, from what each power
    has on dangling nodes. Links lie bucketed by source and are never shuffled again; those of a source with over ``hub`` are dealt over
    several buckets, to each of which its share is sent. A power has no node that the one before had not, so links of nodes that it lacks are left out once it has
    half as many, and after one without nodes all are zero.
    """
    known = stored(nodes.select("snapshot_id", "node_id").distinct(), "pagerank-known")
    inner = edges.select("snapshot_id", "source_id", "target_id")
    for end in ("source_id", "target_id"):
        inner = inner.join(known.withColumnRenamed("node_id", end), ["snapshot_id", end], "left_semi")
    links = stored(inner.groupBy("snapshot_id", F.col("source_id").alias("node_id"), "target_id").agg(F.count("*").alias("n")), "pagerank-edges")  # made once, for degrees and for parts
    out = stored(links.groupBy("snapshot_id", "node_id").agg(F.sum("n").alias("out"), F.ceil(F.count("*") / hub).cast("int").alias("salts")), "pagerank-out")
    size = known.groupBy("snapshot_id").agg(F.count("*").alias("size"))
    base = stored(known.join(out, ["snapshot_id", "node_id"], "left").join(size, "snapshot_id").select("snapshot_id", "node_id", (1 / F.col("size")).alias("v"), F.col("out").isNull().alias("dangling")), "pagerank-nodes")
    salt = F.pmod(F.hash("target_id"), F.col("salts"))
    parts = links.join(out, ["snapshot_id", "node_id"]).select("snapshot_id", "node_id", salt.alias("salt"), "target_id", (damping * F.col("n") / F.col("out")).alias("part"))
    key = ["snapshot_id", "node_id", "salt"]
    made, parts = links, bucketed(parts, "pagerank-links", key)
    discard(made)
    hubs = out.where("salts > 1").select("snapshot_id", "node_id", "salts")
    powers, size_then = [base.select("snapshot_id", "node_id", "v")], base.count()
    deal = lambda x: x.join(hubs, ["snapshot_id", "node_id"], "left").select("snapshot_id", "node_id", "v", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    for _ in range(rounds):
        got = parts.join(deal(powers[-1]), key).groupBy("snapshot_id", F.col("target_id").alias("node_id")).agg(F.sum(F.col("v") * F.col("part")).alias("v"))
        powers.append(stored(got, "pagerank"))
        size_now = powers[-1].count()
        if not size_now:
            break
        if 2 * size_now <= size_then:
            parts, size_then = bucketed(parts.join(deal(powers[-1]), key, "left_semi"), "pagerank-links", key), size_now
    every = reduce(DataFrame.unionByName, [x.select("snapshot_id", "node_id", "v", F.lit(k).alias("power")) for k, x in enumerate(powers)])
    held = every.join(base.where("dangling").select("snapshot_id", "node_id"), ["snapshot_id", "node_id"], "left_semi").groupBy("snapshot_id", "power").agg(F.sum("v").alias("held"))
    held = held.groupBy("snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct("power", "held"))).alias("held"))

    @F.pandas_udf("array<double>")
    def weights(held: pd.Series) -> pd.Series:
        def one(own: dict | None) -> list[float]:
            own, back = dict(own or {}), []  # back: what each round adds to the even start
            for k in range(rounds):
                back.append(1 - damping + damping * (own.get(k, 0.0) + sum(back[k - 1 - j] * own.get(j, 0.0) for j in range(k))))
            return [*back[::-1], 1.0]

        return held.map(one, na_action=None)

    weight = base.select("snapshot_id").distinct().join(held, "snapshot_id", "left").select("snapshot_id", weights("held").alias("weights"))
    rank = every.join(stored(weight, "pagerank-weights"), "snapshot_id").groupBy("snapshot_id", "node_id").agg(F.sum(F.col("v") * F.get("weights", F.col("power"))).alias("rank"))
    rank = stored(rank, "pagerank")
    top = rank.groupBy("snapshot_id").agg(F.max("rank").alias("top"))
    return rank.join(top, "snapshot_id").select("snapshot_id", "node_id", (F.col("rank") / F.col("top")).alias("rank"))


#: Numbers a node may carry, and what each is divided by.
PROPERTIES = {"loc": 1000, "function_count": 50, "class_count": 20, "import_count": 30, "api_surface": 10, "db_access": 1, "mq_access": 1, "is_entrypoint": 1, "has_tests": 1, "bugs": 10, "complexity": 50}
CAPPED = ("loc", "bugs", "complexity")  # at most 1


def node_features(nodes: DataFrame, degree: DataFrame, rank: DataFrame, changed: DataFrame, change: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, features array<float> of 32).

    nodes needs node_type and file_path; name and the PROPERTIES count where it holds them, else as 0. changed (path) has the
    files of the change; change is one row (added, deleted, complexity_delta, deleted_ratio, n_functions, n_files) whose last four
    stand on every node, while each changed file gets a whole-number share of the lines.
    """
    degree = stored(degree, "features-degree")  # made once, for the nodes and for the largest
    most = max_degree(degree)
    name = F.coalesce("file_path", "name") if "name" in nodes.columns else F.col("file_path")
    rows = nodes.withColumn("place", name).join(degree, ["snapshot_id", "node_id"], "left").join(rank, ["snapshot_id", "node_id"], "left").join(F.broadcast(most), "snapshot_id", "left")
    rows = rows.join(changed.select(F.col("path").alias("place")).distinct().withColumn("hit", F.lit(1.0)), "place", "left")
    one = change.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c_{c}") for c in ("added", "deleted", "complexity_delta", "deleted_ratio", "n_functions", "n_files")]).limit(1)
    rows = rows.join(F.broadcast(one))  # a single row
    get = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def held(c: str) -> Column:
        value = get(c) / PROPERTIES[c] if c in nodes.columns else F.lit(0.0)
        return F.least(value, F.lit(1.0)) if c in CAPPED else value

    path, hit = F.coalesce("place", F.lit("")), get("hit")
    share = lambda c: F.when(hit > 0, C.share(F.floor(F.col(f"c_{c}") / F.greatest(F.col("c_n_files"), F.lit(1.0))).cast("double"), 200)).otherwise(0.0)
    wide = F.greatest(get("max_degree"), F.lit(1.0))
    slots: list[Column] = [(F.col("node_type") == t).cast("double") for t in NODE_TYPES]
    slots += [
        hit, get("in_degree") / wide, get("out_degree") / wide, get("rank"), held("complexity"), share("added"), share("deleted"), held("bugs"), flag(F.lower(path).contains("test")),
        held("loc"), held("function_count"), held("class_count"), held("import_count"), held("api_surface"), held("db_access"), held("mq_access"),
        F.col("c_complexity_delta") / 20, F.col("c_deleted_ratio"), C.share(F.col("c_n_functions"), 20), F.col("c_n_files") / 20,
        (F.col("node_type") == "service").cast("double"), (F.col("node_type") == "module").cast("double"), flag(F.lower(path).contains("init")), flag(path.endswith(".py")), flag(path.rlike(r"\.(ts|tsx|js|jsx)$")),
        held("is_entrypoint"), held("has_tests"),
    ]
    return rows.select("snapshot_id", "node_id", F.array(*[s.cast("float") for s in slots]).alias("features"))


def index_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, source_ix, target_ix): ends by their place in the order of ids; unknown ends dropped."""
    ix = numbered(nodes.select("snapshot_id", "node_id"), ["snapshot_id"], [F.col("node_id")], "place").select("snapshot_id", "node_id", (F.col("place") - 1).alias("ix"))
    a, b = ix.toDF("snapshot_id", "source_id", "source_ix"), ix.toDF("snapshot_id", "target_id", "target_ix")
    return edges.join(a, ["snapshot_id", "source_id"]).join(b, ["snapshot_id", "target_id"]).select("snapshot_id", "source_ix", "target_ix")


def node_targets(nodes: DataFrame, affected: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, is_file, target): 1 for file nodes whose path is in affected (path)."""
    hit = affected.select(F.col("path").alias("file_path"), F.lit(1.0).alias("hit")).distinct()
    is_file = F.col("node_type") == "file"
    return nodes.join(hit, "file_path", "left").select("snapshot_id", "node_id", is_file.alias("is_file"), F.when(is_file, F.coalesce("hit", F.lit(0.0))).otherwise(0.0).alias("target"))


def neighbour_mean(vectors: DataFrame, edges: DataFrame, width: int | None = None) -> DataFrame:
    """(snapshot_id, node_id, vector): mean of the vectors of in-neighbours; nodes without any don't appear.

    vectors: snapshot_id, node_id, vector, all of ``width`` numbers (looked up where it isn't given).
    """
    sent = edges.select("snapshot_id", "source_id", F.col("target_id").alias("node_id")).join(vectors.select("snapshot_id", F.col("node_id").alias("source_id"), "vector"), ["snapshot_id", "source_id"])
    return _vector_mean(sent, ["snapshot_id", "node_id"], width or _width(vectors))


def mean_pool(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(snapshot_id, vector): mean node vector."""
    return _vector_mean(vectors, ["snapshot_id"], width or _width(vectors))


def _width(vectors: DataFrame) -> int:
    """The length of the vectors, which have one length."""
    short, wide = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if short != wide:
        raise ValueError(f"vectors have {short} to {wide} numbers")
    return wide or 0


def _vector_mean(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Mean of ``vector`` by keys. A key has one row of ``width`` sums, which generated code adds up in place: a task sends one a key it meets, so a hub
    costs a row a task, and no vector is taken apart into rows."""
    means = rows.groupBy(*keys).agg(*[F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"__{i}") for i in range(width)])
    return means.select(*keys, F.array(*[f"__{i}" for i in range(width)]).cast("array<double>").alias("vector"))


@dataclass(frozen=True)
class Network:
    """Weights of a graph network: layers (of the own vector, of the neighbours' mean, bias, scale, shift), then heads of
    two layers each (w1, b1, w2, b2): a logit a node, risk and regression a graph, confidence a graph."""

    layers: tuple[tuple[np.ndarray, ...], ...]
    node: tuple[np.ndarray, ...]
    risk: tuple[np.ndarray, ...]
    confidence: tuple[np.ndarray, ...]
    history: int


def seeded_network(width: int, hidden: int = 16, out: int = 8, layers: int = 3, history: int = 4, seed: int = 11) -> Network:
    """A network of given sizes with weights from a seed, for where none is trained."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    sizes = [width, *[hidden] * (layers - 1), out]
    head = lambda a, b, c: (draw(a, b), np.zeros(b), draw(b, c), np.zeros(c))
    steps = tuple((draw(a, b), draw(a, b), np.zeros(b), np.ones(b), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False))
    return Network(steps, head(out, 8, 1), head(out + history, 8, 2), head(out + history, 8, 1), history)


def _head(x: np.ndarray, w: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def _layer(own: np.ndarray, other: np.ndarray, bias: np.ndarray, scale: np.ndarray, shift: np.ndarray):
    @F.pandas_udf("array<double>")
    def apply(vector: pd.Series, mean: pd.Series) -> pd.Series:
        x = np.stack(vector)
        m = np.stack([np.zeros(x.shape[1]) if v is None else np.asarray(v) for v in mean])
        return pd.Series(list(np.maximum((x @ own + m @ other + bias) * scale + shift, 0)))

    return apply


def network_scores(vectors: DataFrame, edges: DataFrame, network: Network, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((snapshot_id, node_id, logit), (snapshot_id, risk, regression_logit, confidence)) by a network of given weights.

    A layer takes neighbour means in DataFrame operations and applies its matrices in an Arrow batch; the
    weights are a few thousand numbers. Graphs take the mean of their node vectors and ``history`` (snapshot_id, history
    array), zeros where there is none.
    """
    current = vectors.select("snapshot_id", "node_id", "vector")
    edges = stored(edges.select("snapshot_id", "source_id", "target_id"), "network-edges")  # made once, not by every layer
    for weights in network.layers:
        both = current.join(neighbour_mean(current, edges, len(weights[0])).withColumnRenamed("vector", "mean"), ["snapshot_id", "node_id"], "left")
        current = stored(both.select("snapshot_id", "node_id", _layer(*weights)("vector", "mean").alias("vector")), "network", replaces=current)
    discard(edges)

    @F.pandas_udf("double")
    def logit(vector: pd.Series) -> pd.Series:
        return pd.Series(_head(np.stack(vector), network.node)[:, 0])

    @F.pandas_udf("risk double, regression_logit double, confidence double")
    def graph(vector: pd.Series, past: pd.Series) -> pd.DataFrame:
        x = np.concatenate([np.stack(vector), np.stack([np.zeros(network.history) if v is None else np.asarray(v) for v in past])], axis=1)
        risk, sigmoid = _head(x, network.risk), lambda v: 1 / (1 + np.exp(-v))
        return pd.DataFrame({"risk": 100 * sigmoid(risk[:, 0]), "regression_logit": risk[:, 1], "confidence": sigmoid(_head(x, network.confidence)[:, 0])})

    graphs = mean_pool(current, network.layers[-1][0].shape[1])
    graphs = graphs.join(history, "snapshot_id", "left") if history is not None else graphs.withColumn("history", F.lit(None).cast("array<double>"))
    return current.select("snapshot_id", "node_id", logit("vector").alias("logit")), graphs.select("snapshot_id", graph("vector", "history").alias("g")).select("snapshot_id", "g.*")


def ranked_files(nodes: DataFrame, logits: DataFrame, k: int = 10) -> DataFrame:
    """K7: the k file nodes of highest probability, with importance and rank."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    rows = nodes.where("node_type = 'file'").join(logits, ["snapshot_id", "node_id"]).withColumn("p", p)
    place = F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("p"), "node_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("snapshot_id", "file_path", "p", C.clip(F.abs("logit"), 0, 1).alias("importance"), "rank")


def top_nodes(importance: DataFrame, nodes: DataFrame, k: int = 15) -> DataFrame:
    """The k most important nodes of a snapshot, clipped to 0..1; names fall back to the id."""
    place = F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("importance"), "node_id"))
    top = importance.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(nodes.select("snapshot_id", "node_id", "file_path"), ["snapshot_id", "node_id"], "left").select("snapshot_id", "node_id", C.clip(F.col("importance"), 0, 1).alias("importance"), "rank", F.coalesce("file_path", "node_id").alias("label"))


def top_edges(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k edges of highest score of a snapshot, clipped."""
    place = F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("score"), "source_id", "target_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).select("snapshot_id", "source_id", "target_id", C.clip(F.col("score"), 0, 1).alias("score"), "rank")


def heuristic_importance(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """K5: .1, .5 more for nodes of changed paths (path), .2 more for file nodes, at most 1."""
    hit = changed.select(F.col("path").alias("file_path"), F.lit(0.5).alias("hit")).distinct()
    score = F.lit(0.1) + F.coalesce("hit", F.lit(0.0)) + F.when(F.col("node_type") == "file", 0.2).otherwise(0.0)
    return nodes.join(hit, "file_path", "left").select("snapshot_id", "node_id", F.least(score, F.lit(1.0)).alias("importance"))


def heuristic_files(nodes: DataFrame, changed: DataFrame, p: float, k: int = 10) -> DataFrame:
    """K6: changed files first, then others, k in all; probability p + .05 i, at most .99."""
    hit = changed.select(F.col("path").alias("file_path"), F.lit(0).alias("late")).distinct()
    rows = nodes.where("node_type = 'file'").join(hit, "file_path", "left").withColumn("late", F.coalesce("late", F.lit(1)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy("late", "file_path"))).where(F.col("rank") <= k)
    return rows.select("snapshot_id", "file_path", F.least(p + 0.05 * (F.col("rank") - 1), F.lit(0.99)).alias("p"), "rank")
