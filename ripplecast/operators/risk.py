"""Risk features, models, ensemble, attribution and explanations of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.storage import stored

# Features in order, what each is divided by, and the weight of each in the linear model.
FEATURES = ("n_files", "added", "deleted", "complexity_delta", "deleted_ratio", "n_functions", "renames", "regression_rate", "max_similarity", "surface")
SCALES = (20, 500, 500, 30, 1, 25, 10, 1, 1, 5)
WEIGHTS = (12, 8, 10, 14, 11, 9, 6, 18, 7, 13)
BASE = 8.0
E_APPROXIMATION = 2.718281828
ENSEMBLE = {"graph": 0.5, "linear": 0.3, "history": 0.2}


def history(matches: DataFrame) -> DataFrame:
    """K1, K8: per change the share of regressions, the largest and mean similarity, and the risk and probability they signal.

    Changes without matches don't appear; their signal is (15, .1).
    """
    out = matches.groupBy("change_id").agg(F.avg(F.col("is_regression").cast("double")).alias("regression_rate"), F.max("similarity").alias("max_similarity"), F.avg("similarity").alias("mean_similarity"))
    return out.withColumns({
        "history_risk": F.least(20 + 60 * F.col("regression_rate") + 15 * F.col("mean_similarity"), F.lit(95.0)),
        "history_p": F.least(0.7 * F.col("regression_rate") + 0.25 * F.col("mean_similarity"), F.lit(0.95)),
    })


def features(changes: DataFrame, past: DataFrame) -> DataFrame:
    """K2: the ten scaled features as columns f_<name>; changes needs the sizes, past what history returns."""
    rows = changes.join(past, "change_id", "left").withColumn("deleted_ratio", F.when(F.col("added") + F.col("deleted") > 0, F.col("deleted") / (F.col("added") + F.col("deleted"))).otherwise(0.0))
    rows = rows.withColumns({"history_risk": F.coalesce("history_risk", F.lit(15.0)), "history_p": F.coalesce("history_p", F.lit(0.1))})
    value = lambda n: F.abs(F.coalesce(F.col(n), F.lit(0)).cast("double"))
    return rows.withColumns({f"f_{n}": C.share(value(n), s) for n, s in zip(FEATURES, SCALES, strict=True)})


def linear_score(rows: DataFrame) -> DataFrame:
    """K3: linear_risk and linear_p from the features."""
    logit = F.lit(BASE)
    for n, w in zip(FEATURES, WEIGHTS, strict=True):
        logit = logit + w * F.col(f"f_{n}")
    p = 1 / (1 + F.pow(F.lit(E_APPROXIMATION), -(logit - 50) / 12))
    return rows.withColumns({"linear_p": p, "linear_risk": C.clip(0.85 * logit + 20 * p, 0, 100)})


def graph_score(rows: DataFrame, has_graph: bool | Column = True) -> DataFrame:
    """K4: graph_risk, graph_p and graph_confidence by the heuristic without a network; a ``memory`` array adds its first 32 sizes."""
    risk = F.least(15 + 0.04 * F.col("added") + 0.06 * F.col("deleted") + 1.5 * F.abs("complexity_delta") + 2.5 * F.col("n_files"), F.lit(90.0))
    if "memory" in rows.columns:
        head = F.slice("memory", 1, 32)
        mean = F.aggregate(head, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.greatest(F.size(head), F.lit(1))
        risk = F.when(F.col("memory").isNull(), risk).otherwise(F.least(risk + 5 * mean, F.lit(95.0)))
    ratio = F.when(F.col("added") + F.col("deleted") > 0, F.col("deleted") / (F.col("added") + F.col("deleted"))).otherwise(0.0)
    return rows.withColumns({"graph_risk": risk, "graph_p": F.least(risk / 100 + 0.2 * ratio, F.lit(0.95)), "graph_confidence": F.when(F.lit(has_graph) if isinstance(has_graph, bool) else has_graph, 0.55).otherwise(0.35)})


def learned_score(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    """Rows of ``graph_score`` with the scores of a trained network in their place, for changes that graphs (change_id, risk,
    regression_logit, confidence; as ``graph.network_scores`` gives them) has."""
    own = graphs.select("change_id", C.clip(F.col("risk"), 0, 100).alias("__risk"), (1 / (1 + F.exp(-F.col("regression_logit")))).alias("__p"), C.clip(F.col("confidence"), 0, 1).alias("__confidence"))
    both = rows.join(own, "change_id", "left")
    return both.withColumns({f"graph_{n}": F.coalesce(f"__{n}", f"graph_{n}") for n in ("risk", "p", "confidence")}).drop("__risk", "__p", "__confidence")


def _variance(columns: list[Column]) -> Column:
    mean = sum(columns[1:], columns[0]) / len(columns)
    squares = [(c - mean) * (c - mean) for c in columns]
    return sum(squares[1:], squares[0]) / len(columns)


def ensemble(rows: DataFrame, weights: dict[str, float] = ENSEMBLE) -> DataFrame:
    """Risk, p and confidence from the three components."""
    total = sum(weights.values())
    mix = lambda what: sum((w / total * F.col(f"{n}_{what}") for n, w in weights.items()), F.lit(0.0))
    apart = F.least((_variance([F.col(f"{n}_risk") for n in weights]) / 2500 + _variance([F.col(f"{n}_p") for n in weights])) / 2, F.lit(1.0))
    return rows.withColumns({
        "risk": C.clip(mix("risk"), 0, 100), "p": C.clip(mix("p"), 0, 1),
        "confidence": C.clip(0.35 + 0.45 * F.col("graph_confidence") + 0.2 * (1 - apart), 0, 1),
    })


def merge_files(files: DataFrame, first_match: DataFrame, k: int = 10) -> DataFrame:
    """(change_id, path, p, importance, rank): the largest p and importance a path, the first three paths lifted where the
    first similar commit was a regression.

    files: change_id, path, p, importance, place; first_match: change_id, similarity, is_regression (one row a change).
    """
    merged = files.groupBy("change_id", "path").agg(F.max("p").alias("p"), F.max("importance").alias("importance"), F.min("place").alias("place"))
    order = F.row_number().over(W.partitionBy("change_id").orderBy("place"))
    lift = F.when(F.col("is_regression") & (F.col("order") <= 3), 0.15 * F.col("similarity"))
    merged = merged.withColumn("order", order).join(first_match, "change_id", "left").withColumn("p", F.when(lift.isNotNull(), F.least(F.col("p") + lift, F.lit(0.99))).otherwise(F.col("p")))
    rank = F.row_number().over(W.partitionBy("change_id").orderBy(F.desc("p"), "order"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("change_id", "path", "p", "importance", "rank")


def attributed_changes(rows: DataFrame, keep: Sequence[str] = ("change_id",)) -> DataFrame:
    """X1, a row a change: (columns of ``keep``, output, items), items an array of feature, value and contribution (weight times value), largest first; output adds the base."""
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("value"), (w * F.col(f"f_{n}")).alias("contribution")) for n, w in zip(FEATURES, WEIGHTS, strict=True)])
    output = F.lit(BASE) + F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["contribution"])
    ordered = F.array_sort(F.transform(parts, lambda x: F.struct((-F.round(F.abs(x["contribution"]), 9)).alias("order"), x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution"))))
    return rows.select(*keep, output.alias("output"), F.transform(ordered, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution"))).alias("items"))


def attributions(rows: DataFrame) -> DataFrame:
    """(change_id, feature, value, contribution, output, rank), a row a change and feature."""
    return attributed_changes(rows).select("change_id", "output", F.posexplode("items").alias("at", "e")).select("change_id", "e.feature", "e.value", "e.contribution", "output", (F.col("at") + 1).alias("rank"))


def top_drivers(attributed: DataFrame) -> DataFrame:
    """Of the first three attributions those of size over .01."""
    return attributed.where((F.col("rank") <= 3) & (F.abs("contribution") > 0.01))


def driver_names(attributed: DataFrame) -> DataFrame:
    """X2 of ``attributed_changes``: its kept columns and drivers, the features of ``top_drivers`` in order."""
    return attributed.select(*[c for c in attributed.columns if c not in ("output", "items")], F.transform(F.filter(F.slice("items", 1, 3), lambda x: F.abs(x["contribution"]) > 0.01), lambda x: x["feature"]).alias("drivers"))


def report(attributed: DataFrame) -> DataFrame:
    """One JSON report a change: method, base, output and the ordered attributions, of ``attributed_changes``, without a shuffle, or of the rows of ``attributions``."""
    item = lambda rank, x: F.struct(rank.alias("rank"), x("feature").alias("feature"), F.round(x("value"), 9).alias("value"), F.round(x("contribution"), 9).alias("contribution"))
    if "items" in attributed.columns:
        rows = attributed.select("change_id", F.round("output", 9).alias("output"), F.transform("items", lambda x, i: item(i + 1, lambda c: x[c])).alias("items"))
    else:
        rows = attributed.groupBy("change_id").agg(F.round(F.first("output"), 9).alias("output"), F.array_sort(F.collect_list(item(F.col("rank"), F.col))).alias("items"))
    return rows.select("change_id", F.to_json(F.struct(F.lit("exact linear").alias("method"), F.lit(BASE).alias("base"), "output", F.size("items").alias("n"), "items")).alias("report"))


# The sentences of an explanation.
ROOT_CAUSE = "The change touches %d file(s) (+%d/-%d lines) with complexity delta %+.1f. Modified symbols include: %s."
RISK_TEXT = "Ensemble risk score is %.1f/100 with regression probability %.0f%% and confidence %.0f%%. GNN contributed %.1f, historical signal: %s."
PAST_TEXT, NO_PAST_TEXT = "%d similar past commit(s) led to regressions", "no strongly similar regression commits found"
DRIVERS_TEXT = " Top SHAP drivers: %s."
FILES_TEXT = "Top affected files by break probability: %s. These are ranked by GNN node scores fused with graph proximity to changed files."
REVIEWERS_TEXT = "Suggested reviewers (%s) have the highest ownership overlap with affected paths and matching expertise areas."
NO_REVIEWERS_TEXT = "No reviewer profiles are configured for this repository."


def sentences(rows: DataFrame) -> DataFrame:
    """root_cause, risk_text, files_text, reviewers_text.

    rows: changed_files, symbols, affected, reviewers, drivers (arrays of text), sizes, scores, n_past. Drivers, where there are
    any, end the risk text.
    """
    listed = lambda c, n, none: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), ", ")).otherwise(none)
    past = F.when(F.col("n_past") > 0, F.format_string(PAST_TEXT, "n_past")).otherwise(NO_PAST_TEXT)
    risk = F.format_string(RISK_TEXT, "risk", F.col("p") * 100, F.col("confidence") * 100, "graph_risk", past)
    return rows.withColumns({
        "root_cause": F.format_string(ROOT_CAUSE, F.size("changed_files"), "added", "deleted", "complexity_delta", listed("symbols", 5, "none detected")),
        "risk_text": F.concat(risk, F.when(F.size("drivers") > 0, F.format_string(DRIVERS_TEXT, F.array_join("drivers", ", "))).otherwise("")),
        "files_text": F.format_string(FILES_TEXT, listed("affected", 5, "none flagged")),
        "reviewers_text": F.when(F.size("reviewers") > 0, F.format_string(REVIEWERS_TEXT, listed("reviewers", 3, ""))).otherwise(NO_REVIEWERS_TEXT),
    })


def context_json(rows: DataFrame, keep: Sequence[str] = ("change_id",)) -> DataFrame:
    """(columns of ``keep``, context): rounded scores, the diff's sizes and the heads of the lists as one JSON document.

    rows: as for sentences, and similar_commits (array of sha, similarity, is_regression, message) and similar_bugs (array).
    """
    commits = F.transform(F.slice("similar_commits", 1, 5), lambda c: F.struct(F.substring(c["sha"], 1, 8).alias("sha"), F.round(c["similarity"], 3).alias("similarity"), c["is_regression"].alias("is_regression"), F.substring(c["message"], 1, 120).alias("message")))
    return rows.select(*keep, F.to_json(F.struct(
        F.struct(F.round("risk", 1).alias("risk_score"), F.round("p", 3).alias("regression_probability"), F.round("confidence", 3).alias("confidence_score"), F.round("graph_risk", 1).alias("gnn_risk_score"), F.round("graph_p", 3).alias("gnn_regression_probability")).alias("ml_predictions"),
        F.struct(F.slice("changed_files", 1, 15).alias("changed_files"), F.col("added").alias("added_lines"), F.col("deleted").alias("deleted_lines"), F.slice("symbols", 1, 10).alias("modified_functions"), F.round("complexity_delta", 2).alias("complexity_delta")).alias("diff_summary"),
        F.slice("affected", 1, 8).alias("affected_files"), commits.alias("similar_commits"), F.slice("similar_bugs", 1, 3).alias("similar_bugs"), F.slice("reviewers", 1, 5).alias("suggested_reviewers"),
    )).alias("context"))


def trained(rows: DataFrame) -> DataFrame:
    """(change_id, split, risk_hat, p_hat, p_trees): least squares for the risk, logistic regression and boosted trees for the regression flag.

    rows: the features, risk_label, is_regression, split. Only rows of split 'train' are learned from.
    """
    # made once: each fit, and each of their passes that is not cached, would make the features again
    rows = stored(rows.select("change_id", "split", "risk_label", *[f"f_{n}" for n in FEATURES], F.col("is_regression").cast("double").alias("y")), "training-rows")
    data = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="x").transform(rows)
    own = data.where("split = 'train'")
    risk = LinearRegression(featuresCol="x", labelCol="risk_label", predictionCol="risk_hat", solver="normal", regParam=0.0).fit(own)
    flag = LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="pr", rawPredictionCol="raw", predictionCol="yes", maxIter=20).fit(own)
    trees = GBTClassifier(featuresCol="x", labelCol="y", predictionCol="yt", maxIter=5, maxDepth=3, seed=3).fit(own)
    out = trees.transform(flag.transform(risk.transform(data)))
    return out.select("change_id", "split", "risk_hat", vector_to_array("pr")[1].alias("p_hat"), vector_to_array("probability")[1].alias("p_trees"))


def trained_nodes(features: DataFrame, targets: DataFrame, weight: float = 0.5) -> DataFrame:
    """(snapshot_id, node_id, p_hat): logistic regression of affected files on node features (features array); nodes that
    are no files have weight 0."""
    rows = features.join(targets, ["snapshot_id", "node_id"]).select("snapshot_id", "node_id", "features", F.col("target").alias("y"), F.when(F.col("is_file"), weight).otherwise(0.0).alias("w"))
    rows = stored(rows, "training-nodes").withColumn("x", array_to_vector(F.transform("features", lambda x: x.cast("double"))))  # made once for the fit and the scores
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", probabilityCol="pr", rawPredictionCol="raw", predictionCol="yes", maxIter=20, regParam=1e-4).fit(rows)
    return model.transform(rows).select("snapshot_id", "node_id", vector_to_array("pr")[1].alias("p_hat"))


def score(changes: DataFrame, matches: DataFrame, has_graph: bool = True) -> DataFrame:
    """All pending changes through features, components and ensemble; K14 with empty matches and without a graph."""
    return ensemble(graph_score(linear_score(features(changes, history(matches))), has_graph))


def predicted_files(rows: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """K6: (change_id, path, p, importance, place): the changed files in order, then the graph's other files by name, k in all.

    rows: change_id, repository_id, graph_p, changed_files; files (repository_id, path): file nodes of the repository's graph. The
    i-th has probability graph_p + .05 i, at most .99; importance is .1, .5 more if changed, .2 more if the graph holds it, and .3 for
    changed files outside the graph. Of a repository's files only the first that could be needed go on.
    """
    own = rows.select("change_id", "repository_id", "graph_p", F.posexplode("changed_files").alias("place", "path")).groupBy("change_id", "repository_id", "graph_p", "path").agg(F.min("place").alias("place"))
    known = files.select("repository_id", "path").distinct().withColumn("known", F.lit(True))
    mine = own.join(known, ["repository_id", "path"], "left").select("change_id", "repository_id", "graph_p", "path", F.col("place").cast("long").alias("order"), F.when(F.col("known"), 0.8).otherwise(0.3).alias("importance"))
    most = 2 * k  # k others are left even where k changed files stand among them
    heads = known.withColumn("n", F.row_number().over(W.partitionBy("repository_id").orderBy("path"))).where(F.col("n") <= most).select("repository_id", "path", "n")
    other = rows.select("change_id", "repository_id", "graph_p").join(heads, "repository_id").join(own.select("change_id", "path"), ["change_id", "path"], "left_anti")
    other = other.select("change_id", "repository_id", "graph_p", "path", (F.col("n") + (1 << 40)).alias("order"), F.lit(0.3).alias("importance"))
    place = F.row_number().over(W.partitionBy("change_id").orderBy("order"))
    both = mine.unionByName(other).withColumn("place", place).where(F.col("place") <= k)
    return both.select("change_id", "path", F.least(F.col("graph_p") + 0.05 * (F.col("place") - 1), F.lit(0.99)).alias("p"), "importance", "place")
