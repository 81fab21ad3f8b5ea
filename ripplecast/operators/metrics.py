"""Evaluation metrics and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Targets of a suite, and what a missing metric counts as.
TARGETS = {"precision_at_k": 0.70, "recall_at_k": 0.65, "f1": 0.67, "roc_auc": 0.85, "rmse": 15.0, "mrr": 0.60, "ece": 0.05}
LOWER_IS_BETTER = ("rmse", "ece")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, rmse and mae of risk against true_risk."""
    off = F.col("risk") - F.col("true_risk")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"))


def confusion(rows: DataFrame, keys: list[str], at: float = 0.5) -> DataFrame:
    """Tp, fp, fn, tn, precision, recall, f1 of p >= at against truth."""
    yes, truth = F.col("p") >= at, F.col("truth")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = rows.groupBy(*keys).agg(count(yes & truth).alias("tp"), count(yes & ~truth).alias("fp"), count(~yes & truth).alias("fn"), count(~yes & ~truth).alias("tn"))
    out = out.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve, .5 where a class is absent.

    Counts by distinct p, then a running sum of the negatives below, by bins of p and inside them: wins and half the ties, without pairs.
    """
    bin_ = F.floor(F.col("p") * 4096).alias("__bin")
    by_p = rows.groupBy(*keys, "p").agg(F.sum(F.col("truth").cast("long")).alias("pos"), F.sum((~F.col("truth")).cast("long")).alias("neg")).withColumn("__bin", bin_)
    # negatives below: those of the bins of p before, at most 4097 rows a key, and those before in the bin
    bins = by_p.groupBy(*keys, "__bin").agg(F.sum("neg").alias("own"))
    bins = bins.select(*keys, "__bin", (F.sum("own").over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__bin")) - F.col("own")).alias("before"))
    inside = F.sum("neg").over(W.partitionBy(*keys, "__bin").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    won = F.col("pos") * (F.col("before") + F.coalesce("below", F.lit(0)) + F.col("neg") / 2)
    out = by_p.withColumn("below", inside).join(bins, [*keys, "__bin"]).groupBy(*keys).agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("roc_auc"))


def ranking(ranked: DataFrame, truths: DataFrame, k: int = 5) -> DataFrame:
    """(change_id, precision_at_k, recall_at_k, reciprocal, average_precision) of changes with both lists.

    ranked: change_id, path, rank; truths: change_id, path.
    """
    truth = truths.select("change_id", "path").distinct().withColumn("hit", F.lit(1))
    size = truth.groupBy("change_id").agg(F.count("*").alias("n_true"))
    rows = ranked.join(truth, ["change_id", "path"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(W.partitionBy("change_id").orderBy("rank"))
    rows = rows.withColumn("at", F.when(F.col("hit") == 1, so_far / F.col("rank")))
    top = F.col("rank") <= k
    out = rows.groupBy("change_id").agg(
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("at").alias("ap"),
    ).join(size, "change_id")
    return out.select(
        "change_id", (F.col("hits") / F.least(F.col("n"), F.lit(k))).alias("precision_at_k"), (F.col("hits") / F.col("n_true")).alias("recall_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal"), (F.coalesce("ap", F.lit(0.0)) / F.col("n_true")).alias("average_precision"),
    )


def calibration(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error: bins of p, weighted gap of mean p and share of truth."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    by = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg(F.col("truth").cast("double")).alias("y"))
    return by.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def macro(long: DataFrame) -> DataFrame:
    """(metric, value): mean over the samples that have the metric (sample_id, metric, value)."""
    return long.groupBy("metric").agg(F.avg("value").alias("value"))


def sample_passes() -> Column:
    """f1 at least .8 of its target and mae at most the rmse target."""
    return (F.col("f1") >= 0.8 * TARGETS["f1"]) & (F.col("mae") <= TARGETS["rmse"])


def suite_passes() -> Column:
    """Every target met; a missing metric counts against it."""
    ok = F.lit(True)
    for name, target in TARGETS.items():
        low = name in LOWER_IS_BETTER
        value = F.coalesce(F.col(name), F.lit(float("inf") if low else 0.0))
        ok = ok & ((value <= target) if low else (value >= target))
    return ok


def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """E1-E3 and E7 over all rows of each key, without keys over all rows; with the sample as the key, metrics a sample."""
    own = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    return errors(rows, own).join(confusion(rows, own), own).join(auc(rows, own), own).join(calibration(rows, own), own).drop("__all")


def sample_metrics(samples: DataFrame, predictions: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """(suite, sample_id, metrics, passed) of the samples that have a prediction; the others are skipped.

    samples: suite, sample_id, risk_score, is_regression, affected_files; predictions: sample_id, risk, p; ranked: sample_id, path, rank.
    A sample without affected or ranked files has no ranking metrics.
    """
    met = samples.join(predictions, "sample_id").select("suite", "sample_id", "risk", F.col("risk_score").alias("true_risk"), "p", F.col("is_regression").alias("truth"))
    truths = samples.select(F.col("sample_id").alias("change_id"), F.explode("affected_files").alias("path"))
    files = ranking(ranked.withColumnRenamed("sample_id", "change_id"), truths, k).withColumnRenamed("change_id", "sample_id").withColumnRenamed("reciprocal", "mrr")
    rows = pooled(met, ["suite", "sample_id"]).drop("n").join(files, "sample_id", "left")
    return rows.withColumn("passed", sample_passes())


def evaluate_suites(samples: DataFrame, predictions: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row a suite: mean of each metric over the samples that have it, the verdict on the means (``passed``), and the nested samples."""
    rows = sample_metrics(samples, predictions, ranked, k)
    report = suite_report(rows)
    return report.withColumn("passed", suite_passes())


def suite_report(rows: DataFrame) -> DataFrame:
    """One row a suite with its nested samples, in order of id, and the means of their metrics; rows: suite, sample_id, metrics."""
    metrics = [c for c, kind in rows.dtypes if c not in ("suite", "sample_id") and kind != "boolean"]
    return rows.groupBy("suite").agg(F.array_sort(F.collect_list(F.struct("sample_id", *[c for c in rows.columns if c not in ("suite", "sample_id")]))).alias("samples"), *[F.avg(m).alias(m) for m in metrics])


def summary_views(predictions: DataFrame, files: DataFrame, reviewers: DataFrame, prefix: str = "") -> list[str]:
    """Temporary views repository_risk (B1), prediction_summary (B4) and reviewer_expertise (reviewers by area); their names."""
    views = {
        "repository_risk": risk_summary(predictions), "prediction_summary": detail(predictions, files, reviewers),
        "reviewer_expertise": reviewers.groupBy("username").agg(F.count("*").alias("n_suggested"), F.avg("score").alias("mean_score")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


# Enumerations that rows are checked against.
ENUMERATIONS = {
    "role": ("admin", "analyst", "viewer", "service_account"),
    "provider": ("github", "gitlab", "bitbucket", "local"),
    "status": ("pending", "processing", "completed", "failed"),
    "node_type": ("file", "class", "function", "module", "service"),
    "edge_type": ("import", "call", "inheritance", "composition", "api_call", "database_access", "message_queue", "microservice"),
    "issue_type": ("bug", "regression", "feature", "tech_debt"),
    "job_status": ("queued", "running", "completed", "failed"),
    "entity_type": ("commit", "pull_request", "issue", "file", "document"),
}
RANGES = {"risk": (0, 100), "p": (0, 1), "confidence": (0, 1)}


def constraints(rows: DataFrame) -> DataFrame:
    """Rows with ``broken``, the names of the columns that break their rule, in order; empty for valid rows.

    Checked is what rows has of RANGES, rank (at least 1) and ENUMERATIONS; null breaks nothing.
    """
    rules = {c: ~F.col(c).between(low, high) for c, (low, high) in RANGES.items()} | {"rank": F.col("rank") < 1} | {c: ~F.col(c).isin(*v) for c, v in ENUMERATIONS.items()}
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(rule, c) for c, rule in rules.items() if c in rows.columns])))


def risk_summary(predictions: DataFrame, cap: int = 500, high: float = 75) -> DataFrame:
    """B1: (repository_id, total, avg_risk, high_risk): the last two over the newest ``cap`` completed ones, total over all."""
    place = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("created_s"), F.desc("change_id")))
    done = predictions.where("status = 'completed'").withColumn("n", place).where(F.col("n") <= cap)
    part = done.groupBy("repository_id").agg(F.round(F.avg(F.coalesce("risk", F.lit(0.0))), 2).alias("avg_risk"), F.sum((F.col("risk") >= high).cast("long")).alias("high_risk"))
    return predictions.groupBy("repository_id").agg(F.count("*").alias("total")).join(part, "repository_id", "left").fillna({"avg_risk": 0.0, "high_risk": 0})


def risk_trend(predictions: DataFrame, n: int = 20) -> DataFrame:
    """B2: the newest n completed predictions of a repository."""
    place = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("created_s"), F.desc("change_id")))
    return predictions.where("status = 'completed'").withColumn("place", place).where(F.col("place") <= n).select("repository_id", "change_id", F.coalesce("risk", F.lit(0.0)).alias("risk"), "created_s", "place")


def status_counts(predictions: DataFrame) -> DataFrame:
    """Counts by repository and status, with totals a repository and overall."""
    return predictions.rollup("repository_id", "status").agg(F.count("*").alias("n"))


def detail(predictions: DataFrame, files: DataFrame, reviewers: DataFrame) -> DataFrame:
    """One row a prediction, with its files and reviewers in order of rank."""
    nested = lambda df, name: df.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in df.columns if c not in ("change_id", "rank")]))).alias(name))
    return predictions.join(nested(files, "files"), "change_id", "left").join(nested(reviewers, "reviewers"), "change_id", "left")
