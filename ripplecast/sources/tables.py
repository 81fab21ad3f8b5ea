"""Sources and sinks: benchmark suites, snapshots, reports, predictions, vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from .versions import bucket, change, current, read

SUITE = "name string, description string, samples array<struct<id:string,description:string,diff:string,ground_truth:struct<risk_score:double,is_regression:boolean,affected_files:array<string>>>>"
SNAPSHOT = "repository_id string, sha string, nodes array<struct<node_id:string,node_type:string,name:string,file_path:string,properties:map<string,string>>>, edges array<struct<source_id:string,target_id:string,edge_type:string,weight:double,properties:map<string,string>>>"
PAYLOAD = "similar_commits array<struct<sha:string,similarity:double,message:string,is_regression:boolean>>, reviewers array<struct<username:string,score:double>>"


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """(suite, sample_id, description, diff, risk_score, is_regression, affected_files) of JSON suites; the suite's name defaults to the file's stem."""
    raw = spark.read.schema(SUITE).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    rows = raw.select(F.coalesce("name", stem).alias("suite"), F.explode("samples").alias("s"))
    truth = F.col("s.ground_truth")
    return rows.select(
        "suite", F.col("s.id").alias("sample_id"), F.coalesce("s.description", F.lit("")).alias("description"), F.coalesce("s.diff", F.lit("")).alias("diff"),
        truth["risk_score"].alias("risk_score"), truth["is_regression"].alias("is_regression"), F.coalesce(truth["affected_files"], F.array().cast("array<string>")).alias("affected_files"),
    )


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges (each with repository_id, sha) by repository and sha12; snapshots in the data replace theirs, others stay.

    A snapshot that only one of the tables has rows of loses those it had in the other. Both tables change at once.
    """
    key = ["repository_id", "sha12"]
    keyed = [df.withColumn("sha12", F.substring("sha", 1, 12)).drop("sha") for df in (nodes, edges)]
    owners = stored(keyed[0].select(*key).unionByName(keyed[1].select(*key)).distinct(), "snapshot-owners")
    keyed = [df.where(F.coalesce(*[F.col(c).cast("string") for c, kind in df.dtypes if c not in key and not kind.startswith("map")]).isNotNull()) for df in keyed]
    change(nodes.sparkSession, path, ["repository_id"], {"nodes": (keyed[0], owners), "edges": (keyed[1], owners)})


def read_snapshot(spark: SparkSession, path: str, name: str, repository_id: str | None = None, sha: str | None = None) -> DataFrame:
    """Nodes or edges; of a repository only its bucket is read. A stored sha12 that is a prefix of sha also answers."""
    manifest, only = current(spark, path), None
    if repository_id is not None and manifest["parts"]:
        only = [spark.range(1).select(F.lit(repository_id).alias("repository_id")).select(bucket(["repository_id"], manifest["parts"])).first()[0]]
    rows = read(spark, path, name, only, manifest)
    if repository_id is not None:
        rows = rows.where(F.col("repository_id") == repository_id)
    if sha is not None:
        rows = rows.where(F.lit(sha).startswith(F.col("sha12").cast("string")))
    return rows


def import_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON snapshots, with weight 1 and no properties where these are missing."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    none = F.create_map().cast("map<string,string>")
    nodes = raw.select("repository_id", "sha", F.inline("nodes")).withColumn("properties", F.coalesce("properties", none))
    edges = raw.select("repository_id", "sha", F.inline("edges")).withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "properties": F.coalesce("properties", none)})
    return nodes, edges


def append_report(report: DataFrame, path: str) -> None:
    """S9."""
    report.write.mode("append").parquet(path)


def list_reports(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The newest n."""
    return spark.read.parquet(path).orderBy(F.desc("created_s"), "report_id").limit(n)


def write_predictions(predictions: DataFrame, files: DataFrame, path: str) -> None:
    """Predictions (change_id ...) with a JSON payload, and their files (change_id ...).

    A prediction takes the place of the one of its id, and its files of that one's files; others stay, and both tables change
    at once. So a pending or failed prediction is later replaced by a completed one.
    """
    owners = stored(predictions.select("change_id").distinct(), "prediction-owners")
    change(predictions.sparkSession, path, ["change_id"], {"predictions": (predictions, owners), "files": (files, owners)})


def read_payload(predictions: DataFrame) -> DataFrame:
    """Similar commits and reviewers from the JSON column ``payload``, missing fields by default."""
    p = predictions.withColumn("p", F.from_json("payload", PAYLOAD))
    commits = F.transform(F.coalesce("p.similar_commits", F.from_json(F.lit("[]"), "array<struct<sha:string,similarity:double,message:string,is_regression:boolean>>")), lambda c: F.struct(
        F.coalesce(c["sha"], F.lit("")).alias("sha"), F.coalesce(c["similarity"], F.lit(0.0)).alias("similarity"), F.coalesce(c["message"], F.lit("")).alias("message"), F.coalesce(c["is_regression"], F.lit(False)).alias("is_regression")))
    reviewers = F.transform(F.coalesce("p.reviewers", F.from_json(F.lit("[]"), "array<struct<username:string,score:double>>")), lambda c: F.struct(F.coalesce(c["username"], F.lit("")).alias("username"), F.coalesce(c["score"], F.lit(0.0)).alias("score")))
    return p.withColumns({"similar_commits": commits, "reviewers": reviewers}).drop("p")
