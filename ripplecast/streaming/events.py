"""Event rules as Structured Streaming queries; each works on a batch DataFrame as well, which tests use as its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.diffs import synthetic_diff
from ..sources.versions import change

GITHUB = "action string, pull_request struct<number:long,title:string,body:string,head:struct<sha:string>>, repository struct<full_name:string,clone_url:string>"
GITLAB = "object_kind string, project struct<path_with_namespace:string,git_http_url:string>, object_attributes struct<action:string,iid:long,title:string,description:string,last_commit:struct<id:string>>"
GITHUB_ACTIONS, GITLAB_ACTIONS = ("opened", "synchronize", "reopened"), ("open", "update", "reopen")


def webhook_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines (provider, at timestamp, payload string)."""
    return spark.readStream.schema("provider string, at timestamp, payload string").json(path)


def request_events(rows: DataFrame) -> DataFrame:
    """Both providers' payloads as (provider, at, repo, url, number, title, body, sha); other kinds and actions are dropped."""
    a = rows.where("provider = 'github'").withColumn("j", F.from_json("payload", GITHUB))
    a = a.where(F.col("j.pull_request").isNull() | F.col("j.action").isin(*GITHUB_ACTIONS)).select(
        "provider", "at", F.col("j.repository.full_name").alias("repo"), F.col("j.repository.clone_url").alias("url"), F.col("j.pull_request.number").alias("number"),
        F.col("j.pull_request.title").alias("title"), F.col("j.pull_request.body").alias("body"), F.col("j.pull_request.head.sha").alias("sha"),
    )
    b = rows.where("provider = 'gitlab'").withColumn("j", F.from_json("payload", GITLAB)).where((F.col("j.object_kind") == "merge_request") & F.col("j.object_attributes.action").isin(*GITLAB_ACTIONS))
    b = b.select(
        "provider", "at", F.col("j.project.path_with_namespace").alias("repo"), F.col("j.project.git_http_url").alias("url"), F.col("j.object_attributes.iid").alias("number"),
        F.col("j.object_attributes.title").alias("title"), F.col("j.object_attributes.description").alias("body"), F.col("j.object_attributes.last_commit.id").alias("sha"),
    )
    return a.unionByName(b)


def once(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Events of one request and commit once."""
    return events.withWatermark("at", within).dropDuplicatesWithinWatermark(["repo", "number", "sha"])


def pending(events: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending rows with their synthetic diff, events of unknown repositories). repositories: repository_id, url."""
    known = repositories.select("repository_id", C.normal_url(F.col("url")).alias("key")).groupBy("key").agg(F.min("repository_id").alias("repository_id"))
    met = events.withColumn("key", C.normal_url(F.col("url"))).join(known, "key", "left")
    return synthetic_diff(met.where("repository_id is not null")).withColumn("status", F.lit("pending")), met.where("repository_id is null")


def error_ratio(events: DataFrame, span: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Share of 5xx a sliding window; events: at timestamp, status. A stream keeps windows until they are ``late`` behind."""
    return events.withWatermark("at", late).groupBy(F.window("at", span, step)).agg(F.count("*").alias("n"), F.avg((F.col("status") >= 500).cast("double")).alias("ratio"))


def latency(events: DataFrame, span: str = "5 minutes", exact: bool = False) -> DataFrame:
    """p50, p95, p99 of latency_s a window; exact in batch, sketched in a stream."""
    at = F.expr("percentile(latency_s, array(0.5, 0.95, 0.99))") if exact else F.percentile_approx("latency_s", [0.5, 0.95, 0.99], 10_000)
    out = events.withWatermark("at", "10 minutes").groupBy(F.window("at", span)).agg(at.alias("q"))
    return out.select("window", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def rates(events: DataFrame, span: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events a second by handler and window."""
    return events.withWatermark("at", "10 minutes").groupBy("handler", F.window("at", span)).agg((F.count("*") / seconds).alias("rate"))


def fixed_window_limits(events: DataFrame, span: str = "60 seconds", most: int = 100) -> DataFrame:
    """T4: hits by key in tumbling windows, flagged over ``most``."""
    return events.withWatermark("at", "10 minutes").groupBy("user_id", F.window("at", span)).agg(F.count("*").alias("hits")).withColumn("limited", F.col("hits") > most)


def store_pending(events: DataFrame, repositories: DataFrame, out: str, checkpoint: str):
    """A stream of request events into two tables below ``out``: pending predictions, and the events of unknown repositories, which are
    kept as dead letters. Both get a batch's rows at once, and a batch that is run again adds none."""

    def apply(batch: DataFrame, number: int) -> None:
        matched, dead = pending(batch, repositories)
        change(batch.sparkSession, out, ["key"], appends={"predictions": matched, "dead_letters": dead}, batch=number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
