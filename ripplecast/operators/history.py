"""Commit, issue and prediction history: ingest, lookups, listings, guards, labels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.storage import numbered

PREFIX = 7  # the shortest sha, by which prefix joins are keyed


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """Q1, Q7, B2: rows offset+1 to offset+n of each group in the given order.

    A group limit over a window, which Spark also applies before the shuffle.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where((F.col("__place") > offset) & (F.col("__place") <= offset + n)).drop("__place")


def ingest_commits(new: DataFrame, stored: DataFrame, cap: int = 1000) -> DataFrame:
    """Commits of the newest ``cap`` of a repository that aren't stored yet, with flags.

    new: repository_id, sha, parents array, author, day_s, message. A stored sha may be a prefix of
    a new one; both are keyed by their first PREFIX digits, so this is an equi-join.
    """
    window = newest(new, ["repository_id"], [F.desc("day_s"), F.col("sha")], cap)
    known = stored.select("repository_id", F.substring("sha", 1, PREFIX).alias("head"), F.col("sha").alias("known"))
    a, b = window.withColumn("head", F.substring("sha", 1, PREFIX)).alias("a"), known.alias("b")
    fresh = a.join(b, (F.col("a.repository_id") == F.col("b.repository_id")) & (F.col("a.head") == F.col("b.head")) & F.col("a.sha").startswith(F.col("b.known")), "left_anti")
    return fresh.select(
        "repository_id", "sha", "day_s", "message",
        C.is_rollback_message(F.col("message")).alias("is_rollback"),
        F.struct(F.col("author").alias("author_name"), F.col("parents").alias("parent_shas"), (F.size("parents") > 1).alias("is_merge")).alias("metadata"),
    )


def sync_stats(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Commits scanned and indexed, and the head, of each repository."""
    seen = scanned.groupBy("repository_id").agg(F.count("*").alias("commits_scanned"), F.max_by("sha", F.struct("day_s", "sha")).alias("head_sha"))
    new = indexed.groupBy("repository_id").agg(F.count("*").alias("commits_indexed"))
    return seen.join(new, "repository_id", "left").fillna({"commits_indexed": 0})


def by_sha_prefix(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Q2, Q4: rows whose sha begins with ``prefix`` of wanted (repository_id, prefix); more than one is flagged ambiguous.

    Prefixes have PREFIX digits or more, so the join is on the first PREFIX.
    """
    left = df.withColumn("head", F.substring("sha", 1, PREFIX))
    right = wanted.withColumn("head", F.substring("prefix", 1, PREFIX))
    found = left.join(right, ["repository_id", "head"]).where(F.col("sha").startswith(F.col("prefix"))).drop("head")
    return found.withColumn("ambiguous", F.count("*").over(W.partitionBy("repository_id", "prefix")) > 1)


def missing_parents(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Q13: rows whose parent doesn't exist."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def merge_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Q12, Q14: existing rows, and of new ones those whose key isn't there yet (one a key)."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def linked_regressions(commits: DataFrame, fixes: DataFrame, days: int = 14) -> DataFrame:
    """L3: commits that a later fix names within ``days``.

    commits: repository_id, sha, day_s; fixes: repository_id, day_s, message. The 8-digit tokens of a message are
    drawn out first, which turns a containment join into an equi-join.
    """
    tokens = fixes.select("repository_id", F.col("day_s").alias("fix_s"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("message"), F.lit("([0-9a-f]{8})"), F.lit(1)))).alias("token"))
    named = commits.withColumn("token", F.substring("sha", 1, 8)).join(tokens, ["repository_id", "token"])
    return named.where((F.col("fix_s") > F.col("day_s")) & (F.col("fix_s") <= F.col("day_s") + days * 86400)).select("repository_id", "sha").distinct()


def risk_labels(changes: DataFrame) -> DataFrame:
    """Size and history of a change as a risk in 0..100; needs added, deleted, complexity_delta, n_files, is_regression, is_rollback."""
    base = F.least(20 + 0.05 * F.col("added") + 0.08 * F.col("deleted") + 2 * F.abs("complexity_delta") + 3 * F.col("n_files"), F.lit(85.0))
    more = F.when(F.col("is_regression"), 25).otherwise(0) + F.when(F.col("is_rollback"), 15).otherwise(0)
    return changes.withColumn("risk_label", F.least(base + more, F.lit(100.0)))


def affected_labels(changes: DataFrame, fixes: DataFrame) -> DataFrame:
    """L4: files of all fixes that the change doesn't hold; without any, its first three. (change_id, affected sorted)

    changes: change_id, files array; fixes: change_id, fix_files array.
    """
    repaired = fixes.groupBy("change_id").agg(F.array_distinct(F.flatten(F.collect_list("fix_files"))).alias("fixed"))
    other = F.array_except(F.coalesce("fixed", F.array().cast("array<string>")), "files")
    return changes.join(repaired, "change_id", "left").select("change_id", F.array_sort(F.when(F.size(other) == 0, F.slice("files", 1, 3)).otherwise(other)).alias("affected"))


def _beside(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """df with the totals of its keys, which are one row a key; without keys a single row."""
    return df.join(totals, keys, "left") if keys else df.join(F.broadcast(totals))


def balance(df: DataFrame, label: str, order: list[Column], ratio: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """All positives and the first int(ratio * positives) negatives of each group; without positives all rows."""
    total = df.groupBy(*keys).agg(F.sum(F.col(label).cast("int")).alias("__n"))
    rows = _beside(numbered(df, [*keys, label], order, "__place"), total, list(keys))
    return rows.where(F.col(label) | (F.col("__n") == 0) | (F.col("__place") <= F.floor(F.col("__n") * ratio))).select(*df.columns)


def split_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first max(n // 5, 1) rows of each group validate, the rest train."""
    rows = _beside(numbered(df, keys, order, "__place"), df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    return rows.withColumn("split", F.when(F.col("__place") <= F.greatest(F.floor(F.col("__n") / 5), F.lit(1)), "validation").otherwise("train")).select(*df.columns, "split")


def split_by_time(df: DataFrame, at: str, start: int, width: int) -> DataFrame:
    """O2: train before start, validate for ``width``, then test."""
    return df.withColumn("split", F.when(F.col(at) < start, "train").when(F.col(at) < start + width, "validation").otherwise("test"))


def hard_negatives(df: DataFrame, size: str, label: str, keys: list[str], top: float = 0.9) -> DataFrame:
    """O3: the largest changes of a repository that caused no regression: of rank (p - 1) / (n - 1) >= top, ties at their least place.

    Ranks come from the counts of each size, of which a key has few against its rows.
    """
    sizes = df.groupBy(*keys, size).agg(F.count("*").alias("__c"))
    placed = numbered(sizes, keys, [F.col(size)], "__place")
    step = F.floor(F.col("__place") / 4096)
    blocks = placed.groupBy(*keys, step.alias("__block")).agg(F.sum("__c").alias("__c"))
    own = W.partitionBy(*keys)
    blocks = blocks.select(*keys, "__block", (F.sum("__c").over(own.orderBy("__block")) - F.col("__c")).alias("__before"), F.sum("__c").over(own).alias("__n"))
    inside = F.sum("__c").over(W.partitionBy(*keys, "__block").orderBy("__place")) - F.col("__c")
    ranked = placed.withColumn("__block", step).withColumn("__inside", inside).join(blocks, [*keys, "__block"])
    rank = F.when(F.col("__n") > 1, (F.col("__before") + F.col("__inside")) / (F.col("__n") - 1)).otherwise(0.0)
    rows = df.join(ranked.select(*keys, size, rank.alias("__rank")), [*keys, size])
    return rows.where((F.col("__rank") >= top) & ~F.col(label)).select(*df.columns)
