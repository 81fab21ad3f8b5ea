"""Queries on commits, issues, repositories, labels and splits, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import history as H
from ..operators import vectors as V
from .fixtures import duck, fixture, sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return add


def _commits(s, d):
    return fixture(s, d, "commits")


def _new(s, d):
    parents = F.when(F.col("parent_sha").isNull(), F.array().cast("array<string>")).when(F.col("k") % 6 == 0, F.array("parent_sha", F.lit("x"))).otherwise(F.array("parent_sha"))
    return _commits(s, d).withColumn("parents", parents).withColumn("author", F.col("author_email"))


def _stored(s, d):
    return _commits(s, d).where("k % 3 = 0").select("repository_id", F.expr("CASE WHEN k % 2 = 0 THEN substr(sha, 1, 12) ELSE sha END").alias("sha"))


@query("s1_ingest_commits", """
SELECT repository_id, sha, lower(message) LIKE 'revert%' AS is_rollback, (parent_sha IS NOT NULL AND k % 6 = 0) AS is_merge
FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY day_s DESC, sha) AS n FROM {commits}) c WHERE n <= 1000 AND k % 3 <> 0""")
def _s1(s, d):
    return H.ingest_commits(_new(s, d), _stored(s, d)).select("repository_id", "sha", "is_rollback", "metadata.is_merge")


@query("s2_sync_stats", """
SELECT repository_id, count(*) AS commits_scanned, count(*) FILTER (WHERE k % 3 <> 0) AS commits_indexed, arg_max(sha, (day_s, sha)) AS head_sha FROM {commits} GROUP BY repository_id""")
def _s2(s, d):
    return H.sync_stats(_commits(s, d), _commits(s, d).where("k % 3 != 0"))


@query("d2_valid_sha", """
SELECT k, regexp_matches(lower(t), '^([0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f]|[0-9a-f]+)$') AND len(t) IN (7, 40) AS valid, lower(t) AS sha
FROM (SELECT k, CASE k % 4 WHEN 0 THEN upper(sha) WHEN 1 THEN substr(sha, 1, 7) WHEN 2 THEN substr(sha, 1, 8) ELSE concat('g', substr(sha, 2)) END AS t FROM {commits}) c""")
def _d2(s, d):
    t = F.expr("CASE k % 4 WHEN 0 THEN upper(sha) WHEN 1 THEN substr(sha, 1, 7) WHEN 2 THEN substr(sha, 1, 8) ELSE concat('g', substr(sha, 2)) END")
    return _commits(s, d).select("k", C.valid_sha(t).alias("valid"), F.lower(t).alias("sha"))


@query("l1_l2_rollback_flags", """
SELECT k, lower(trim(message)) LIKE 'revert%' AS by_ingest, regexp_matches(lower(message), '\\brevert\\b') AS by_label FROM {commits}""")
def _l1(s, d):
    return _commits(s, d).select("k", C.is_rollback_message(F.col("message")).alias("by_ingest"), C.names_rollback(F.lit(False), F.col("message")).alias("by_label"))


@query("q1_newest_commits", """
SELECT repository_id, sha, day_s FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY day_s DESC, sha) AS n FROM {commits}) c WHERE n > 10 AND n <= 110""")
def _q1(s, d):
    return H.newest(_commits(s, d), ["repository_id"], [F.desc("day_s"), F.col("sha")], 100, 10).select("repository_id", "sha", "day_s")


@query("q2_commit_by_prefix", """
SELECT repository_id, sha, prefix, count(*) OVER (PARTITION BY repository_id, prefix) > 1 AS ambiguous
FROM {commits} JOIN (SELECT DISTINCT repository_id, substr(sha, 1, 8) AS prefix FROM {commits} WHERE k % 5 = 0) p USING (repository_id) WHERE starts_with(sha, prefix)""")
def _q2(s, d):
    wanted = _commits(s, d).where("k % 5 = 0").select("repository_id", F.substring("sha", 1, 8).alias("prefix")).distinct()
    return H.by_sha_prefix(_commits(s, d).select("repository_id", "sha"), wanted).select("repository_id", "sha", "prefix", "ambiguous")


@query("q3_latest_snapshot", """
SELECT repository_id, max(day_s) AS day_s, arg_max(sha, (day_s, sha)) AS sha FROM {commits} WHERE k % 4 = 0 GROUP BY repository_id""")
def _q3(s, d):
    return H.newest(_commits(s, d).where("k % 4 = 0"), ["repository_id"], [F.desc("day_s"), F.desc("sha")], 1).select("repository_id", "day_s", "sha")


@query("q4_snapshot_children", """
WITH hdr AS (SELECT 0 AS snapshot_id, substr(SHA('0'), 1, 40) AS sha)
SELECT node_type, count(*) AS n FROM {nodes} JOIN hdr USING (snapshot_id) WHERE starts_with(sha, substr(SHA('0'), 1, 9)) GROUP BY node_type""")
def _q4(s, d):
    head = sql(s, d, "SELECT 0 AS repository_id, 0 AS snapshot_id, substr(SHA('0'), 1, 40) AS sha")
    wanted = sql(s, d, "SELECT 0 AS repository_id, substr(SHA('0'), 1, 9) AS prefix")
    return fixture(s, d, "nodes").join(F.broadcast(H.by_sha_prefix(head, wanted).select("snapshot_id")), "snapshot_id").groupBy("node_type").agg(F.count("*").alias("n"))


ISSUES = "SELECT repository_id, concat('BUG-', k) AS external_id, priority AS title, status AS state, k FROM {commits} WHERE k % 11 = 0"


@query("q5_issues", f"SELECT repository_id, external_id, title, state FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY k) AS n FROM ({ISSUES}) i) j WHERE n <= 500")
def _q5(s, d):
    return H.newest(sql(s, d, ISSUES), ["repository_id"], [F.col("k")], 500).select("repository_id", "external_id", "title", "state")


@query("q6_manifest_lookup", "SELECT k, repository_id, sha FROM {commits} c JOIN (SELECT repository_id AS r, vec_id FROM {points} WHERE collection = 'commits') p ON p.vec_id = c.k AND p.r = c.repository_id")
def _q6(s, d):
    manifest = fixture(s, d, "points").where("collection = 'commits'").select(F.col("repository_id").cast("long").alias("repository_id"), F.col("vec_id").alias("k"))
    return _commits(s, d).join(manifest, ["repository_id", "k"]).select("k", "repository_id", "sha")


@query("q7_prediction_history", """
SELECT p.repository_id, change_id, status, total FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_s DESC, change_id DESC) AS n FROM {predictions} WHERE status = 'completed') p
JOIN (SELECT repository_id, count(*) AS total FROM {predictions} GROUP BY repository_id) t ON t.repository_id = p.repository_id WHERE n <= 50""")
def _q7(s, d):
    p = fixture(s, d, "predictions")
    page = H.newest(p.where("status = 'completed'"), ["repository_id"], [F.desc("created_s"), F.desc("change_id")], 50)
    return page.join(p.groupBy("repository_id").agg(F.count("*").alias("total")), "repository_id").select("repository_id", "change_id", "status", "total")


@query("q8_profiles_with_names", "SELECT user_id, username, count(*) AS n_paths, round(sum(weight), 6) AS weight FROM {ownership} JOIN {reviewers} USING (user_id) GROUP BY user_id, username")
def _q8(s, d):
    return fixture(s, d, "ownership").join(fixture(s, d, "reviewers"), "user_id").groupBy("user_id", "username").agg(F.count("*").alias("n_paths"), C.rounded(F.sum("weight")).alias("weight"))


@query("q11_repositories_by_owner", "SELECT page_id, url FROM {repositories} WHERE owner_id = 3")
def _q11(s, d):
    return fixture(s, d, "repositories").where("owner_id = 3").select("page_id", "url")


@query("q12_get_or_create", "SELECT url, coalesce(min(page_id) FILTER (WHERE page_id % 2 = 0), min(page_id)) AS page_id FROM {repositories} WHERE page_id % 2 = 0 OR page_id % 3 = 0 GROUP BY url")
def _q12(s, d):
    r = fixture(s, d, "repositories")
    own = lambda n: r.where(f"page_id % {n} = 0").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return H.merge_absent(own(2), own(3), "url")


@query("q13_missing_parents", "SELECT l_orderkey AS k, count(*) AS n FROM {lineitem} WHERE l_orderkey NOT IN (SELECT k FROM {commits} WHERE is_regression) GROUP BY l_orderkey")
def _q13(s, d):
    child = fixture(s, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return H.missing_parents(child, _commits(s, d).where("is_regression"), "k").groupBy("k").agg(F.count("*").alias("n"))


@query("q14_skip_existing_builds", "SELECT k, sha FROM {commits} WHERE k % 4 = 0 OR k % 9 = 0")
def _q14(s, d):
    c = _commits(s, d).select("k", "sha")
    return H.merge_absent(c.where("k % 4 = 0"), c.where("k % 9 = 0"), "sha")


@query("l3_linked_fixes", """
SELECT DISTINCT c.repository_id, c.sha FROM {commits} c JOIN {commits} f ON f.repository_id = c.repository_id AND f.is_regression
  AND f.day_s > c.day_s AND f.day_s <= c.day_s + 14 * 86400 AND contains(lower(f.message), substr(c.sha, 1, 8))""")
def _l3(s, d):
    c = _commits(s, d)
    return H.linked_regressions(c.select("repository_id", "sha", "day_s"), c.where("is_regression").select("repository_id", "day_s", "message"))


FILES = "SELECT change_id, path, ord FROM {changed_files}"


@query("l4_affected_labels", """
WITH own AS (SELECT change_id, list(path ORDER BY ord, path) AS files FROM {changed_files} GROUP BY change_id),
fix AS (SELECT change_id - change_id % 4 AS change_id, list(DISTINCT path) AS fixed FROM {changed_files} WHERE change_id % 4 <> 0 AND change_id % 3 = 0 GROUP BY 1),
o AS (SELECT own.change_id, files, list_filter(coalesce(fixed, []), lambda x: NOT list_contains(files, x)) AS other FROM own LEFT JOIN fix USING (change_id))
SELECT change_id, array_to_string(list_sort(CASE WHEN len(other) = 0 THEN files[1:3] ELSE other END), ',') AS affected FROM o""")
def _l4(s, d):
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"])
    files = sql(s, d, FILES)
    fixes = files.where("change_id % 4 != 0 and change_id % 3 = 0").groupBy((F.col("change_id") - F.col("change_id") % 4).alias("change_id")).agg(F.collect_set("path").alias("fix_files"))
    return H.affected_labels(files.groupBy("change_id").agg(own.alias("files")), fixes).select("change_id", F.array_join("affected", ",").alias("affected"))


@query("l5_risk_labels", """
SELECT change_id, round(least(least(20 + 0.05 * added + 0.08 * deleted + 2 * abs(complexity_delta) + 3 * n_files, 85.0)
  + CASE WHEN is_regression THEN 25 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 15 ELSE 0 END, 100.0), 6) AS risk_label FROM {changes} JOIN {commits} ON k = change_id""")
def _l5(s, d):
    rows = fixture(s, d, "changes").join(_commits(s, d).withColumnRenamed("k", "change_id"), "change_id").withColumn("is_rollback", F.col("change_id") % 17 == 0)
    return H.risk_labels(rows).select("change_id", C.rounded(F.col("risk_label")).alias("risk_label"))


@query("l6_training_samples", """
WITH snap AS (SELECT DISTINCT repository_id, sha FROM {commits} WHERE k % 2 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY day_s DESC, sha) AS n FROM {commits})
SELECT c.repository_id, c.sha, ch.n_files FROM c JOIN {changes} ch ON ch.change_id = c.k JOIN snap ON snap.repository_id = c.repository_id AND snap.sha = c.parent_sha
WHERE n <= 200 AND NOT regexp_matches(lower(message), '\\brevert\\b') AND added + deleted > 0""")
def _l6(s, d):
    c = H.newest(_commits(s, d), ["repository_id"], [F.desc("day_s"), F.col("sha")], 200).where(~C.names_rollback(F.lit(False), F.col("message")))
    snap = _commits(s, d).where("k % 2 = 0").select("repository_id", F.col("sha").alias("parent_sha")).distinct()
    rows = c.join(snap, ["repository_id", "parent_sha"], "left_semi").join(fixture(s, d, "changes").withColumnRenamed("change_id", "k"), "k").where("added + deleted > 0")
    return rows.select("repository_id", "sha", "n_files")


@query("l7_balanced", """
SELECT repository_id, sha FROM (SELECT *, sum(CAST(is_regression AS INT)) OVER (PARTITION BY repository_id) AS pos, row_number() OVER (PARTITION BY repository_id, is_regression ORDER BY day_s DESC, sha) AS n FROM {commits}) c
WHERE is_regression OR pos = 0 OR n <= floor(3.0 * pos)""")
def _l7(s, d):
    return H.balance(_commits(s, d), "is_regression", [F.desc("day_s"), F.col("sha")], keys=("repository_id",)).select("repository_id", "sha")


@query("l8_split", """
SELECT repository_id, sha, CASE WHEN row_number() OVER (PARTITION BY repository_id ORDER BY day_s, sha) <= greatest(count(*) OVER (PARTITION BY repository_id) // 5, 1) THEN 'validation' ELSE 'train' END AS split FROM {commits}""")
def _l8(s, d):
    return H.split_first(_commits(s, d), ["repository_id"], [F.col("day_s"), F.col("sha")]).select("repository_id", "sha", "split")


@query("l9_diff_proxy", "SELECT change_id, greatest(sum(len(string_split(part, chr(10))) - 1), 1) AS added, 0 AS deleted FROM {file_diffs} GROUP BY change_id")
def _l9(s, d):
    lines = F.size(F.split("part", "\n")) - 1
    return fixture(s, d, "file_diffs").groupBy("change_id").agg(F.greatest(F.sum(lines), F.lit(1)).alias("added"), F.lit(0).alias("deleted"))


@query("o2_split_by_time", "SELECT k, CASE WHEN day_s < 883612800 THEN 'train' WHEN day_s < 883612800 + 31536000 THEN 'validation' ELSE 'test' END AS split FROM {commits}")
def _o2(s, d):
    return H.split_by_time(_commits(s, d), "day_s", 883612800, 31536000).select("k", "split")


@query("o3_hard_negatives", """
SELECT change_id FROM (SELECT change_id, is_regression, percent_rank() OVER (PARTITION BY repository_id ORDER BY added + deleted) AS r FROM {changes} JOIN {commits} ON k = change_id) c WHERE r >= 0.9 AND NOT is_regression""")
def _o3(s, d):
    rows = fixture(s, d, "changes").join(_commits(s, d).withColumnRenamed("k", "change_id"), "change_id").withColumn("size", F.col("added") + F.col("deleted"))
    return H.hard_negatives(rows, "size", "is_regression", ["repository_id"]).select("change_id")


@query("d6_d7_repository_match", """
WITH r AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '')) AS key FROM {repositories})
SELECT e.page_id, e.key, m.first_id FROM r e JOIN (SELECT key, min(page_id) AS first_id FROM r WHERE page_id % 2 = 0 GROUP BY key) m USING (key)""")
def _d6(s, d):
    r = fixture(s, d, "repositories").select("page_id", C.normal_url(F.col("url")).alias("key"))
    return r.join(r.where("page_id % 2 = 0").groupBy("key").agg(F.min("page_id").alias("first_id")), "key").select("page_id", "key", "first_id")


COMMIT_TEXT = """concat('Commit: ', message, chr(10), 'Author: ', author_email, chr(10), 'Regression: ', CASE WHEN is_regression THEN 'True' ELSE 'False' END, chr(10), 'Rollback: ', CASE WHEN lower(message) LIKE 'revert%' THEN 'True' ELSE 'False' END)"""


@query("v4_v5_embedding_texts", f"SELECT k, {COMMIT_TEXT} AS commit_text, concat(priority, chr(10), 'Type: bug', chr(10), 'State: ', status) AS issue_text FROM {{commits}}")
def _v4(s, d):
    c = _commits(s, d)
    text = V.commit_text(F.col("message"), F.col("author_email"), F.col("is_regression"), C.is_rollback_message(F.col("message")), F.lit(""))
    return c.select("k", text.alias("commit_text"), V.issue_text(F.col("priority"), F.lit("bug"), F.col("status")).alias("issue_text"))


@query("v6_unindexed_commits", """
SELECT repository_id, k AS entity_id FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY day_s DESC, k) AS n FROM {commits}) c WHERE n <= 500 AND k % 4 <> 0""")
def _v6(s, d):
    c = _commits(s, d).select("repository_id", F.col("k").alias("entity_id"), "day_s")
    return V.unindexed(c, c.where("entity_id % 4 = 0")).select("repository_id", "entity_id")


@query("v7_unindexed_issues", f"SELECT repository_id, k AS entity_id FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY k) AS n FROM ({ISSUES}) i) j WHERE n <= 500 AND k % 4 <> 0")
def _v7(s, d):
    c = sql(s, d, ISSUES).select("repository_id", F.col("k").alias("entity_id"), F.lit(0).alias("day_s"))
    return V.unindexed(c, c.where("entity_id % 4 = 0")).select("repository_id", "entity_id")
