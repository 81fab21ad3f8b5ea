"""Derived tables on which the analytics queries run, each stated once for Spark and DuckDB.

A fixture is SQL over given tables and other fixtures in braces. A few words differ between
the dialects: SHA(x), ARR(...), EPOCH(ts) and // are replaced for each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

COMMITS = """
SELECT k, repository_id, sha, author_email, is_regression, day_s, prev AS parent_sha, status, priority,
  CASE WHEN k % 17 = 0 THEN concat('Revert "order ', k, '"')
       WHEN k % 13 = 0 THEN concat('Fix regression from ', substr(coalesce(prev, ''), 1, 8))
       WHEN k % 19 = 0 THEN concat('please revert ', k) ELSE concat('Update ', k) END AS message
FROM (SELECT c.*, lag(sha) OVER (PARTITION BY repository_id ORDER BY day_s, k) AS prev
  FROM (SELECT o_orderkey AS k, o_custkey % 20 AS repository_id, substr(SHA(CAST(o_orderkey AS STRING)), 1, 40) AS sha,
      concat('c', o_custkey, '@example.com') AS author_email, o_orderkey % 13 = 0 AS is_regression,
      EPOCH(o_orderdate) AS day_s, o_orderstatus AS status, o_orderpriority AS priority FROM {orders}) c) d
"""

CHANGED_FILES = """
SELECT l_orderkey AS change_id, concat('src/m', m, '/d', l_partkey % 50, '/part_', l_partkey, '.py') AS path, l_linenumber AS ord, CAST(max(l_quantity) AS INT) AS added, CAST(l_linenumber * 3 AS INT) AS deleted, l_partkey AS part,
  CASE WHEN max(l_returnflag) = 'R' AND l_linenumber = 1 THEN 'deleted' WHEN max(l_tax) = 0 THEN 'renamed' ELSE 'modified' END AS change_type
FROM (SELECT *, l_suppkey % 10 AS m FROM {lineitem}) l GROUP BY l_orderkey, m, l_partkey, l_linenumber
"""

#: One file's part of a rendered unified diff.
FILE_PART = """concat('diff --git a/', path, ' b/', path, chr(10),
  CASE WHEN change_type = 'deleted' THEN concat('deleted file mode 100644', chr(10), '--- a/', path, chr(10), '+++ /dev/null', chr(10), '@@ -1,', deleted, ' +0,0 @@', chr(10), repeat(concat('-old line', chr(10)), deleted))
       ELSE concat(CASE WHEN change_type = 'renamed' THEN concat('rename from old/', path, chr(10), 'rename to ', path, chr(10), '--- a/old/', path) ELSE concat('--- a/', path) END, chr(10),
         '+++ b/', path, chr(10), '@@ -1,', deleted, ' +1,', added, ' @@', chr(10), repeat(concat('-old line', chr(10)), deleted),
         '+def fn_', part, '(x):', chr(10), repeat(concat('+    pass', chr(10)), added - 1)) END)"""
FILE_DIFFS = f"""
SELECT change_id, ord, {FILE_PART} AS part
FROM {{changed_files}}
"""

SOURCES = """
SELECT doc_id, concat(source, '/', CASE WHEN doc_id % 5 = 0 THEN 'user_service/' ELSE '' END, 'doc_', doc_id,
    CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' ELSE '.md' END) AS path,
  concat('import doc_', (doc_id * 7) % 1000, chr(10),
    CASE WHEN doc_id % 4 = 0 THEN concat('class C', doc_id, '(pkg.C', doc_id - 1, '):') ELSE concat('export class C', doc_id, ' extends C', doc_id - 1, ' ', chr(123)) END, chr(10),
    CASE WHEN doc_id % 4 = 0 THEN concat('def f_', doc_id, '(x):') ELSE concat('function f_', doc_id, '(x) ', chr(123)) END, chr(10),
    '    if x && f_', doc_id - 1, '(x): return g.f_', doc_id, '(x)', chr(10),
    CASE doc_id % 6 WHEN 0 THEN 'requests.get(url)' WHEN 1 THEN 'session.execute(sql)' WHEN 2 THEN 'KafkaProducer()' WHEN 3 THEN 'cache.get(key)' WHEN 4 THEN 'fetch(url)' ELSE 'pass' END, chr(10),
    coalesce(text, '')) AS content,
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), CASE WHEN doc_id % 4 = 0 THEN 'def' ELSE 'function' END, ' extra_', doc_id, '(y):', chr(10), 'import extra_', doc_id % 7) ELSE '' END AS tail
FROM {documents}
"""

NODES = """
SELECT 0 AS snapshot_id, node_id, node_type, file_path, complexity FROM (
  SELECT concat('service:', r_name) AS node_id, 'service' AS node_type, CAST(NULL AS STRING) AS file_path, 0 AS complexity FROM {region}
  UNION ALL SELECT concat('module:', n_name), 'module', NULL, 0 FROM {nation}
  UNION ALL SELECT concat('class:src/m', s_suppkey % 10, '.py::S', s_suppkey), 'class', concat('src/m', s_suppkey % 10, '.py'), s_suppkey % 60 FROM {supplier}
  UNION ALL SELECT concat('file:src/part_', p_partkey, '.py'), 'file', concat('src/part_', p_partkey, '.py'), p_size FROM {part}
  UNION ALL SELECT concat('function:src/o.py::o', o_orderkey), 'function', 'src/o.py', 0 FROM {orders}) n
"""

EDGES = """
SELECT 0 AS snapshot_id, source_id, target_id, edge_type, weight FROM (
  SELECT DISTINCT concat('file:src/part_', l_partkey, '.py') AS source_id, concat('class:src/m', l_suppkey % 10, '.py::S', l_suppkey) AS target_id, 'import' AS edge_type, 2.0E0 AS weight FROM {lineitem}
  UNION ALL SELECT concat('class:src/m', s_suppkey % 10, '.py::S', s_suppkey), concat('module:', n_name), 'composition', 1.0E0 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
  UNION ALL SELECT concat('module:', n_name), concat('service:', r_name), 'microservice', 1.0E0 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT concat('function:src/o.py::o', l_orderkey), concat('file:src/part_', l_partkey, '.py'), 'call', 1.0E0 FROM {lineitem}
  UNION ALL SELECT concat('module:', n_name), 'module:absent', 'import', 1.0E0 FROM {nation}) e
"""

POINTS = """
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'commits' ELSE 'issues' END AS collection, embedding, label AS repository_id,
  substr(SHA(CAST(vec_id AS STRING)), 1, 40) AS commit_sha, vec_id % 7 = 0 AS is_regression FROM {embeddings}
"""

EVENTS = """
SELECT event_id, event_type AS handler, user_id, EPOCH(ts) AS at_s, value / 100 AS latency_s,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' WHEN 'signup' THEN 'reopened' WHEN 'purchase' THEN 'closed' ELSE 'labeled' END AS action
FROM {events}
"""

REPOSITORIES = """
SELECT page_id, page_id % 10 AS owner_id,
  concat(url, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '.git' ELSE '.git//' END) AS url
FROM (SELECT page_id, regexp_replace(lower(url), '[?#].*$', '') AS url FROM {pages}) p
"""

#: A change's size and the shape of its files.
CHANGES = """
SELECT change_id, count(*) AS n_files, sum(added) AS added, sum(deleted) AS deleted,
  sum(CASE WHEN change_type = 'renamed' THEN 1 ELSE 0 END) AS renames, (change_id % 41) - 20.0E0 AS complexity_delta,
  sum(CASE WHEN change_type <> 'deleted' THEN 1 ELSE 0 END) AS n_functions, max(change_id % 7) AS surface
FROM {changed_files} GROUP BY change_id
"""

MATCHES = """
SELECT o_orderkey AS change_id, vec_id, concat('commit ', vec_id) AS sha, round(abs(CAST(embedding[1] AS DOUBLE)) * 2, 4) AS similarity, vec_id % 7 = 0 AS is_regression, (vec_id * 31 + o_orderkey) % 97 AS place
FROM (SELECT o_orderkey, o_orderkey // 50 % (SELECT CAST(floor(count(*) / 5) AS BIGINT) FROM {embeddings}) AS grp FROM {orders}) o JOIN {embeddings} ON vec_id // 5 = grp
"""

PREDICTIONS = """
SELECT o_orderkey AS change_id, o_custkey % 20 AS repository_id, EPOCH(o_orderdate) AS created_s,
  CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'completed' END AS status,
  (o_orderkey * 37 % 1000) / 10.0E0 AS risk, (o_orderkey * 17 % 101) / 100.0E0 AS p, (o_orderkey * 7 % 103) / 100.0E0 AS confidence,
  o_orderkey % 13 = 0 AS truth, (o_orderkey * 11 % 100) * 1.0E0 AS true_risk
FROM {orders}
"""

RANKED = """
SELECT change_id, path, score, row_number() OVER (PARTITION BY change_id ORDER BY score DESC, path) AS rank, hit
FROM (SELECT change_id, path, (part * 13 + change_id) % 89 / 89.0E0 AS score, max(ord % 3) = 1 AS hit FROM {changed_files} GROUP BY change_id, path, part) f
"""

REVIEWERS = """
SELECT c_custkey AS user_id, c_name AS username, concat('m', c_nationkey % 10) AS expertise_area, greatest(least(c_acctbal / 10000, 1.0E0), 0.0E0) AS ownership_score, c_custkey % 20 AS repository_id
FROM {customer}
"""

OWNERSHIP = """
SELECT user_id, path, weight, user_id % 20 AS repository_id FROM (
  SELECT o_custkey AS user_id, concat('src/m', l_suppkey % 10, '/d', l_partkey % 50, '/part_', l_partkey, '.py') AS path,
    count(*) * 1.0E0 / sum(count(*)) OVER (PARTITION BY l_partkey, l_suppkey % 10) AS weight
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey % 10, l_partkey) w
"""

FIXTURES = {
    "commits": COMMITS, "changed_files": CHANGED_FILES, "file_diffs": FILE_DIFFS, "sources": SOURCES, "nodes": NODES, "edges": EDGES, "points": POINTS, "event_log": EVENTS,
    "repositories": REPOSITORIES, "changes": CHANGES, "matches": MATCHES, "predictions": PREDICTIONS, "ranked": RANKED, "reviewers": REVIEWERS, "ownership": OWNERSHIP,
}

_NAME = re.compile(r"\{(\w+)\}")
_SHA = re.compile(r"SHA\(((?:[^()]|\([^()]*\))*)\)")


def spark_words(sql: str) -> str:
    sql = _SHA.sub(r"sha2(\1, 256)", sql)
    sql = sql.replace("EPOCH(", "unix_timestamp(").replace("ARR(", "array(")
    return re.sub(r"(\w+) // (\d+)", r"(\1 div \2)", sql).replace("embedding[1]", "embedding[0]")


def duck_words(sql: str) -> str:
    sql = _SHA.sub(r"sha256(\1)", sql)
    return re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql).replace("ARR(", "list_value(")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a fixture as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, FIXTURES[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over tables and fixtures in braces."""
    return spark.sql(spark_words(text), **{n: fixture(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})


def diffs(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(change_id, diff): the parts of ``file_diffs`` put together in the order of ord and part, of all changes or those of ``only`` (change_id).

    A change's lines meet as rows of the given table, in the only shuffle, and are rendered where they are: text is neither shuffled
    nor sorted, and what follows by change_id needs no further shuffle.
    """
    lines = fixture(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax")
    if only is not None:
        lines = lines.join(only.select(F.col("change_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.repartition("l_orderkey")
    files = spark.sql(spark_words(CHANGED_FILES), lineitem=lines)
    names = ("ord", "path", "change_type", "deleted", "added", "part")
    quoted = FILE_PART.split("'")  # every other piece is a literal
    quoted[::2] = [re.sub(rf"\b({'|'.join(names)})\b", r"f.\1", x) for x in quoted[::2]]
    parts = f"transform(sort_array(transform(files, f -> struct(f.ord AS ord, {spark_words("'".join(quoted))} AS part))), p -> p.part)"
    return files.groupBy("change_id").agg(F.collect_list(F.struct(*names)).alias("files")).select("change_id", F.expr(f"array_join({parts}, '')").alias("diff"))


def duck(text: str) -> str:
    """The same for DuckDB: fixtures become common table expressions."""
    order: list[str] = []

    def visit(body: str) -> None:
        for n in _NAME.findall(body):
            if n in FIXTURES and n not in order:
                visit(FIXTURES[n])
                order.append(n)

    visit(text)
    ctes = [f"{n} AS ({duck_words(_NAME.sub(r'\1', FIXTURES[n])).strip()})" for n in order]
    body = duck_words(_NAME.sub(r"\1", text)).strip()
    if not ctes:
        return body
    word = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
    return f"{word or 'WITH '}{', '.join(ctes)}{', ' + body[len(word) :] if word else ' ' + body}"
