"""Steps that many queries share: what they shuffle, and that their short ways give the same rows as the long ones."""

import os
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ripplecast.functions.storage import shared_dir
from ripplecast.operators import diffs as A
from ripplecast.operators import graph as R
from ripplecast.operators import reviewers as W
from ripplecast.operators import risk as K
from ripplecast.operators import scoring as P
from ripplecast.plans import registry
from ripplecast.plans.fixtures import diffs, fixture
from ripplecast.streaming import ingest as I

ODD = [
    (1, "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@ def head(\n-def gone(a):\n+  class Kept:\n def context(\n+x = undef (1)\n+export default function shown(b)\n@@ -9 +9 @@\n-- x\n+++ y\n+def gone(a):\n"),
    (2, "--- a/one.js\n+++ b/one.js\n@@ -0,0 +1 @@\n+function one()\n--- a/two.js\n+++ /dev/null\n@@ -1 +0,0 @@\n-async function two()\n"),
    (3, "diff --git a/m b/n\nrename from m\nrename to n\n"), (4, " \n"), (5, None), (6, "diff --git a/b.bin b/b.bin\nnew file mode 100644\nBinary files differ\n"),
    (7, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -1 +0,0 @@\n-c\n\n"),
]


def test_files_and_lines_tell_the_same(spark):
    rows = spark.createDataFrame(ODD, "change_id long, diff string")
    files, lines = A.diff_files(rows), A.diff_lines(rows)
    seen = lambda df: sorted(map(str, df.collect()))
    assert seen(A.file_changes(files)) == seen(A.file_changes(lines)) and A.file_changes(files).count() == 7
    assert seen(A.modified_symbols(files)) == seen(A.modified_symbols(lines))
    counted = lines.groupBy("change_id", "file_ord").agg(F.sum((F.col("kind") == "add").cast("long")).alias("added"), F.sum((F.col("kind") == "del").cast("long")).alias("deleted"))
    assert seen(counted) == seen(A.file_changes(files).select("change_id", "file_ord", "added", "deleted"))


def test_marked_lines_are_the_lines(spark):
    """A file's marked text is that of its lines, and no line becomes a row that is shuffled."""
    more = [(8, "diff --git a/c b/c\r\n--- a/c\n+++ b/c\n@@ -1,4 +1,3 @@\nadd + x\n\n\\ No newline\n@@ -9,3 +9 @@\n-del -\n@@@ x\n\r\n+\n-\nhunk @@ \n"), (9, "diff --git a/d b/d\n--- a/d\n+++ b/d\n@@ what @@\n@@ -1 +1 @@\n")]
    rows = A.diff_files(spark.createDataFrame(ODD + more, "change_id long, diff string"))
    lines = A.diff_lines(spark.createDataFrame(ODD + more, "change_id long, diff string"))
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(" ", "kind", "text").alias("said")))), lambda x: x["said"]), "\n")
    want = lines.groupBy("change_id", "file_ord").agg(n("add").alias("n_add"), n("del").alias("n_del"), n("hdr").alias("n_hdr"), said.alias("lines"))
    seen = lambda df: sorted(map(str, df.collect()))
    assert seen(A.marked_lines(rows)) == seen(want) and want.count() == 9
    plan = registry.queries()["a1_diff_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Generate") == 1


def test_changes_are_parsed_in_one_pass(spark):
    """As the steps one by one; a diff is made once, where a join of the steps made it three times."""
    more = [
        (8, "diff --git a/c b/c\r\n--- a/c\n+++ b/c\n@@ -1,2 +1,2 @@\n ctx\n\n@@ -9,3 +9 @@\n-def cut\n+  class  C :\n"), (9, "no file\n@@ -1 +1 @@\n-a\n+b\n"), (10, "diff --git a/d b/d\n--- a/d\n+++ b/d\n@@ what @@\n+x\n\r\n"),
        (11, "diff --git a/e b/e\n--- a/e\n+++ b/e\n@@ -1,2 +1,1 @@\n+def twice(a)\n-def twice(b)\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,4 +1,4 @@\n \n-x\n\n+  @@ -1 +1 @@ def marked\n"), (12, ""),
    ]
    rows = spark.createDataFrame(ODD + more, "change_id long, diff string")
    files = A.diff_files(rows)
    summary = {r.change_id: r for r in A.change_summary(A.file_changes(files)).collect()}
    symbols = A.modified_symbols(files).groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]).alias("s"))
    symbols = {r.change_id: r.s for r in symbols.collect()}
    broken = {r.change_id: bool(r.b) or (bool(r.h) and r.change_id not in summary) for r in rows.select("change_id", A.broken_hunks(F.col("diff")).alias("b"), F.col("diff").rlike(r"(?m)^@@ ").alias("h")).collect()}
    got = {r.change_id: r for r in A.parsed_changes(rows.withColumn("own", F.col("change_id") * 2)).collect()}
    assert sorted(got) == [r[0] for r in ODD + more] and {k for k, v in broken.items() if v} == {8, 9, 10, 11}
    for k, r in got.items():
        want = summary.get(k)
        assert (r.changed_files, r.added, r.deleted, r.renamed_files) == ((want.changed_files, want.added, want.deleted, want.renamed_files) if want else ([], 0, 0, {})), k
        assert (r.symbols, r.broken, r.own) == (symbols.get(k, []), broken[k], 2 * k), k
    plan = A.parsed_changes(diffs(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange") == 1


def test_diffs_are_shuffled_before_they_are_rendered(spark):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"])
    plain = fixture(spark, SF, "file_diffs").groupBy("change_id").agg(F.array_join(parts, "").alias("diff"))
    got = diffs(spark, SF)
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    summary = A.change_summary(A.file_changes(A.diff_files(got)))
    assert summary._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_vector_means_are_summed_in_place(spark):
    vectors = spark.createDataFrame([(0, "a", [1.0, 2.0]), (0, "b", [3.0, 6.0]), (1, "a", [5.0, 5.0])], "snapshot_id int, node_id string, vector array<double>")
    edges = spark.createDataFrame([(0, "a", "c"), (0, "b", "c"), (0, "b", "c"), (0, "x", "c"), (1, "a", "a")], "snapshot_id int, source_id string, target_id string")
    means = R.neighbour_mean(vectors, edges)
    assert sorted(map(tuple, means.collect())) == [(0, "c", [7 / 3, 14 / 3]), (1, "a", [5.0, 5.0])]
    assert "ObjectHashAggregate" not in means._jdf.queryExecution().executedPlan().toString()  # which sorts all rows beyond 128 keys
    with pytest.raises(ValueError):
        R.mean_pool(vectors.unionByName(spark.createDataFrame([(0, "d", [1.0])], vectors.schema)))


def test_a_batch_of_commits_leaves_only_its_tables(spark, tmp_path):
    from ripplecast.functions.storage import shared_dir
    from ripplecast.sources.versions import read

    rows = [(1, f"s{k}", k, "m", "a", False, [("x.py", "def f(): pass")]) for k in range(5)]
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    I.apply_commits(spark.createDataFrame(rows, I.COMMIT), 0, str(tmp_path / "out"))
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert not [x for x in left if x.startswith("commit")]
    vectors = read(spark, str(tmp_path / "out"), "vectors")
    assert vectors.columns == ["repository_id", "sha", "vector"] and vectors.count() == 5 and {len(r.vector) for r in vectors.collect()} == {384}


def test_reviewers_are_ranked_without_pairs_of_changes_and_candidates(spark):
    """Against brute force; and no table between the steps has more rows than ownership and targets have."""
    rng = random.Random(4)
    profiles = [(u % 2, u, f"u{u}", rng.choice([None, "", "M1", "m2", "zz"]), rng.choice([0.2, 0.4, 0.9, 2.9, 3.1])) for u in range(60)]
    paths = [f"src/m{m}/d{d}/f{f}.py" for m in range(3) for d in range(2) for f in range(4)] + ["root.py"]
    ownership = [(u % 2, u, p, rng.choice([0.0, 0.25, 1.0])) for u in range(62) for p in rng.sample(paths, 5)]
    targets = [(c % 2, c, p) for c in range(300) for p in rng.sample(paths, rng.randint(1, 3))]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = W.recommend(
        df(profiles, "repository_id int, user_id long, username string, expertise_area string, ownership_score double"), df(ownership, "repository_id int, user_id long, path string, weight double"), df(targets, "repository_id int, change_id long, path string")
    ).collect()
    want = set()
    for c in range(300):
        own = {p for _, d, p in targets if d == c}
        dirs = {p.rpartition("/")[0] for p in own}
        rows = []
        for repo, u, _, area, score in profiles:
            if repo == c % 2:
                near = sum(w > 0 and p.rpartition("/")[0] in dirs for _, v, p, w in ownership if v == u)
                overlap = min(sum(w for _, v, p, w in ownership if v == u and p in own) / len(own), 1)
                expert = bool(area) and any(area.lower() in p for p in own)
                if near or area:
                    rows.append((-round(min(0.3 * score + 0.5 * overlap + 0.2 * expert, 1), 9), u, near))
        want |= {(c, u, near, -score, k) for k, (score, u, near) in enumerate(sorted(rows)[:5], 1)}
    assert {(r.change_id, r.user_id, r.n_owned, round(r.exact, 9), r["rank"]) for r in got} == want and len(got) == len(want)
    tables = [x for x in set(os.listdir(folder)) - before if x.startswith("reviewers")]
    assert tables and max(spark.read.parquet(f"{folder}/{x}").count() for x in tables) <= max(len(ownership), len(targets))


@pytest.mark.parametrize("scoped", [False, True])
def test_owned_files_are_counted_without_their_product(spark, scoped):
    """As counting the rows of owned_files, over two blocks of users, by bits and by places, with all directories unpacked or a few."""
    rng = random.Random(6)
    own = [(rng.randrange(2), rng.randrange(40_000), f"d{min(rng.randrange(60), 20)}/f{rng.randrange(50)}", rng.choice([0.0, 0.5])) for _ in range(3000)] + [(0, None, "d1/none", 1.0), (0, u := 7, "top.py", 1.0), (1, u, "d1/f1", 1.0)]
    own += [(u % 2, u, "d3/shared", 1.0) for u in range(36_000)]
    asked = [(c % 2, c, f"d{rng.randrange(25)}/x{k}") for c in range(400) for k in range(rng.randint(1, 5))] + [(0, 1000, "top.py"), (0, 1001, "gone/x")]
    drop = () if scoped else ("repository_id",)
    ownership = spark.createDataFrame(own, "repository_id int, user_id long, path string, weight double").drop(*drop)
    targets = spark.createDataFrame(asked, "repository_id int, change_id long, path string").drop(*drop)
    plain = W.owned_files(ownership, targets).groupBy("change_id").agg(F.count("*"), F.countDistinct("user_id"), F.max("path")).collect()
    for most in (4096, 3):
        assert sorted(map(tuple, W.owned_counts(ownership, targets, width=100, most=most).collect())) == sorted(map(tuple, plain))


def test_edges_and_learned_rows_are_made_once(spark):
    nodes = spark.createDataFrame([(0, f"n{k}") for k in range(20)], "snapshot_id int, node_id string")
    edges = spark.range(19).select(F.lit(0).alias("snapshot_id"), F.concat(F.lit("n"), "id").alias("source_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("target_id"), F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
    found, met = R.subgraph(nodes, edges, nodes.where("node_id = 'n5'"))
    assert (found.count(), met.count()) == (5, 4) and "Range (" not in met._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(60).select(F.col("id").alias("change_id"), F.when(F.col("id") % 5 > 0, "train").otherwise("test").alias("split"), *[(F.col("id") * (k + 3) % 11 / 11).alias(f"f_{n}") for k, n in enumerate(K.FEATURES)])
    trained = K.trained(rows.withColumn("risk_label", F.col("f_" + K.FEATURES[0]) * 50).withColumn("is_regression", F.col("change_id") % 3 == 0))
    assert trained.count() == 60 and "Range (" not in trained._jdf.queryExecution().executedPlan().toString()


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from ripplecast.sources.versions import change

    rows = spark.range(0, 400_000, 1, 8).select(F.lit(1).alias("repository_id"), F.sha2(F.col("id").cast("string"), 256).alias("node_id"))  # 26 MB
    manifest = change(spark, str(tmp_path / "out"), ["repository_id"], {"nodes": (rows, rows.select("repository_id").distinct())})
    [[folder]] = manifest["tables"]["nodes"].values()
    assert len([x for x in os.listdir(tmp_path / "out" / folder) if x.endswith(".parquet")]) > 1


def test_only_the_diffs_of_samples_are_made(spark):
    from ripplecast.operators import scoring as P

    commits = spark.createDataFrame([(1, f"{k:040d}", f"{k - 1:040d}" if k else None, k, f"Update {k}", False) for k in range(9)], "repository_id int, sha string, parent_sha string, day_s long, message string, is_regression boolean")
    text = lambda df: df.withColumn("diff", F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+"), "sha", F.lit("\n")))
    asked = []

    def made(wanted):
        asked.extend(r.sha for r in wanted.collect())
        return text(wanted)

    snapshots = commits.select("repository_id", "sha")
    got = P.samples(commits, made, snapshots, cap=4, dims=8)
    want = P.samples(commits, text(snapshots), snapshots, cap=4, dims=8)
    assert sorted(asked) == [f"{k:040d}" for k in range(5, 9)] and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4


def test_reports_and_drivers_are_made_in_their_rows(spark):
    rows = spark.range(40).select(F.col("id").alias("change_id"), *[((F.col("id") * (k + 2)) % 5 / 5).alias(f"f_{n}") for k, n in enumerate(K.FEATURES)])
    got, long = K.attributed_changes(rows), K.attributions(rows)
    assert sorted(map(tuple, K.report(got).collect())) == sorted(map(tuple, K.report(long).collect()))
    names = K.top_drivers(long).groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("drivers"))
    assert sorted((k, d) for k, d in K.driver_names(got).collect() if d) == sorted(map(tuple, names.collect()))
    assert not any("Exchange" in f(got)._jdf.queryExecution().executedPlan().toString() for f in (K.report, K.driver_names))


def test_degrees_are_counted_by_small_tasks(spark, tmp_path):
    """More tasks than a shuffle has partitions, as their number follows the files that are read; settings are as before afterwards."""
    names, end = ("advisoryPartitionSizeInBytes", "coalescePartitions.initialPartitionNum"), lambda k: F.sha2((F.col("id") + k).cast("string"), 256)
    now = lambda: [spark.conf.get(f"spark.sql.adaptive.{n}", None) for n in names] + [spark.conf.get("spark.sql.files.maxPartitionBytes")]
    before = now()
    spark.range(0, 1_000_000, numPartitions=4).select(F.lit(0).alias("snapshot_id"), end(0).alias("source_id"), end(1).alias("target_id")).write.parquet(f"{tmp_path}/edges")
    got = R.degrees(spark.read.parquet(f"{tmp_path}/edges"))
    assert len(got.inputFiles()) > 4 and now() == before
    assert sorted(map(tuple, got.groupBy("in_degree", "out_degree").count().collect())) == [(0, 1, 1), (1, 0, 1), (1, 1, 999_999)]


def test_overlaps_are_counted_by_small_tasks(spark, tmp_path):
    path = lambda k: F.sha2((F.col("id") - F.col("id") % 2 + k).cast("string"), 256).alias("path")
    spark.range(0, 500_000, numPartitions=1).select(F.sha2((F.col("id") % 250_000).cast("string"), 256).alias("user_id"), path(0), F.lit(0.5).alias("weight")).write.parquet(f"{tmp_path}/ownership")
    spark.range(0, 500_000, numPartitions=1).select(F.sha2(F.col("id").cast("string"), 256).alias("change_id"), path(0)).write.parquet(f"{tmp_path}/targets")
    got = W.overlap(*(spark.read.parquet(f"{tmp_path}/{x}") for x in ("ownership", "targets")))
    assert len(got.inputFiles()) > 4 and got.where("overlap = 0.5").count() == got.count() == 1_000_000


def test_texts_meet_patterns_only_if_they_hold_their_words(spark):
    """The same systems and facts as by the patterns alone; a rebuild reads stored nodes."""
    import re

    from ripplecast.operators import code_graph as G

    some = [
        "httpx.get", "requests.post", "fetch (", "axios.put", "urllib.request", "aiohttp.request", "session.add", "SQLAlchemy", "asyncpg.connect", "psycopg.cursor", "psycopg2.connect", "pymongo.collection", "pymongo.MongoClient", "x.get(", "x.set (", "x.hget(", "x.hset(",
        "x.lpush(", "x.rpush\t(", "prisma.user.find", "mongoose.connect", "x.delay", "x.apply_async", "a@task", "a@shared_task", "a@celery_app.task", "KafkaProducer", "KafkaConsumer", "pika.URLParameters", "pika.BlockingConnection", "x.publish(", "x.subscribe (", "boto3.client('sqs'",
        "boto3.resource( \"sqs\"", "plain text", "requests.", "prisma.x", "fetching", "a @ b",
    ]
    texts = [*some, *(f"é {a}\n{b} " for a, b in zip(some, some[7:], strict=False)), ""]
    sources = spark.createDataFrame([(f"src/f{k}.py", t) for k, t in enumerate([*texts, None])], "path string, content string")
    found = G.external_systems(sources)
    want = {(f"src/f{k}.py", kind, name) for k, t in enumerate(texts) for kind, own in G.EXTERNAL.items() for name, p in own.items() if re.search(p, t)}
    assert set(map(tuple, found.collect())) == want and {n for _, _, n in want} == set(G.HOLDS)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Contains(") >= len(G.HOLDS)

    lines = [" \timport os \t", "from a import b\r", "xx def f(a)", "\xa0def g(a)", "\tclass K(B):", " export  x", "import", "importx y", "function h", "async z", "call(1)", "none here", "", "from a\u2028", "def\u2028"]
    text = spark.createDataFrame([("a.py", "\n".join(lines)), ("b.js", "\n".join(reversed(lines))), ("c.py", None)], "path string, content string")
    words = ("(", "import", "from", "class", "export", "def", "async", "function")
    shown = lambda df: sorted(map(str, df.where(F.col("text").contains("(") | F.col("text").rlike(rf"^({'|'.join(words[1:])})\s")).collect()))
    assert shown(A.source_lines(text, holding=words)) == shown(A.source_lines(text)) and A.source_lines(text, holding=words).count() < A.source_lines(text).count()

    nodes, edges = G.build(text)
    plan = G.rebuild(nodes, edges, text.where("path = 'a.py'"), text.where("path = 'b.js'").select("path"))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "left_anti" not in plan.lower() and "leftanti" not in plan.lower()


def test_predictions_pack_queries_once_and_meet_no_row_twice(spark):
    """Both searches read one set of packed queries; drivers and context stay in the row of their change, and what is stored is dealt into small tasks."""
    none = lambda schema: spark.createDataFrame([], schema)
    pending = diffs(spark, SF, spark.range(40).withColumnRenamed("id", "change_id")).withColumn("repository_id", F.col("change_id") % 2)
    points = spark.createDataFrame([(k, k % 2, ("commit", "issue")[k // 2 % 2], k, f"s{k}", f"t{k}", k % 3 == 0, [float(k), 1.0, -2.0, 3.0, 0.5, 1.0, 1.0, 2.0]) for k in range(16)], "vec_id long, repository_id long, entity_type string, entity_id long, commit_sha string, title string, is_regression boolean, embedding array<double>")
    made = lambda label: {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith(label)}
    before, sizes = made("search-queries"), []
    merged, spark_size = K.merge_files, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        K.merge_files = lambda *a: sizes.append(spark.conf.get(spark_size)) or merged(*a)
        rows = P.predict(pending, points, none("repository_id long, path string"), none("repository_id long, user_id long, username string, expertise_area string, ownership_score double"), none("repository_id long, user_id long, path string, weight double"), dims=8)
    finally:
        K.merge_files = merged
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/scored-") == 1 and len(made("search-queries") - before) == 1 and sizes == ["8m"]
    got = rows.collect()
    assert len(got) == pending.count() and all(r.status == "completed" and r.context and len(r.similar_commits) == 4 for r in got)


def test_reviewers_are_ranked_in_stored_steps(spark):
    """Shuffle files of one plan live together: what the last plan shuffles is the picks and what users own, not all that was made before."""
    targets = spark.createDataFrame([(1, 0, "a/x.py"), (1, 0, "b/y.py"), (2, 1, "a/x.py"), (3, 0, "c/z.py")], "change_id long, repository_id int, path string")
    profiles = spark.createDataFrame([(0, k, f"u{k}", ("", "a", "zz")[k % 3], k / 10) for k in range(6)], "repository_id int, user_id long, username string, expertise_area string, ownership_score double")
    own = spark.createDataFrame([(0, 0, "a/x.py", 0.5), (0, 0, "a/w.py", 1.0), (0, 1, "b/q.py", 1.0), (0, 3, "d/r.py", 1.0)], "repository_id int, user_id long, path string, weight double")
    rows = W.recommend(profiles, own, targets)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
    assert {(r.change_id, r.user_id): r.n_owned for r in rows.collect() if r.n_owned} == {(1, 0): 2, (1, 1): 1}


def test_bitmaps_are_sent_to_few_chunks(spark):
    """Each chunk of sets gets a copy of the bitmaps, so chunks follow the cores and the sets, not the number of shuffle partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        made = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("owned-sets")}
        before = made()
        rows = W.owned_counts(fixture(spark, SF, "ownership"), fixture(spark, SF, "ranked").select("change_id", "path"))
        dealt = [t for t in (spark.read.parquet(f"{shared_dir(spark)}/{f}") for f in made() - before) if "chunk" in t.columns]
        assert len(dealt) == 1 and dealt[0].agg(F.max("chunk")).first()[0] < 2 * spark.sparkContext.defaultParallelism
        assert rows.count() == fixture(spark, SF, "ranked").select("change_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_leaves_out_links_that_carry_nothing(spark):
    """In a graph without cycles powers end; rounds after that are not run, and the ranks are those of all rounds."""
    links = [(f"f{k}", f"p{k % 7}") for k in range(60)] + [(f"p{k}", f"s{k % 2}") for k in range(7)] + [("s0", "t"), ("s1", "t")]
    names = sorted({x for e in links for x in e})
    made = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("pagerank-")}
    before = made()
    rows = R.page_rank(spark.createDataFrame([(0, n) for n in names], "snapshot_id int, node_id string"), spark.createDataFrame([(0, *e) for e in links], "snapshot_id int, source_id string, target_id string"))
    assert len(made() - before) < 16  # 20 rounds made one each
    out = {n: [b for a, b in links if a == n] for n in names}
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(20):
        lost = sum(rank[n] for n in names if not out[n])
        new = dict.fromkeys(names, (0.15 + 0.85 * lost) / len(names))
        for n in names:
            for m in out[n]:
                new[m] += 0.85 * rank[n] / len(out[n])
        rank = new
    got = {r.node_id: r["rank"] for r in rows.collect()}
    assert set(got) == set(names) and all(abs(got[n] - rank[n] / max(rank.values())) < 1e-9 for n in names)
