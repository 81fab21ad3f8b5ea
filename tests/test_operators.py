"""Hand-computed cases."""

import json
import math
import os
import re

import numpy as np
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplecast.functions import columns as C
from ripplecast.functions.storage import numbered
from ripplecast.operators import code_graph as G
from ripplecast.operators import diffs as A
from ripplecast.operators import graph as R
from ripplecast.operators import metrics as M
from ripplecast.operators import reviewers as W
from ripplecast.operators import risk as K
from ripplecast.operators import scoring as P
from ripplecast.operators import vectors as V
from ripplecast.sources import tables as S
from ripplecast.sources import versions
from ripplecast.streaming import events as T
from ripplecast.streaming import ingest as I


def test_column_expressions(spark):
    rows = spark.createDataFrame([("src/A/x.TSX", "https://Host/r.git//"), ("build/y.py", None), (None, "")], "path string, url string")
    got = rows.select(C.language(F.col("path")), C.is_source_path(F.col("path")), C.normal_url(F.col("url")), C.directory(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("typescript", True, "https://host/r", "src/A"), ("python", False, None, "build"), (None, None, "", "")]
    paths = spark.createDataFrame([("/",), ("",), ("a\\b//c/./",), ("./x",), ("/a/",), ("/.",)], "p string").select(C.normal_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["/", ".", "a/b/c", "x", "/a", "/"]
    text = spark.createDataFrame([("if a:\n elif b:\n x && y ? 1",), ("  ",)], "t string").select(C.complexity(F.col("t"))).collect()
    assert [r[0] for r in text] == [6.0, 0.0]  # 'elif ' holds 'if ' as well


DIFF = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n ctx\n-def old(x):\n+def new(x):\ndiff --git a/b.py b/b.py\n--- /dev/null\n+++ b/b.py\n@@ -0,0 +1 @@\n+class B:"


def test_diff(spark):
    lines = A.diff_lines(spark.createDataFrame([(1, DIFF), (2, " ")], "change_id long, diff string"))
    files = A.file_changes(lines)
    assert sorted((r.path, r.change_type, r.added, r.deleted) for r in files.collect()) == [("a.py", "modified", 1, 1), ("b.py", "added", 1, 0)]
    assert [r.symbol for r in A.modified_symbols(lines).orderBy("place").collect()] == ["a.py::old", "a.py::new", "b.py::B:"]
    assert A.change_summary(files).first().deleted_ratio == 1 / 3


ODD_DIFFS = [
    # no git line, a line that looks like a header inside a hunk, a time after the name, and a second file behind it
    (1, "preamble\n--- a/x.py\t2024-01-01\n+++ b/x.py\t2024-01-02\n@@ -1,2 +1,2 @@\n--- gone\n+++ here\n ctx\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+def made():\n"),
    (2, "diff --git a/old name.py b/new name.py\nsimilarity index 100%\nrename from old name.py\nrename to new name.py\ndiff --git a/e.py b/e.py\nnew file mode 100644\nindex 0000000..e69de29\ndiff --git a/z.bin b/z.bin\ndeleted file mode 100644\nBinary files a/z.bin and /dev/null differ\n"),
    (3, "diff --git a/p.md b/p.md\n--- a/p.md\n+++ b/p.md\n@@ -0,0 +1,2 @@\n+a\n+b\n"),
    (4, "diff --git a/d.py b/d.py\n--- a/d.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-def f():\n--- a/q.js\n+++ b/q.js\n@@ -1 +1 @@\n-x\n+y\n@@ -9 +9 @@\n-u\n+v"),
    (5, None), (6, ""), (7, "no diff at all"),
]


def test_odd_diffs(spark):
    files = A.file_changes(A.diff_lines(spark.createDataFrame(ODD_DIFFS, "change_id long, diff string")))
    assert sorted((r.change_id, r.file_ord, r.path, r.change_type, r.added, r.deleted, r.old_path) for r in files.collect()) == [
        (1, 1, "x.py", "modified", 1, 1, None), (1, 2, "new.py", "added", 1, 0, None),
        (2, 1, "new name.py", "renamed", 0, 0, "old name.py"), (2, 2, "e.py", "added", 0, 0, None), (2, 3, "z.bin", "deleted", 0, 0, None),
        (3, 1, "p.md", "added", 2, 0, None), (4, 1, "d.py", "deleted", 0, 1, None), (4, 2, "q.js", "modified", 2, 2, None),
    ]


FILES = [
    ("app/service.py", "import utils\nfrom os import path\nclass Base:\nclass Svc(Base):\ndef run(x):\n    helper(x)\n    run(x)\n    requests.get(u)"),
    ("app/a_helper.py", "def helper(x):\n    return x"),
    ("utils.py", "def util():\n    pass"),
    ("user_service/main.js", "export class M extends Svc {\nfunction go() {\n  cache.get(k)"),
]


def test_graph_build_and_rebuild(spark):
    sources = spark.createDataFrame(FILES, "path string, content string")
    nodes, edges = G.build(sources)
    found = {(r.source_id, r.target_id, r.edge_type, r.weight) for r in edges.collect()}
    assert ("file:app/service.py", "file:utils.py", "import", 2.0) in found
    assert ("function:app/service.py::run", "function:app/a_helper.py::helper", "call", 1.0) in found
    assert ("class:app/service.py::Svc", "class:app/service.py::Base", "inheritance", 1.0) in found
    assert ("class:user_service/main.js::M", "class:app/service.py::Svc", "inheritance", 1.0) in found
    assert ("file:app/service.py", "service:api:requests", "api_call", 1.0) in found
    assert ("file:user_service/main.js", "service:user_service", "microservice", 1.0) in found
    assert not any(s == t for s, t, *_ in found)
    # a file changed into itself keeps its imports, calls and bases in files that stay, and loses what others had in it
    again = spark.createDataFrame([FILES[0]], "path string, content string")
    nodes1, edges1 = G.rebuild(nodes, edges, again, again.where("false").select("path"))
    rebuilt = {(r.source_id, r.target_id, r.edge_type, r.weight) for r in edges1.collect()}
    assert {r.node_id for r in nodes1.collect()} == {r.node_id for r in nodes.collect()}
    assert found - rebuilt == {("class:user_service/main.js::M", "class:app/service.py::Svc", "inheritance", 1.0)} and not rebuilt - found
    changed = spark.createDataFrame([("utils.py", "def other():\n    pass")], "path string, content string")
    nodes2, _ = G.rebuild(nodes, edges, changed, spark.createDataFrame([("user_service/main.js",)], "path string"))
    ids = {r.node_id for r in nodes2.collect()}
    assert "function:utils.py::other" in ids and "function:utils.py::util" not in ids and "file:user_service/main.js" not in ids


def test_names_resolve_to_classes_first_and_to_earlier_files(spark):
    files = [("b.py", "def thing(x):\n    pass\nclass thing(Base):\n    pass\nthing(1)\nlater(2)"), ("a.py", "thing(1)"), ("c.py", "def later(x):\n    thing(3)")]
    nodes, edges = G.build(spark.createDataFrame(files, "path string, content string"))
    calls = {(r.source_id, r.target_id) for r in edges.where("edge_type = 'call'").collect()}
    assert calls == {("function:b.py::thing", "class:b.py::thing"), ("function:c.py::later", "class:b.py::thing")}
    assert {r.language for r in nodes.where("node_type = 'file'").collect()} == {"python"}


def test_page_rank_and_reach(spark):
    nodes = spark.createDataFrame([(0, n, "file", n) for n in "abcd"], "snapshot_id int, node_id string, node_type string, file_path string")
    edges = spark.createDataFrame([(0, "a", "b", "import", 1.0), (0, "b", "c", "import", 1.0), (0, "x", "c", "import", 1.0)], "snapshot_id int, source_id string, target_id string, edge_type string, weight double")
    rank = {r.node_id: r["rank"] for r in R.page_rank(nodes, edges).collect()}
    want = dict.fromkeys("abcd", 0.25)
    for _ in range(20):
        lost = want["c"] + want["d"]
        got = {"b": want["a"], "c": want["b"]}
        want = {n: 0.15 / 4 + 0.85 * (got.get(n, 0) + lost / 4) for n in "abcd"}
    assert all(math.isclose(rank[n], want[n] / max(want.values()), rel_tol=1e-9) for n in "abcd")
    seeds = spark.createDataFrame([(0, "a"), (0, "nobody")], "snapshot_id int, node_id string")
    found, met = R.subgraph(nodes, edges, seeds, 1)
    assert sorted(r.node_id for r in found.collect()) == ["a", "b"] and met.count() == 1


def test_subgraph_of_three_and_its_cut(spark):
    nodes = spark.createDataFrame([(0, n, "file", n) for n in "abc"], "snapshot_id int, node_id string, node_type string, file_path string")
    edges = spark.createDataFrame([(0, "a", "b", "import", 1.0), (0, "b", "c", "import", 1.0)], "snapshot_id int, source_id string, target_id string, edge_type string, weight double")
    seeds = spark.createDataFrame([(0, "a")], "snapshot_id int, node_id string")
    for most, want in ((None, ("abc", 2)), (2, ("ab", 1))):
        found, met = R.subgraph(nodes, edges, seeds, 2, most)
        assert ("".join(sorted(r.node_id for r in found.collect())), met.count()) == want


def test_a_hub_sends_no_more_than_the_budget(spark):
    """A hub of many neighbours: the nearest stay, and what a level passes on to its ranking is cut in the tasks."""
    n = 20_000
    nodes = spark.range(n).select(F.lit(0).alias("snapshot_id"), F.format_string("n%05d", "id").alias("node_id"))
    edges = spark.range(1, n).select(F.lit(0).alias("snapshot_id"), F.lit("n00000").alias("source_id"), F.format_string("n%05d", "id").alias("target_id"), F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(edges.limit(1).select("snapshot_id", F.lit("n00001").alias("source_id"), F.lit("n19999").alias("target_id"), "edge_type", "weight"))
    seeds = spark.createDataFrame([(0, "n00000")], "snapshot_id int, node_id string")
    found, met = R.subgraph(nodes, edges, seeds, 5, 50)
    assert sorted(r.node_id for r in found.collect()) == [f"n{k:05d}" for k in range(50)] and met.count() == 49
    ranked = nodes.withColumn("k", F.dense_rank().over(Window.partitionBy("snapshot_id").orderBy("node_id"))).where("k <= 50")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()


def test_network_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = {(g, n): rng.normal(size=3) for g in (0, 1) for n in "abcd"}
    ends = [(0, "a", "b"), (0, "c", "b"), (0, "b", "d"), (1, "a", "d"), (1, "d", "a"), (1, "a", "d")]
    net = R.seeded_network(3, hidden=5, out=4, layers=2, history=2, seed=3)
    frame = spark.createDataFrame([(g, n, v.tolist()) for (g, n), v in vectors.items()], "snapshot_id int, node_id string, vector array<double>")
    edges = spark.createDataFrame(ends, "snapshot_id int, source_id string, target_id string")
    past = spark.createDataFrame([(1, [0.5, -1.0])], "snapshot_id int, history array<double>")
    logits, graphs = R.network_scores(frame, edges, net, past)
    x = dict(vectors)
    for own, other, bias, scale, shift in net.layers:
        mean = {k: np.mean([x[k[0], a] for g, a, b in ends if (g, b) == k] or [np.zeros(len(x[k]))], axis=0) for k in x}
        x = {k: np.maximum((x[k] @ own + mean[k] @ other + bias) * scale + shift, 0) for k in x}
    head = lambda v, w: np.maximum(v @ w[0] + w[1], 0) @ w[2] + w[3]
    assert all(math.isclose(r.logit, head(x[r.snapshot_id, r.node_id], net.node)[0], abs_tol=1e-9) for r in logits.collect())
    for r in graphs.collect():
        v = np.concatenate([np.mean([x[k] for k in x if k[0] == r.snapshot_id], axis=0), [0.5, -1.0] if r.snapshot_id else [0, 0]])
        risk = head(v, net.risk)
        assert math.isclose(r.risk, 100 / (1 + math.exp(-risk[0]))) and math.isclose(r.regression_logit, risk[1]) and math.isclose(r.confidence, 1 / (1 + math.exp(-head(v, net.confidence)[0])))


def test_places_by_ranges(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, k * 7919 % 1009) for k in range(1000)], "g int, x int").repartition(5)
    for keys in (["g"], []):
        got = {}
        for r in numbered(rows, keys, [F.desc("x")], "place").collect():
            got.setdefault(r.g if keys else 0, []).append((r.place, -r.x))
        assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) and [x for _, x in sorted(v)] == sorted(x for _, x in v) for v in got.values())


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.9, True, 80.0, 70.0), (1, 0.6, False, 50.0, 40.0), (1, 0.4, True, 20.0, 30.0), (1, 0.1, False, 10.0, 0.0)], "suite int, p double, truth boolean, risk double, true_risk double")
    r = M.pooled(rows, ["suite"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1, r.roc_auc, r.rmse, r.mae) == (1, 1, 1, 1, 0.5, 0.75, 10.0, 10.0)
    assert math.isclose(r.ece, (0.1 + 0.6 + 0.6 + 0.1) / 4)
    whole = M.pooled(rows, []).first()
    assert (whole.n, whole.tp, whole.roc_auc) == (4, 1, 0.75) and "suite" not in whole.asDict()


def test_linear_model(spark):
    changes = spark.createDataFrame([(1, 20, 500, 0, 0.0, 25, 0, 5)], "change_id long, n_files long, added long, deleted long, complexity_delta double, n_functions long, renames long, surface long")
    past = spark.createDataFrame([], "change_id long, regression_rate double, max_similarity double, mean_similarity double, history_risk double, history_p double")
    r = K.linear_score(K.features(changes, past)).first()
    logit = 8 + 12 + 8 + 9 + 13
    p = 1 / (1 + 2.718281828 ** (-(logit - 50) / 12))
    assert math.isclose(r.linear_p, p) and math.isclose(r.linear_risk, 0.85 * logit + 20 * p)


def murmur3(term: str, seed: int = 42) -> int:
    """32-bit MurmurHash3 of the UTF-8 bytes."""
    data, h, mask = term.encode(), seed, 0xFFFFFFFF
    rot = lambda x, n: (x << n | x >> (32 - n)) & mask
    mix = lambda k: rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    for k in range(0, len(data) // 4 * 4, 4):
        h = (rot(h ^ mix(int.from_bytes(data[k : k + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    h ^= mix(int.from_bytes(data[len(data) // 4 * 4 :], "little")) if len(data) % 4 else 0
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def test_model_embedding_matches_term_weights(spark):
    texts = [(1, "a b b c"), (2, "a d"), (3, None), (4, "B  c zebra"), (5, "a")]
    got = {r.doc_id: np.array(r.vector) for r in V.model_embedding(spark.createDataFrame(texts, "doc_id long, text string"), dims=32).collect()}
    counts = {i: np.zeros(32) for i, _ in texts}
    for i, t in texts:
        for w in re.split(r"\s", (t or "").lower()):
            h = murmur3(w)
            counts[i][(h - 2**32 if h >= 2**31 else h) % 32] += 1
    idf = np.log((len(texts) + 1) / (sum((c > 0).astype(int) for c in counts.values()) + 1))
    for i, c in counts.items():
        want = c * idf
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))


def test_a_model_of_ones_own(spark):
    frame = spark.createDataFrame([(1, "abc"), (2, None), (3, "z")], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in V.encode_with(frame, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch_rows=2).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / math.sqrt(10)) and got[2] == [0.0, 1.0] and np.allclose(got[3], [math.sqrt(0.5)] * 2)


def test_approximate_search_recalls_the_exact_one(spark):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    queries = points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in V.top_k(points.withColumn("c", F.lit(1)), queries.withColumn("c", F.lit(1)), ["c"]).collect()}
    near = {(r.query_id, r.vec_id) for r in V.approximate_top_k(points, queries).collect()}
    assert len(near & exact) / len(exact) >= 0.9 and len(near) == len(exact)
    few = V.approximate_top_k(points, queries, probes=4)
    assert few.groupBy("query_id").count().where("count > 10").isEmpty()


def test_trained_models(spark):
    """The risk is linear in the features, so least squares finds it; the flags of files follow one slot."""
    rng = np.random.default_rng(2)
    rows = [(k, "train" if k % 3 else "validation", *rng.random(10).tolist()) for k in range(300)]
    frame = spark.createDataFrame(rows, "change_id long, split string, " + ", ".join(f"f_{n} double" for n in K.FEATURES))
    frame = frame.withColumn("risk_label", sum((w * F.col(f"f_{n}") for n, w in zip(K.FEATURES, K.WEIGHTS)), F.lit(3.0))).withColumn("is_regression", F.col("f_added") > 0.5)
    got = K.trained(frame).join(frame.select("change_id", "risk_label", "is_regression"), "change_id").where("split = 'validation'").collect()
    assert len(got) == 100 and all(abs(r.risk_hat - r.risk_label) < 1e-6 for r in got)
    assert np.mean([(r.p_hat >= 0.5) == r.is_regression for r in got]) > 0.9 and np.mean([(r.p_trees >= 0.5) == r.is_regression for r in got]) > 0.9
    nodes = spark.createDataFrame([(0, f"n{k}", k % 4 > 0, float(k % 2), [float(k % 2), 1.0]) for k in range(80)], "snapshot_id int, node_id string, is_file boolean, target double, features array<float>")
    p = {r.node_id: r.p_hat for r in K.trained_nodes(nodes.select("snapshot_id", "node_id", "features"), nodes.drop("features")).collect()}
    assert all((p[f"n{k}"] > 0.5) == (k % 2 == 1) for k in range(80))


def test_failed_and_blank_changes(spark):
    pending = spark.createDataFrame([(1, 1, DIFF), (2, 1, ""), (3, 2, "@@ -1 +1 @@\n-x\n+y"), (4, 2, None), (5, 1, DIFF + "\ndiff --git a/c.py b/c.py\n--- a/c.py\n+++ b/c.py\n@@ -1,5 +1,5 @@\n-x\n+y")], "change_id long, repository_id int, diff string")
    points = spark.createDataFrame([(7, 1, "commit", 7, "f" * 40, "m", True, [1.0] * 8), (8, 1, "issue", 8, None, "t", False, [1.0] * 8)], "vec_id long, repository_id int, entity_type string, entity_id long, commit_sha string, title string, is_regression boolean, embedding array<double>")
    files = spark.createDataFrame([(1, "a.py"), (1, "z.py")], "repository_id int, path string")
    profiles = spark.createDataFrame([(1, 5, "ann", "a.py", 0.5), (2, 6, "bob", "", 0.9)], "repository_id int, user_id long, username string, expertise_area string, ownership_score double")
    own = spark.createDataFrame([(1, 5, "b.py", 1.0)], "repository_id int, user_id long, path string, weight double")
    got = {r.change_id: r for r in P.predict(pending, points, files, profiles, own, dims=8).collect()}
    assert [(got[k].status, got[k].error) for k in (3, 5)] == [("failed", "Invalid unified diff")] * 2 and [got[k].status for k in (1, 2, 4)] == ["completed"] * 3
    assert sorted(f.path for f in got[1].affected_files) == ["a.py", "b.py", "z.py"] and got[1].suggested_reviewers[0].username == "ann"
    assert got[1].similar_commits[0].sha == "f" * 40 and got[1].similar_bugs[0].title == "t" and "1 similar past commit(s)" in got[1].risk_text
    assert got[4].affected_files is None and got[4].similar_commits is None and json.loads(got[1].context)["diff_summary"]["added_lines"] == 2


def test_a_trained_network_takes_the_place_of_the_heuristic(spark):
    pending = spark.createDataFrame([(1, 1, DIFF), (2, 1, DIFF)], "change_id long, repository_id int, diff string")
    none = lambda kind: spark.createDataFrame([], kind)
    points = none("vec_id long, repository_id int, entity_type string, entity_id long, commit_sha string, title string, is_regression boolean, embedding array<double>")
    graphs = spark.createDataFrame([(1, 77.0, 0.0, 0.9)], "change_id long, risk double, regression_logit double, confidence double")
    files = spark.createDataFrame([(1, "hit.py", 0.8, 1.0, 1), (1, "a.py", 0.3, 0.5, 2)], "change_id long, path string, p double, importance double, rank int")
    profiles, own = none("repository_id int, user_id long, username string, expertise_area string, ownership_score double"), none("repository_id int, user_id long, path string, weight double")
    got = {r.change_id: r for r in P.predict(pending, points, none("repository_id int, path string"), profiles, own, dims=8, learned=(graphs, files)).collect()}
    assert "GNN contributed 77.0" in got[1].risk_text and "GNN contributed 77.0" not in got[2].risk_text
    assert [f.path for f in got[1].affected_files] == ["hit.py", "a.py"] and "hit.py" not in [f.path for f in got[2].affected_files]
    assert json.loads(got[1].context)["ml_predictions"]["gnn_regression_probability"] == 0.5 and got[1].confidence > got[2].confidence


def test_reviewers_by_hand(spark):
    """Profiles of another repository do not compete; exact scores rank."""
    profiles = spark.createDataFrame([(1, 1, "alice", "src", 0.8), (1, 2, "bob", "docs", 0.3), (2, 3, "eve", "src", 1.0)], "repository_id int, user_id long, username string, expertise_area string, ownership_score double")
    own = spark.createDataFrame([(1, 1, "src/a.py", 0.8), (2, 3, "src/a.py", 1.0)], "repository_id int, user_id long, path string, weight double")
    targets = spark.createDataFrame([(1, 9, "src/a.py")], "repository_id int, change_id long, path string")
    got = [(r.username, r.score, r.rationale) for r in W.recommend(profiles, own, targets).orderBy("rank").collect()]
    assert got == [("alice", 0.84, "Owns 1 affected file(s); overlap=0.80"), ("bob", 0.09, "Repository contributor (ownership=0.30)")]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "suite.json").write_text(json.dumps({"samples": [{"id": "s1", "diff": "d", "ground_truth": {"risk_score": 5.0, "is_regression": True}}]}))
    r = S.read_suites(spark, f"{tmp_path}/suite.json").first()
    assert (r.suite, r.sample_id, r.description, r.affected_files) == ("suite", "s1", "", [])
    snap = lambda sha, n: spark.createDataFrame([("r", sha, n)], "repository_id string, sha string, node_id string")
    S.write_snapshot(snap("a" * 40, "n1"), snap("a" * 40, "e1"), f"{tmp_path}/snap")
    S.write_snapshot(snap("b" * 40, "n2"), snap("b" * 40, "e2"), f"{tmp_path}/snap")
    S.write_snapshot(snap("a" * 40, "n3"), snap("a" * 40, "e3"), f"{tmp_path}/snap")
    assert sorted(r.node_id for r in S.read_snapshot(spark, f"{tmp_path}/snap", "nodes").collect()) == ["n2", "n3"]
    assert [r.node_id for r in S.read_snapshot(spark, f"{tmp_path}/snap", "nodes", "r", "a" * 40).collect()] == ["n3"]
    (tmp_path / "graph.json").write_text(json.dumps({"repository_id": "r", "sha": "c", "nodes": [{"node_id": "n"}], "edges": [{"source_id": "n", "target_id": "m", "edge_type": "call"}]}))
    nodes, edges = S.import_snapshots(spark, f"{tmp_path}/graph.json")
    assert nodes.first().properties == {} and edges.first().weight == 1.0
    for k in range(3):
        S.append_report(spark.createDataFrame([(k, k * 10)], "report_id int, created_s int"), f"{tmp_path}/reports")
    assert [r.report_id for r in S.list_reports(spark, f"{tmp_path}/reports", 2).collect()] == [2, 1]
    p = spark.createDataFrame([(1, "r", '{"similar_commits":[{"sha":"x"}]}'), (2, "r", None)], "change_id int, repository_id string, payload string")
    S.write_predictions(p.where("change_id = 1"), p.where("change_id = 1").select("change_id", "repository_id"), f"{tmp_path}/out")
    S.write_predictions(p.where("change_id = 2"), p.where("change_id = 2").select("change_id", "repository_id"), f"{tmp_path}/out")
    S.write_predictions(p.where("change_id = 1"), p.where("false").select("change_id", "repository_id"), f"{tmp_path}/out")
    assert [r.change_id for r in versions.read(spark, f"{tmp_path}/out", "files").collect()] == [2]
    S.write_snapshot(snap("a" * 40, "n4"), snap("a" * 40, "e4").where("false"), f"{tmp_path}/snap")
    assert [r.node_id for r in S.read_snapshot(spark, f"{tmp_path}/snap", "edges").collect()] == ["e2"]
    rows = S.read_payload(versions.read(spark, f"{tmp_path}/out", "predictions")).orderBy("change_id").collect()
    assert rows[0].similar_commits[0].is_regression is False and rows[1].reviewers == []


def test_streams_match_their_batches(spark, tmp_path):
    os.makedirs(tmp_path / "hits")
    events = [(u, s, f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", 500 if s % 9 == 0 else 200, "h") for u in (1, 2) for s in range(0, 600, 3)]
    (tmp_path / "hits/a.json").write_text("\n".join(json.dumps(dict(zip(("user_id", "at_s", "at", "status", "handler"), e))) for e in events))
    kind = "user_id long, at_s long, at timestamp, status int, handler string"
    stream = spark.readStream.schema(kind).json(f"{tmp_path}/hits")
    batch = spark.read.schema(kind).json(f"{tmp_path}/hits")

    def drained(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        return sorted(map(str, spark.table(name).collect()))

    assert drained(T.error_ratio(stream), "ratio") == sorted(map(str, T.error_ratio(batch).collect()))
    assert drained(T.rates(stream), "rates") == sorted(map(str, T.rates(batch).collect()))


def test_webhooks_and_commit_stream(spark, tmp_path):
    os.makedirs(tmp_path / "hooks")
    hook = lambda action: json.dumps({"provider": "github", "at": "2024-01-01T00:00:00Z", "payload": json.dumps({"action": action, "pull_request": {"number": 7, "title": "t", "body": "b", "head": {"sha": "s"}}, "repository": {"full_name": "o/r", "clone_url": "http://H/o/r.git"}})})
    lab = json.dumps({"provider": "gitlab", "at": "2024-01-01T00:00:00Z", "payload": json.dumps({"object_kind": "merge_request", "project": {"path_with_namespace": "o/r", "git_http_url": "http://h/x"}, "object_attributes": {"action": "open", "iid": 9, "title": "t", "description": "", "last_commit": {"id": "z"}}})})
    (tmp_path / "hooks/a.json").write_text("\n".join([hook("opened"), hook("opened"), hook("closed"), lab]))
    q = T.once(T.request_events(T.webhook_stream(spark, f"{tmp_path}/hooks"))).writeStream.format("memory").queryName("hooks").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    events = spark.table("hooks")
    assert sorted((r.repo, r.number) for r in events.collect()) == [("o/r", 7), ("o/r", 9)]
    matched, dead = T.pending(events, spark.createDataFrame([(1, "http://h/o/r/")], "repository_id int, url string"))
    assert matched.first().diff.startswith("diff --git a/webhook/o_r/pr-7.md") and dead.count() == 1
    os.makedirs(tmp_path / "commits")
    commit = {"repository_id": 1, "sha": "a", "day_s": 1, "message": "m", "author": "x", "is_regression": False, "files": [{"path": "a.py", "content": "def f(x):"}]}
    (tmp_path / "commits/a.json").write_text(json.dumps(commit) + "\n" + json.dumps(commit))
    I.process(I.commit_stream(spark, f"{tmp_path}/commits"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    table = lambda name: versions.read(spark, f"{tmp_path}/out", name)
    assert table("commits").count() == 1 and len(table("vectors").first().vector) == 384
    # a later batch: one commit is stored already, another repository has a file of the same name
    (tmp_path / "commits/b.json").write_text("\n".join(json.dumps(commit | x) for x in ({}, {"repository_id": 2, "sha": "b"}, {"repository_id": 3, "sha": "c"})))
    I.process(I.commit_stream(spark, f"{tmp_path}/commits"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert sorted((r.repository_id, r.sha) for r in table("commits").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    files = table("nodes").where("node_type = 'file'")
    assert sorted((r.repository_id, r.file_path) for r in files.collect()) == [(1, "a.py"), (2, "a.py"), (3, "a.py")]
