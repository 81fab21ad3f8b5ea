"""Rules over time: batch forms against plain loops, streams with late rows against their batch forms."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplecast.sources import versions
from ripplecast.streaming import events as T
from ripplecast.streaming import rules as L

KIND = "user_id long, event_id long, at_s long, handler string, status int, latency_s double"
START = 1_700_000_040  # on a minute


def bursts(seed, users=4, n=400):
    """Hits in bursts and lulls, many in the same second."""
    rng, out = random.Random(seed), []
    for user in range(users):
        t = START + rng.randint(0, 100)
        for _ in range(n // users):
            t += rng.choice([0, 0, 0, 1, 1, 2, 5, 30, 200 if rng.random() < 0.2 else 1])
            out.append((user, len(out), t, f"h{user}", 500 if rng.random() < 0.1 else 200, rng.expovariate(1.0)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("at", F.timestamp_seconds("at_s"))


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def log_rows(rows, span, most):
    out = []
    for user, own in by_user(rows).items():
        log = []
        for _, i, t, *_ in own:
            log = [x for x in log if x > t - span]
            out.append((user, t, i, len(log), len(log) >= most))
            if len(log) < most:
                log.append(t)
    return sorted(out)


def window_rows(rows, span, most):
    out = []
    for user, own in by_user(rows).items():
        opened, hits = None, 0
        for _, i, t, *_ in own:
            if opened is None or t >= opened + span:
                opened, hits = t, 0
            hits += 1
            out.append((user, t, i, opened, hits, hits > most))
    return sorted(out)


@pytest.mark.parametrize(("span", "most", "users"), [(60, 3, 4), (60, 1000, 4), (200, 1, 1)])
def test_sliding_log(spark, span, most, users):
    """One user's hits lie in several ranges here, each of which is handed the log before it."""
    rows = bursts(span + most, users)
    got = L.sliding_log(frame(spark, rows), span, most)
    assert sorted(map(tuple, got.collect())) == log_rows(rows, span, most)
    assert L.sliding_log(frame(spark, rows).limit(0), span, most).count() == 0


@pytest.mark.parametrize(("span", "bin_s"), [(60, 100), (7, 3600)])
def test_first_hit_windows(spark, span, bin_s):
    rows = bursts(span)
    want = {}
    for user, _, _, opened, hits, _ in window_rows(rows, span, 3):
        want[user, opened] = max(want.get((user, opened), 0), hits)
    got = L.first_hit_windows(frame(spark, rows), span, 3, bin_s)
    assert sorted(map(tuple, got.collect())) == sorted((u, o, n, n > 3) for (u, o), n in want.items())


def test_target_down(spark):
    rows = [(0, k, START + t, h, 200, 0.0) for k, (h, t) in enumerate([("a", 0), ("a", 30), ("a", 200), ("b", 0), ("b", 60), ("c", 500), ("a", 200)])]
    got = lambda end: sorted(map(tuple, L.target_down(frame(spark, rows), 60, end).collect()), key=str)
    a = ("a", START + 30, START + 200)
    assert got(None) == [a]
    assert got(START + 261) == sorted([a, ("a", START + 200, None), ("b", START + 60, None)], key=str)
    assert L.target_down(frame(spark, rows).limit(0), 60, START).count() == 0
    many = bursts(9, 3)
    want = sorted((h, x, y) for _, own in by_user(many).items() for h in [own[0][3]] for x, y in zip(sorted({r[2] for r in own}), sorted({r[2] for r in own})[1:], strict=False) if y - x > 20)
    assert sorted(map(tuple, L.target_down(frame(spark, many), 20).collect())) == want and len(want) > 5


def test_sketches_are_near_the_exact_quantile(spark):
    rng = np.random.default_rng(1)
    rows = [(0, k, START + int(t), "h", 200, float(v)) for k, (t, v) in enumerate(zip(rng.integers(0, 600, 60_000), rng.lognormal(0, 1, 60_000), strict=True))]
    got = L.latency_over(L.latency_sketches(frame(spark, rows))).collect()
    assert len(got) == 14
    for r in got:
        own = np.sort([v for _, _, t, _, _, v in rows if r.start_s <= t < r.start_s + 300])
        assert abs(np.searchsorted(own, r.value) / len(own) - 0.95) < 0.01 and r.over == (r.value > 2)


def runs(windows, steps):
    out, run = [], []
    for s, over in sorted(windows) + [(math.inf, False)]:
        if run and (not over or s != run[-1] + 60):
            out += [(run[0], run[-1], len(run))] if len(run) >= steps else []
            run = []
        run += [s] if over else []
    return out


def test_sustained(spark):
    rng = random.Random(4)
    windows = [(START - START % 86400 + 86400 + 60 * k, rng.random() < 0.8) for k in range(-60, 200) if rng.random() < 0.97]
    got = L.sustained(spark.createDataFrame(windows, "start_s long, over boolean"), 5)
    assert sorted(map(tuple, got.collect())) == runs(windows, 5)


@pytest.fixture
def rocks(spark):
    for k, v in L.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in L.STATE_STORE:
        spark.conf.unset(k)


def drained(spark, path, rows, build, late_by=100):
    """The rows of a stream that gets ``rows`` in five files, each shuffled with the next in time, then one that moves the watermark on."""
    os.makedirs(f"{path}/in")
    rng = random.Random(7)
    order = sorted(rows, key=lambda r: r[2] + rng.randint(0, late_by))
    end = max(r[2] for r in rows)
    files = [order[k * len(order) // 5 : (k + 1) * len(order) // 5] for k in range(5)] + [[(-1, -1 - k, end + 100_000 + k, "end", 200, 0.0)] for k in range(3)]
    names = "user_id event_id at_s handler status latency_s".split()
    for k, own in enumerate(files):
        with open(f"{path}/in/{k}.json", "w") as f:
            f.write("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in own))
        os.utime(f"{path}/in/{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(f"{path}/in").withColumn("at", F.timestamp_seconds("at_s"))
    q = build(stream).writeStream.format("memory").queryName("drained").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/c").start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table("drained").collect()]


def test_limit_streams(spark, rocks, tmp_path):
    rows = bursts(1)
    got = drained(spark, f"{tmp_path}/a", rows, lambda s: L.sliding_log_stream(s, 60, 3))
    assert sorted(r for r in got if r[0] >= 0) == log_rows(rows, 60, 3)
    got = drained(spark, f"{tmp_path}/b", rows, lambda s: L.first_hit_stream(s, 60, 3))
    assert sorted(r for r in got if r[0] >= 0) == window_rows(rows, 60, 3)


def test_silence_stream(spark, rocks, tmp_path):
    """A target that never comes back is told as well, and one whose late beat closes the gap is not."""
    rows = bursts(2)
    got = drained(spark, str(tmp_path), rows, lambda s: L.silence_stream(s, 60))
    want = L.target_down(frame(spark, rows), 60, end_s=max(r[2] for r in rows) + 100_000).select("handler", "last_s")
    assert sorted(r for r in got if r[0] != "end") == sorted(map(tuple, want.collect())) and {h for h, _ in got} >= {"h0", "h1", "h2", "h3"}


def test_alert_streams(spark, rocks, tmp_path):
    rows = [r for k, r in enumerate(bursts(3, 2, 900)) if k % 300 < 250]
    for k, (build, over) in enumerate((
        (lambda s: L.ratio_over(T.error_ratio(s)), lambda s: L.ratio_over(T.error_ratio(s))),
        (lambda s: L.latency_over(L.latency_sketches(s)), lambda s: L.latency_over(L.latency_sketches(s))),
    )):
        got = drained(spark, f"{tmp_path}/{k}", rows, lambda s, f=build: L.sustained_stream(f(s)))
        windows = [(r.start_s, r.over) for r in over(frame(spark, rows)).collect()]
        want = runs(windows, 5)
        assert sorted(r[1:] for r in got) == want and want


def test_pending_predictions_and_dead_letters(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    hook = lambda n, url: json.dumps({"provider": "github", "at": "2024-01-01T00:00:00Z", "payload": json.dumps({"action": "opened", "pull_request": {"number": n, "title": "t", "body": "b", "head": {"sha": "s"}}, "repository": {"full_name": "o/r", "clone_url": url}})})
    known = spark.createDataFrame([(1, "http://h/a/")], "repository_id int, url string")
    table = lambda name: sorted(r.number for r in versions.read(spark, f"{tmp_path}/out", name).collect())
    for k, (n, url) in enumerate(((1, "http://H/a.git"), (2, "http://h/b"))):
        (tmp_path / f"in/{k}.json").write_text(hook(n, url))
        T.store_pending(T.request_events(T.webhook_stream(spark, f"{tmp_path}/in")), known, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert table("predictions") == [1] and table("dead_letters") == [2]
    row = versions.read(spark, f"{tmp_path}/out", "predictions").first()
    assert (row.status, row.repository_id) == ("pending", 1) and row.diff.startswith("diff --git a/webhook/o_r/pr-1.md")
