"""Periodic runs and collocations against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ripplecast.llm import periods, phrases, queries

KIND = "doc_id long, text string, lang string, n_runs long, block long, f string"
LONG = " ".join(f"w{k % 977} x{k % 89}" for k in range(20_000))
ODD = [
    (1, None, "en", 0, 0, "a"), (2, "", None, None, None, None), (3, "   \n\t ", "en", 1, 1, None), (4, "a b a b a b a b. a b", "en", 1, 1, None), (4, "a b a b a b a b. a b", "en", 1, 1, None),
    (6, LONG, "en", 1, 1, None), (7, LONG + " tail", "de", 1, 1, None), (None, "x x x x x x", "en", 1, 1, None), (8, "ŻÓŁĆ Ż,Ó a! a? A;a\r\na a:a\x0ba\x0ca a\xa0a\x1ca", None, 1, 1, None), (-9, "A a A a", "und", 1, 1, None),
]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_runs(w, m=6, e=4):
    n, out = len(w), []
    for q in range(1, n // e + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(m, e * q) and not any(all(w[k] == w[k + d] for k in range(s, i + q - d)) for d in range(1, q)):
                out.append((s, i - s + q, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    w, h = words_of(text), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


@pytest.mark.parametrize("shape", [(6, 4), (6, 3), (20, 3), (1, 5)])
def test_find_runs(shape):
    rng = random.Random(sum(shape))
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.randint(0, 120):
                w += [rng.randint(0, 2) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8) if rng.random() < 0.4 else [rng.randint(0, rng.choice([1, 3, 50]))]
            docs.append(w)
        found = periods.find_runs(np.array(sum(docs, []), np.int64), np.array([len(w) for w in docs], np.int64), *shape)
        assert found.tolist() == [(k, *r) for k, w in enumerate(docs) for r in brute_runs(w, *shape)]


def test_overlap_is_the_least():
    for m, e in ((6, 4), (6, 3), (20, 3), (1, 5)):
        assert [periods.overlap(j, m, e) for j in range(7)] == [min(max((e - 1) * q, m - q) for q in range(1 << j, 2000)) for j in range(7)]


def test_op12_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(words_of(r.text)) <= 1500]
    assert len(short) > 150
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in short:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)
    assert sum(got[r.doc_id][1] > 0 for r in docs) > 10


def test_runs_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, KIND)
    got = sorted(map(tuple, periods.collapse_runs(odd, digest=True).collect()), key=str)
    plain = [(d, t) for d, t, *_ in ODD]
    want = [brute_row(None, t) for _, t in plain]  # nothing is planted
    assert got == sorted([(d, *w[1:]) for (d, t), w in zip(plain, want, strict=True) if len(words_of(t)) < 5000] + [g for g in got if g[0] in (6, 7)], key=str)
    spelt = {r.doc_id: r for r in periods.collapse_runs(odd).collect()}
    assert spelt[4].runs == [] and spelt[None].collapsed == "x" and [tuple(r) for r in spelt[None].runs] == [(0, 6, 1)]
    assert [tuple(r) for r in spelt[6].runs] == [] and spelt[1].collapsed == "" and spelt[2].n_runs == 0
    assert periods.collapse_runs(odd.limit(0)).count() == 0 and periods.with_planted_runs(odd.limit(0)).count() == 0
    assert periods.with_planted_runs(odd).count() == len(ODD)


def test_runs_in_a_long_text(spark):
    """One word, 300,000 times, and a passage that comes back at many distances: as long as its words, not its pairs."""
    rng = random.Random(3)
    line = [f"w{k}" for k in range(40)]
    scattered = [x for _ in range(3000) for x in [*line, *(f"u{rng.random()}" for _ in range(rng.randint(1, 30)))]]
    df = spark.createDataFrame([(1, "one " * 300_000), (2, " ".join(scattered))], "doc_id long, text string")
    got = {r.doc_id: r for r in periods.collapse_runs(df).collect()}
    assert (got[1].n_runs, got[1].length, got[1].collapsed) == (1, 300_000, "one") and got[2].n_runs == 0


def test_pair_counts_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(0)
    left, right = rng.zipf(1.3, 50_000) % 5000, rng.zipf(1.3, 50_000) % 3000
    want = dict(zip(*(x.tolist() for x in np.unique(left << 32 | right, return_counts=True)), strict=True))
    for dense in (10, 1000, 10**9):
        monkeypatch.setattr(phrases, "DENSE", dense)
        key, count = phrases.pair_counts(left.astype(np.int64), right.astype(np.int64))
        assert dict(zip(key.tolist(), count.tolist(), strict=True)) == want and len(set(key.tolist())) == len(key)
    assert [len(x) for x in phrases.pair_counts(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def brute_collocations(rows, least, longest, top, absorbed=100):
    counts, total = {}, {}
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for m in range(1, longest + 1):
                for k in range(len(w) - m + 1):
                    key = (lang, tuple(w[k : k + m]))
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score)
    out = []
    for lang in {x for x, _ in found}:
        own = {p: v for (x, p), v in found.items() if x == lang}
        live = [p for p in own if not any(len(o) > len(p) and any(o[k : k + len(p)] == p for k in range(len(o))) and 100 * own[o][0] >= absorbed * own[p][0] for o in own)]
        live.sort(key=lambda p: (-own[p][4], -own[p][0], " ".join(p).encode()))
        out += [(lang, k + 1, " ".join(p), *own[p]) for k, p in enumerate(live[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top", "absorbed", "block"), [(2, 4, 2000, 100, 50), (3, 3, 4, 60, 7)])
def test_collocations_match_brute_force(spark, least, longest, top, absorbed, block):
    rng = random.Random(least)
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(["a", "B", "c", "a b", "d. e", "f\n", "żó", "a,a", "g\th"]) for _ in range(rng.randint(0, 40)))) for _ in range(60)] + [("en", None), (None, "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, least, longest, top, absorbed, block).collect()))
    assert got == brute_collocations(rows, least, longest, top, absorbed)


def test_collocations_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, KIND)
    got = sorted(map(tuple, phrases.collocations(odd, least=2, longest=3, top=100).collect()))
    assert got == brute_collocations([(lang, t) for _, t, lang, *_ in ODD], 2, 3, 100)
    assert phrases.collocations(odd.limit(0), least=2).count() == 0 and phrases.collocations(odd.where(F.col("text").isNull()), least=1).count() == 0


def test_scores_past_64_bits(spark):
    """1000 * a * n and l * r are kept exact where longs overflow."""
    wide = spark.createDataFrame([(9 * 10**15, 9 * 10**16, 9 * 10**15, 9 * 10**15 + 7)], "a long, n long, l long, r long")
    cast = lambda c: F.col(c).cast("decimal(19,0)")
    got = wide.select(((F.col("a") * 1000).cast("decimal(19,0)") * cast("n")).alias("over"), (cast("l") * cast("r")).alias("under")).select(F.expr("over div under")).first()[0]
    assert got == 1000 * 9 * 10**15 * 9 * 10**16 // (9 * 10**15 * (9 * 10**15 + 7))
