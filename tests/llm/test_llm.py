"""Corpus operators against brute force, round trips and odd inputs."""

import collections
import datetime
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from oracle import differing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ripplecast.llm import decontam, linededup, pieces, quality, queries, sharding, simhash, substring, tokenfiles, topk, warc

KIND = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, found string, key string"
LONG = " ".join(f"w{k % 977} x{k % 89}" for k in range(20_000))
ODD = [
    (1, None, "en", "s", 0, "a", "b", "c"), (2, "", None, None, None, None, None, None), (3, "   \n\t ", "en", "s", 1, None, None, None), (4, "One two\nthree", "en", "s", 1, None, None, None),
    (4, "One two\nthree", "en", "s", 1, None, None, None), (5, "one TWO three", "de", "s", 1, None, None, None), (6, LONG, "en", "s", 1, None, None, None), (7, LONG + " tail", "en", "t", 1, None, None, None),
    (None, "no id here at all", "en", "s", 1, None, None, None), (8, "ŻÓŁĆ ▁ naïve 😀\r\nline", "pl", "s", 1, None, None, None), (-9, "one two three", "en", "s", 1, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    assert differing(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == 0


# 1


def brute_fingerprint(t, width):
    w = spaced(fold(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + width]).encode(), 42) for k in range(max(len(w) - width, 0) + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(items, radius):
    """items: (id, fingerprint); the smallest id reachable."""
    own = dict.fromkeys((i for i, _ in items))
    parent = {i: i for i in own}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(items, 2):
        if (x ^ y).bit_count() <= radius and top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in own}


def test_simhash_matches_brute_force(docs, odd):
    for frame in (docs, odd):
        rows = frame.collect()
        want = brute_classes([(r.doc_id, brute_fingerprint(r.text, 3)) for r in rows if r.doc_id is not None], 3)
        got = simhash.near_duplicates(frame).collect()
        assert len(got) == len(rows)
        texts = collections.defaultdict(set)
        for r in rows:
            texts[r.doc_id].add(f"{brute_fingerprint(r.text, 3):016x}")
        for r in got:
            assert r.fingerprint in texts[r.doc_id]
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id])


def test_simhash_links_and_splits_large_buckets(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centres for _ in range(12)]
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, k) for k, f in enumerate(fps)], "fp long, node long")
    for radius, block in ((3, 8192), (3, 5), (6, 64)):
        chosen = simhash.plan(frame, radius)
        assert sum(chosen.thresholds) == radius - len(chosen.groups) + 1 and sorted(b for g in chosen.groups for b in g) == list(range(64))
        found = {r.node: r.root for r in simhash.components(simhash.links(frame, chosen, radius, block)).collect()}
        want = brute_classes(list(enumerate(fps)), radius)
        assert all(found.get(k, k) == v for k, v in want.items())


def shingle_set(t, width=5):
    w = spaced(fold(t))
    return {" ".join(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_are_found_and_verified(spark, docs, odd):
    """Planted pairs of J 0.7 to 1 among the documents: the classes are those of all pairs at 0.8, by band of similarity."""
    rng = np.random.default_rng(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    planted = []
    for k in range(400):
        words = [f"p{k}x{n}" for n in range(int(rng.integers(80, 400)))]
        other = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.002, 0.036))), replace=False):
            other[at] = f"q{k}"
        planted.append((10_000 + 2 * k, " ".join(words), " ".join(other)))
    rows += [(i + n, t) for i, *pair in planted for n, t in enumerate(pair)]
    # a chain of which only near members are alike
    chain = [f"c{n}" for n in range(200)]
    rows += [(30_000 + k, " ".join(chain[10 * k : 10 * k + 150])) for k in range(6)]
    rows += [(i, t) for i, t, *_ in ODD if i is not None and i not in {r[0] for r in rows}]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [i for i, *_ in planted if low <= jaccard(sets[i], sets[i + 1]) < high]
        assert len(band) >= 20 and all(got[i + 1] == i for i in band), low
    below = [i for i, *_ in planted if jaccard(sets[i], sets[i + 1]) < 0.8]
    assert len(below) >= 20 and all(got[i + 1] == i + 1 for i in below)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and jaccard(x, y) >= 0.8 and top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in sets}


def test_buckets_give_pairs_or_stars_and_the_rest_of_stars():
    """Every near pair of a bucket is a candidate, or its ends lie in one star of which pairs of different labels come back."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, (30, simhash.CHECK), dtype=np.uint64)
    check = base[np.arange(600) % 30] ^ (np.uint64(1) << rng.integers(0, 64, (600, simhash.CHECK), dtype=np.uint64))
    key = np.sort(rng.integers(1, 40, 600))
    node, n = rng.permutation(600), rng.integers(90, 130, 600)
    limit = simhash.limit_of(0.8, simhash.CHECK)
    near = lambda i, j: int(np.bitwise_count(check[i] ^ check[j]).sum()) <= limit and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
    want = {(min(node[i], node[j]), max(node[i], node[j])) for i, j in itertools.combinations(range(600), 2) if key[i] == key[j] and near(i, j)}
    bucket, u, v = simhash.bucket_candidates(key, node, n, check, 0.8)
    assert not bucket.any() and set(zip(u, v)) == want
    bucket, u, v = simhash.bucket_candidates(key, node, n, check, 0.8, wide=10, dense=0)
    star = {m: (b, a) for b, a, z in zip(bucket, u, v) for m in (a, z) if b}
    key_of = dict(zip(node, key))
    for a, z in want:
        assert key_of[a] == key_of[z] and star[a][0] == star[z][0] == key_of[a]
    label = node // 3
    wide = np.repeat(check, 2, axis=1)[:, : simhash._WORDS]
    got = {p for x, y in simhash.cross_label_pairs(node, label, n, wide, 2 * limit, 0.8) for p in zip(x, y)}
    all_near = {(min(node[i], node[j]), max(node[i], node[j])) for i, j in itertools.combinations(range(600), 2) if near(i, j) and label[i] != label[j]}
    biggest = collections.Counter(label.tolist()).most_common(1)[0][1]
    assert biggest == 3 and got == all_near


def test_long_fingerprints_differ_as_expected():
    rng = np.random.default_rng(4)
    share = []
    for size in (40, 100, 127, 128, 500, 5000):
        common = rng.integers(0, 2**64, size * 8 // 9 * 9 // 9, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**64, size // 9, dtype=np.uint64)]) for _ in range(2))
        x, y = simhash.long_fingerprint(a), simhash.long_fingerprint(b)
        votes = [int(np.bitwise_count(simhash.long_fingerprint(np.array([h]))).sum()) for h in a[:3]]
        assert all(300 < v < 700 for v in votes)
        share.append(np.bitwise_count(x ^ y).sum() / (64 * simhash._WORDS) - simhash.differing_share(len(common) / (len(common) + 2 * (size // 9))))
    assert max(map(abs, share)) < 0.05
    one = rng.integers(0, 2**64, 131, dtype=np.uint64)
    x = np.stack([np.unpackbits(simhash.long_fingerprint(one[[k]]).view(np.uint8), bitorder="little") for k in range(131)])
    assert (np.unpackbits(simhash.long_fingerprint(one).view(np.uint8), bitorder="little") == (2 * x.sum(axis=0) > 131)).all()


def test_near_copies_in_blocks(spark):
    """Tiny blocks and a group of many near copies give the same classes."""
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(900):
        words = list(base) if k < 700 else [f"u{k}x{n}" for n in range(60)]
        words[int(rng.integers(0, len(words)))] = f"z{k}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8192, 50):
        got = {r.doc_id: r.component_id for r in simhash.similar_texts(frame, block_rows=block).collect()}
        assert all(got[k] == (0 if k < 700 else k) for k in got) and len(got) == 900


def test_cover_reaches_what_is_needed():
    chosen, cost = simhash.cover([[0, 5, 20], [0, 1, 4]], [[0, 1, 3], [0, 1, 3]], 2.0)
    assert (chosen, cost) == ((-1, 1), 4)


def test_allocation_prefers_cheap_groups():
    assert simhash.allocate([[0, 100, 1000], [0, 1, 2], [0, 1, 50]], 0)[0] == (-1, 1, 0)


# 2


def test_pieces_round_trip_and_repeat(docs, odd):
    for frame in (docs, odd):
        a = pieces.encode(frame)
        assert a.where("not lossless").count() == 0
        both = pieces.decode(a).join(frame.select("doc_id", "text"), "doc_id")
        assert both.where("decoded != coalesce(text, '') and n_pieces >= 0").join(frame.groupBy("doc_id").count().where("count = 1"), "doc_id", "left_semi").count() == 0
        again = pieces.encode(frame.repartition(3))
        assert a.exceptAll(again).count() == 0 and again.exceptAll(a).count() == 0
    other = pieces.encode(docs, seed=1)
    assert pieces.encode(docs).join(other.withColumnRenamed("pieces", "p2"), "doc_id").where("pieces != p2").count() > 100


def test_piece_sampling_follows_the_lattice():
    lattices = pieces.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    known = lattices.pieces.known

    def all_of(c):
        return [((), 0.0)] if not c else [((known[c[:j]][0], *rest), w - math.log(known[c[:j]][1] + 2)) for j in range(1, len(c) + 1) if c[:j] in known for rest, w in all_of(c[j:])]

    paths = all_of(b" there")
    total = sum(math.exp(w) for _, w in paths)
    drawn = collections.Counter(tuple(x.tolist()) for x in lattices.encode([b"there"] * 40_000, [k * 7919 for k in range(40_000)]))
    assert all(abs(drawn[p] / 40_000 - math.exp(w) / total) < 0.015 for p, w in paths)


def plain_pieces(known, text, seed):
    """One text's pieces by plain loops: forward weights of each chunk, then draws from its end backwards."""
    out, step, step0, whole = [], 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, (1 << 64) - 1
    longest = max(map(len, known[0]))
    for place, chunk in enumerate(re.findall(rb" +[^ \n]*|\n|[^ \n]+", b" " + text) if text else []):
        edges, start = [[] for _ in range(len(chunk) + 1)], 0
        while start < len(chunk):
            wide = 1 + sum(chunk[start] >= b for b in (0xC0, 0xE0, 0xF0))
            hits = [(start + n, *known[0][chunk[start : start + n]]) for n in range(1, longest + 1) if start + n <= len(chunk) and chunk[start : start + n] in known[0]]
            for end, i, rank in hits:
                edges[end].append((start, i, -math.log(rank + 2.0)))
            if not any(end == start + wide for end, *_ in hits):
                for k in range(start, start + wide):
                    edges[k + 1].append((k, known[1][chunk[k]], -math.log(len(known[0]) + 2.0)))
            start += wide
        total, cumulated = [0.0] * (len(chunk) + 1), [[]] * (len(chunk) + 1)
        for end in range(1, len(chunk) + 1):
            if not edges[end]:
                continue
            own = sorted(edges[end])
            value = [total[s] + w for s, _, w in own]
            top = max(value)
            odds = [math.exp(v - top) for v in value]
            total[end] = top + math.log(sum(odds))
            ranked = sorted(range(len(own)), key=lambda k: -odds[k])
            upto = list(itertools.accumulate(odds[k] / sum(odds) for k in ranked))
            cumulated[end] = [(math.floor(min(1.0 if n == len(ranked) - 1 else upto[n], 1) * 2**28) / 2**28, own[k]) for n, k in enumerate(ranked)]
        state, at, ids = (seed + place * step0) & whole, len(chunk), []
        while at:
            state = (state + step) & whole
            u = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 & whole
            u = (u ^ (u >> 27)) * 0x94D049BB133111EB & whole
            draw = ((u ^ (u >> 31)) >> 36) / 2**28
            at, i, _ = next(e for c, e in cumulated[at] if c > draw)
            ids.append(i)
        out += ids[::-1]
    return out


def test_op2_matches_plain_loops(spark, odd):
    """The registered query, with its larger cache and slices, and a long text without a space."""
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known = (v.known, v.of_byte.tolist())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_pieces, r.ids_crc32, r.lossless) for r in queries.op2_sentencepiece(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs[:60]:
        ids = plain_pieces(known, (r.text or "").encode(), xxhash.xxh64_intdigest(str(r.doc_id).encode(), 0))
        assert got[r.doc_id] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    blob = "".join("abcdefghijklmnopqrstuvwxyzżä😀"[k * k % 29] for k in range(30_000))
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(77, blob)], "doc_id long, text string"))
    rows = frame.collect()
    for shape in ({}, {"cache_nodes": 10, "at_once": 1}):
        found = collections.Counter((r.doc_id, tuple(r.pieces)) for r in pieces.encode(frame, **shape).collect())
        want = [(r.doc_id, tuple(plain_pieces(known, (r.text or "").encode(), xxhash.xxh64_intdigest(str(r.doc_id).encode(), 0)))) for r in rows]
        assert found == collections.Counter(want)


# 3


def test_decontamination_matches_brute_force(spark, docs, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "one TWO"), (901, "w5"), (902, ""), (903, None), (904, " ".join(f"w{k % 977} x{k % 89}" for k in range(500, 530))), (None, "three"), (900, "line")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 10, 0) + 1 if w and i is not None else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = sorted({len(w) for w in windows})
    for frame, bits, small in ((docs, 27, 100_000), (docs, 10, 0), (odd, 27, 100_000)):
        want = collections.Counter()
        for r in frame.collect():
            w, hit, got = split(r.text), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        got |= windows[tuple(w[k : k + n])]
                        hit.update(range(k, k + n))
            want[(r.doc_id, len(w), len(hit), ",".join(sorted(got)), bool(hit))] += 1
        rows = decontam.contamination(frame, bench, ["doc_id"], max_bits=bits, small=small).select("doc_id", "found.*").collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(sorted(r["items"])), r.contaminated) for r in rows) == want


def test_decontamination_keeps_columns(spark, odd, none):
    bench = spark.createDataFrame([(1, "no id here at all")], "item_id long, text string")
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert decontam.drop_contaminated(none, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench.where("false")).count() == len(ODD)
    assert decontam.drop_contaminated(odd, bench, small=0).count() == len(ODD) - 1
    own = decontam.contamination(odd, bench, ["found", "key", "n_hit", "text"])
    assert own.columns == ["found", "key", "n_hit", "text", "found_"] and own.where("found_.contaminated").count() == 1


# 4


def test_line_templates(spark):
    boiler = [(k, f"Posted by user{k} on 2024-01-{k:02d}\nunique prose {'abcdefgh'[k]} of its own kind\n42 17") for k in range(1, 6)]
    near = [(10 + k, f"alpha beta gamma delta epsilon zeta eta theta iota {w}") for k, w in enumerate(("one", "two", "three", "four"))]
    rare = [(20, "only in two"), (21, "only in two"), (22, None), (23, "")]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(spark.createDataFrame(boiler + near + rare, "doc_id long, text string")).collect()}
    assert got[1] == boiler[0][1] and got[2] == "unique prose c of its own kind"
    assert got[10] == near[0][1] and [got[k] for k in (11, 12, 13)] == ["", "", ""]
    assert (got[20], got[21], got[22], got[23]) == ("only in two", "only in two", None, "")


def test_a_leaf_holds_several_templates(spark):
    """Two templates in one leaf, the second smaller, and an even mix of two: each keeps its first line alone."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    rows = [(k, f"read more about {word(k)} in the daily news of our town") for k in range(9)]
    rows += [(20 + k, f"read more about {word(k)} at a shop which sells old maps") for k in range(5)]
    rows += [(40 + 2 * k + n, f"this page was {word(k)} {rest}") for k in range(4) for n, rest in enumerate(("b d f h j l n", "c e g i k m o"))]
    # neighbours alone agree: a chain is one template
    rows += [(60 + k, " ".join(["to be continued", *("new" if n < k else "old" for n in range(7))])) for k in range(8)]
    rows += [(80, "read more about nothing that any other line here would say"), (81, "read more about two pages"), (82, "read more about six ships")]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {i for i, t in got.items() if t}
    assert kept & set(range(20)) == {0} and kept & set(range(20, 40)) == {20}
    assert kept & set(range(40, 60)) == {40, 41} and {80, 81, 82} <= kept


def test_line_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    bases = [[str(x) for x in rng.integers(0, 4, 12)] for _ in range(30)]
    lines = sorted({tuple(str(rng.integers(0, 9)) if rng.random() < 0.1 else x for x in b) for b in bases for _ in range(12)})
    parent = list(range(len(lines)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        if sum(x == y for x, y in zip(lines[a], lines[b])) >= 0.8 * 12 and top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    frame = spark.createDataFrame([(1, k, list(t)) for k, t in enumerate(lines)], "leaf long, exact long, tokens array<string>")
    for small in (32, 2):
        got = {r.node: r.root for r in linededup.others(frame, 0.8, small).collect()}
        assert len(set(map(top, parent))) > 5 and [got.get(k, k) for k in range(len(lines))] == [top(k) for k in range(len(lines))]


def test_unlike_lines_of_a_leaf_are_not_paired(spark, monkeypatch):
    """Lines that share their leading tokens and a few common words: pairs compared grow with the lines, not with their square."""
    counted, linked = [], linededup._linked

    def counting(lines, pairs, similarity):
        counted.append(pairs.count())
        return linked(lines, pairs, similarity)

    monkeypatch.setattr(linededup, "_linked", counting)

    def pairs(n):
        rng, common = np.random.default_rng(n), "a in of the to".split()
        tail = [[common[w % 5] if w % 3 == 0 else f"v{w}" for w in row] for row in rng.integers(0, 3000, (n, 7)).tolist()]
        frame = spark.createDataFrame([(1, k, ["one", "of", "the", *t]) for k, t in enumerate(tail)], "leaf long, exact long, tokens array<string>")
        counted.clear()
        linededup.others(frame, 0.8).count()
        return sum(counted)

    few, many = pairs(1500), pairs(15000)
    assert many < 20 * few and many < 40 * 15000


def test_op4_knows_several_templates(spark, tmp_path):
    """The registered query and its twin on leaves with a second and third template in three documents."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    rows = [(k, f"read more about {word(k)} in the daily news of our town\nown line {word(k)}") for k in range(9)]
    rows += [(20 + k, f"read more about {word(k)} at a shop which sells old maps") for k in range(5)]
    rows += [(30 + k, f"x\nread more about {word(k)} or write to the people who made it") for k in range(3)]
    rows += [(60 + k, " ".join(["to be continued", *("new" if n < k else "old" for n in range(7))])) for k in range(8)] + [(90, None), (91, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_line_dedup(spark, str(tmp_path))
    assert {r.doc_id for r in got.where("text_sha256 = sha2('', 256)").collect()} >= set(range(21, 25))
    path = tmp_path / "one"
    path.mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(path / "documents.parquet")
    for t in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        (path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    assert differing(queries.op4_line_dedup(spark, str(path)), queries.OP4_SQL, str(path)) == 0


def test_line_dedup_is_native_and_takes_odd_rows(odd, none):
    out = linededup.drop_recurring_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and linededup.drop_recurring_lines(none).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


# 5


def brute_removed(rows, n):
    seen, out = set(), []
    for r in sorted(set(rows), key=lambda x: (x[0], xxhash.xxh32_intdigest((x[1] or "").encode()))):
        w = spaced(r[1])
        gone = set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in seen:
                gone.update(range(k, k + n))
            seen.add(tuple(w[k : k + n]))
        out.append((r, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return {r: rest for r, *rest in out}


def test_substring_matches_brute_force(docs, odd, spark, none):
    extra = spark.createDataFrame([(5000 + k, "a a a a a a b " * 9) for k in range(4)] + [(3, "x y z " * 30)], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text").unionByName(extra), odd.select("doc_id", "text")):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        want = brute_removed([r for r in rows if r[0] is not None], 20)
        expected = collections.Counter((r[0], *(want[r] if r[0] is not None else (len(spaced(r[1])), 0, " ".join(spaced(r[1]))))) for r in rows)
        for bits in (27, 16):
            got = substring.remove_repeats(frame, max_bits=bits).collect()
            assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == expected
    assert substring.remove_repeats(none).count() == 0


def test_sketch_never_misses():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for window in (1, 5, 10, 20):
        g, at = substring.anchors(h, window)
        windows = collections.defaultdict(list)
        for k in range(len(h) - window + 1):
            windows[h[k : k + window].tobytes()].append(k)
        for same in windows.values():
            assert len({int(at[k]) - k for k in same}) == 1 and len({int(g[at[k]]) for k in same}) == 1


# 6


def test_revisits(spark):
    kind = "record_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, payload string, extra int"
    row = lambda i, url, s, k, st, h, p=None: (i, url, None if s is None else __import__("datetime").datetime(2024, 1, 1, 0, 0, s), k, st, h, p, 1)
    rows = [
        row(1, "http://www.A.com/x/?b=2&a=1&utm_s=1#f", 1, "response", 200, {"etag": '"1"', "content-type": "text/html", "content-length": "9"}, "old"),
        row(2, "https://a.com:443/x?a=1&b=2", 5, "response", 200, {"etag": 'W/"2"', "content-type": "text/html", "x": "y"}, "new"),
        row(3, "https://a.com/x?a=1&b=2", 3, "revisit", 304, {"etag": '"1"', "content-length": "0", "date": "d"}),
        row(4, "https://a.com/x?a=1&b=2", 6, "revisit", 304, {"etag": '"2"', "x": "z"}), row(5, "https://a.com/x?a=1&b=2", 7, "revisit", 304, {"etag": '"1"'}),
        row(6, "https://a.com/x?a=1&b=2", 8, "revisit", 304, {}), row(7, "https://a.com/x?a=1&b=2", 1, "revisit", 304, {"etag": '"1"'}), row(8, None, 9, "revisit", 304, None),
        row(9, "https://a.com/x?a=1&b=2", None, "revisit", 304, None), row(10, "https://a.com/x?a=1&b=2", 6, "response", 404, {"etag": '"9"'}, "gone"),
    ]
    for bins in (1, 4096):
        got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, kind), bins=bins).collect()}
        assert {k: (r.outcome, r.matched_id, r.payload) for k, r in got.items()} == {
            3: ("resolved", 1, "old"), 4: ("resolved", 2, "new"), 5: ("mismatch", 2, None), 6: ("unconfirmed", 2, None), 7: ("missing", None, None), 8: ("missing", None, None), 9: ("missing", None, None)}
        assert got[3].headers == {"etag": '"1"', "content-type": "text/html", "content-length": "9", "date": "d"} and got[4].headers["x"] == "z"
    assert warc.resolve_revisits(spark.createDataFrame([], kind)).count() == 0


# 7


def test_quality_learns_and_holds_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, x).select("doc_id", F.round("score", 6).alias("s")) for x in (labels, flipped))
    assert a.exceptAll(b).count() == 0  # held-out labels change nothing
    got = quality.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and quality.score(none, labels).count() == 0
    kept = quality.drop_rejected(odd, labels.where("false"))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


# 8


def test_top_k_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(1000 + k, [0.25] * 64) for k in range(60)] + [(2000, None), (2001, [None] * 64), (2002, [float("nan")] * 64), (2020, [0.5] * 10), (None, [0.1] * 64), (rows[0][0], rows[0][1]), (2040, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = [math.floor(64 * float(np.float32(x))) for x in v]
    ids = sorted(own)
    x = np.array([own[i] + [0] * (64 - len(own[i])) for i in ids])
    want = []
    for q, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[q]
            want += [(i, n, ids[j], int(s[j])) for n, j in enumerate([j for j in np.lexsort((ids, -s)) if j != q][:20], 1)]
    for block in (4096, 16):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, block_rows=block).collect())
        assert got == sorted(want)
    for first in (1, 1000):
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, block_rows=16, first=first).collect()) == sorted(want)
    assert topk.top_k(frame.where("vec_id = 2000")).count() == 0
    assert topk.top_k(frame.where("vec_id = 1000 or vec_id = 1001")).count() == 1


def test_top_k_of_large_components(spark):
    """Components saturate at 2**62, scores at the ends of a long; sums in between are exact."""
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=3) * 10.0 ** rng.integers(0, 12)).tolist()) for k in range(120)] + [(k, [3e30 * (-1) ** k, 1.0, -3e30]) for k in range(120, 160)]
    clip = lambda x, m: max(-m, min(m, x))
    own = {i: [math.floor(clip(64 * x, 2.0**62)) for x in v] for i, v in rows}
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, block_rows=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 160, 20))
    for q, found in got.items():
        score = {i: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(own[q], v)))) for i, v in own.items() if i != q}
        assert found == [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]], q


# 9


def test_token_files(spark, docs, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = spark.createDataFrame([(9000, "A<|endoftext|>b <|startoftext|>"), (9001, "don't they're IT'S a'b"), (9002, "x." * 50 + " (a) [b] İ ß Å é"), (9003, "\x1c\x85\xa0 　a")], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text").unionByName(extra), odd.select("doc_id", "text")):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()) for r in frame.collect()))
        start, want = 0, []
        for some, i, t in rows:
            ids = [*tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1]
            want.append((i if some else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = tokenfiles.with_checksums(tokenfiles.token_files(frame)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokenfiles.token_files(none).count() == 0


def test_token_files_read_by_range(spark, docs, tmp_path):
    path = f"{tmp_path}/tokens"
    tokenfiles.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), options=tokenfiles.DELTA)
    part = tokenfiles.read_tokens(spark, path, 50, 60)
    assert sorted(r.doc_id for r in part.collect()) == list(range(50, 60))
    assert "tokens" not in tokenfiles.read_tokens(spark, path, tokens=False).columns
    assert "GreaterThanOrEqual(doc_id,50)" in part._jdf.queryExecution().toString()


# 10


def test_shards(spark, docs, odd, none):
    groups = docs.unionByName(spark.createDataFrame([(5000 + k, "the same text again " * 20, "en", "s", 1) for k in range(300)], docs.schema))
    rows = sharding.shard(groups, shards=7).collect()
    total, by = sum(r.size for r in rows), collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(7)) and len(rows) == groups.count()
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    assert max(abs(sum(r.size for r in own) - total / 7) for own in by.values()) < 0.06 * total / 7 + max(r.size for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id in texts)
    same = collections.defaultdict(set)
    for r in rows:
        if r.doc_id < 5000:
            same[texts[r.doc_id]].add(r.shard)
    assert max(map(len, same.values())) == 1  # small groups stay together
    assert sharding.shard(odd, target_bytes=100_000).count() == len(ODD) and sharding.shard(none, shards=3).count() == 0


def brute_shards(points, n):
    """points: (id, places, weight); the k-d split by exact weighted medians."""
    out = {}

    def split(own, n, first):
        if n == 1 or not own:
            out.update((i, first) for i, *_ in own)
            return
        dims = range(len(own[0][1]))
        wide = max(dims, key=lambda d: (max(p[1][d] for p in own) - min(p[1][d] for p in own), -d))
        weight = collections.Counter()
        for _, place, w in own:
            weight[place[wide]] += w
        goal, run, cut = sum(weight.values()) * (n // 2) / n, 0, max(weight) + 1
        for x in sorted(weight):
            if run + weight[x] > goal:
                cut = x + (1 if goal - run > weight[x] / 2 else 0)
                break
            run += weight[x]
        split([p for p in own if p[1][wide] < cut], n // 2, first)
        split([p for p in own if p[1][wide] >= cut], n - n // 2, first + n // 2)

    split(points, n, 0)
    return out


def test_kd_cuts_match_brute_force(spark):
    rng = np.random.default_rng(6)
    points = [(k, tuple(int(x) for x in rng.integers(0, 2 ** int(rng.integers(4, 40)), 3)), int(rng.integers(1, 50))) for k in range(400)]
    points += [(400 + k, (7, 7, 7), 3) for k in range(60)]  # of one place
    frame = spark.createDataFrame([(i, *place, w) for i, place, w in points], "id long, a long, b long, c long, weight long")
    for n in (1, 2, 7, 40):
        got = {r.id: r.shard for r in sharding.split_points(frame, ["a", "b", "c"], n, tolerance=0.0).collect()}
        assert got == brute_shards(points, n)


def test_shards_of_odd_rows(odd):
    rows = sharding.shard(odd, shards=2).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert len({(r.shard, r.slot) for r in rows}) == len(ODD)


def test_clashing_responses_of_one_id(spark):
    """Of responses of one id the latest is carried on; a revisit without id or match keeps its own headers."""
    kind = "record_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, payload string"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, "http://a/x", at(1), "response", 200, {"etag": "1"}, "old"), (1, "http://a/x", at(2), "response", 200, {"etag": "2"}, "new"), (2, "http://a/x", at(3), "revisit", 304, {"etag": "2"}, None)]
    rows += [(None, "http://a/x", at(4), "revisit", 304, {"etag": "9"}, None), (3, "http://a/none", at(5), "revisit", 304, None, None), (4, None, at(5), "revisit", 304, {}, None)]
    got = sorted((r.record_id or 0, r.outcome, r.payload, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, "missing", None, {"etag": "9"}), (2, "resolved", "new", {"etag": "2"}), (3, "missing", None, None), (4, "missing", None, {})]


# The registered queries


def test_op1_query(spark, docs):
    rows = docs.collect()
    want = brute_classes([(r.doc_id, brute_fingerprint(r.text, 3)) for r in rows], 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == {r.doc_id: (f"{brute_fingerprint(r.text, 3):016x}", want[r.doc_id]) for r in rows}


def test_op3_query(spark, docs):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r.item_id))
    want = {}
    for r in docs.collect():
        w, hit, items = split(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    items |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        want[r.doc_id] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.QUERIES["op3_decontamination"](spark, SF).collect()}
    assert got == want and any(x[4] for x in want.values())


def test_op5_query(spark, docs):
    want = brute_removed([(r.doc_id, r.text) for r in docs.collect()], 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op5_substring_dedup"](spark, SF).collect()}
    assert got == {r[0]: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in want.items()}


def test_op8_query(spark):
    own = {r.vec_id: np.floor(np.array(r.embedding, float) * 64).astype(int) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = set()
    for q in own:
        if q % 20 == 0:
            score = {i: int(own[q] @ v) for i, v in own.items() if i != q}
            want |= {(q, n, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:20], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.QUERIES["op8_top_k"](spark, SF).collect()} == want


def test_op9_query(spark, docs):
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.add((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op9_token_files"](spark, SF).collect()} == want


def test_op10_query(spark, docs):
    rows = queries.QUERIES["op10_kd_shards"](spark, SF).collect()
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw[r.doc_id]) + 16, zlib.crc32(raw[r.doc_id]), "bytes", None) and 0 <= r.shard < 40
        by[r.shard].append(r.slot)
    assert len(rows) == len(raw) and all(sorted(x) == list(range(len(x))) for x in by.values())


# The pipeline


def test_pipeline_stages(spark, odd, docs):
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, frame, SF), f"test{k}")
        if k < 4:
            assert out.columns == docs.columns
            assert out.select("doc_id").exceptAll(frame.select("doc_id")).count() == 0
        else:
            assert out.count() == frame.count() and out.where("not lossless").count() == 0
        frame = out
    plain = spark.createDataFrame([(k, f"{'abcdefghij'[k]}lpha beta {k} gamma of number {k * k} and some more") for k in range(10)], "doc_id long, text string")
    plain = plain.unionByName(plain.where("doc_id = 3").withColumn("doc_id", F.lit(99).cast("long")))
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, plain, SF).collect()) == list(range(10))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, SF).columns == odd.columns, name
    assert corpus_pipeline.sentencepiece(spark, odd, SF).count() == len(ODD)


def test_pipeline_rows_match_plain_python(spark, docs):
    """Each stage on all that the one before kept: rejected scores, one of each class of near copies, no window of an item."""
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.score for r in queries.op7_quality(spark, SF).collect()}
    good = corpus_pipeline.materialise(stages["quality_classifier"](spark, docs, SF), "test-good")
    assert {r.doc_id for r in good.select("doc_id").collect()} == {i for i, s in scores.items() if s >= 0.3}
    lines = corpus_pipeline.materialise(stages["line_dedup"](spark, good, SF), "test-lines")
    assert lines.count() == good.count()
    texts = {r.doc_id: r.text for r in lines.collect()}
    sets = {i: set(simhash.shingles((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    one = corpus_pipeline.materialise(stages["simhash_near_dedup"](spark, lines, SF), "test-one")
    kept = [r.doc_id for r in one.select("doc_id").collect()]
    assert len(near) > 3 and sorted(map(top, kept)) == sorted(set(map(top, sets)))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(len(w) - 10, 0) + 1) if w}
    sizes = {len(w) for w in windows}
    clean = {i for i in kept for w in [split(texts[i])] if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    got = {r.doc_id for r in stages["benchmark_decontamination"](spark, one, SF).select("doc_id").collect()}
    assert got == clean and clean < set(kept)
