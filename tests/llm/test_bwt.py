"""Removal of repeated byte strings against brute force, and on odd inputs."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from conftest import SF

from ripplecast.llm import bwt, queries

KIND = "doc_id long, text string, key string, places long, spans string, n_bytes long"
LONG = " ".join(f"w{k % 977} x{k % 89}" for k in range(20_000))
ODD = [
    (1, None, "a", 0, "b", 0), (2, "", None, None, None, None), (3, "   \n\t ", "a", 1, "c", 1), (4, "ż" * 300, "a", 1, None, 1), (5, "aż" * 300, "a", 1, None, 1), (6, LONG, None, 1, None, 1), (7, LONG + " tail", None, 1, None, 1),
    (8, LONG[5000:7000], None, 1, None, 1), (8, LONG[5000:7000], None, 1, None, 1), (None, "no id " + LONG[100:499], None, 1, None, 1), (None, "no id either " + LONG[99:499], None, 1, None, 1), (-9, "".join(map(chr, range(40, 800))), None, 1, None, 1),
]


def brute(texts, length):
    """(bytes, removed, spans, SHA-256 of the rest) of each text."""
    seen = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(xxhash.xxh3_128_digest(t[p : p + length]), []).append((d, p))
    edges = [np.zeros(len(t) + 1, int) for t in texts]
    for found in seen.values():
        if len(found) > 1:
            for d, p in found:
                edges[d][p] += 1
                edges[d][p + length] -= 1
    out = []
    for t, e in zip(texts, edges, strict=True):
        gone = np.cumsum(e[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    """Texts of shared passages, runs and periods over small and large alphabets, some of them copies."""
    rng = random.Random(seed)
    alphabet = rng.choice([b"ab", b"abcdefgh ", bytes(range(1, 128)), b"a"])
    some = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    pool, texts = [some(rng.randint(100, 1500)) for _ in range(3)], []
    for _ in range(rng.randint(1, 8)):
        t = b""
        while len(t) < rng.randint(0, 4000):
            y = rng.choice(pool)
            a = rng.randint(0, len(y) // 3)
            t += rng.choice([y[a : rng.randint(a, len(y))], y[a : rng.randint(a, len(y))], some(1) * rng.randint(1, 900), some(rng.randint(1, 50)) * rng.randint(1, 30), some(rng.randint(1, 500))])
        texts.append(t)
    return texts + [rng.choice(texts)] * rng.randint(0, 2)


@pytest.mark.parametrize("length", [150, 400])
def test_merged_transforms_match_brute_force(spark, length):
    """Many small corpora as one: each seed's alphabet has its own strings, and shards hold a few texts each."""
    texts = [t for seed in range(25) for t in made(seed + length)]
    df = spark.createDataFrame([(k, t.decode("latin-1")) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in sorted(bwt.remove_repeated_bytes(df, length, shard_bytes=20_000, digest=True).collect())]
    assert got == brute([t.decode("latin-1").encode() for t in texts], length)
    assert sum(n for _, n, _, _ in got) > 10_000


def test_op11_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_suffix_dedup(spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute([(r.text or "").encode() for r in docs], 400), strict=True))


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, KIND)
    got = sorted(map(tuple, bwt.remove_repeated_bytes(odd, digest=True).collect()), key=str)
    want = brute([(t or "").encode() for _, t, *_ in ODD], 400)
    assert got == sorted(((d, *w) for (d, *_), w in zip(ODD, want, strict=True)), key=str)
    plain = {r.doc_id: r for r in bwt.remove_repeated_bytes(odd).collect()}
    assert plain[8].kept == b"" and plain[-9].kept == ODD[-1][1].encode() and plain[1].n_spans == 0
    assert bwt.remove_repeated_bytes(odd.limit(0)).count() == 0
    with pytest.raises(AssertionError):
        bwt.remove_repeated_bytes(odd, length=50)


def test_cuts_depend_on_near_bytes_only():
    rng = random.Random(1)
    middle = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    _, alone = bwt.grams_and_cuts(middle)
    _, inside = bwt.grams_and_cuts(b"x" * 777 + middle + b"yz" * 500)
    assert set((alone + 777).tolist()) <= set(inside.tolist()) and 30 < len(alone) < 100 and np.diff(alone).min() > bwt.REACH
    assert len(bwt.grams_and_cuts(b"a" * 5000)[1]) == 0


def test_counts_follow_strings_not_their_occurrences(spark):
    """A passage in each of 2000 texts costs a row a shard and depth."""
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(1200))
    texts = [passage + bytes(rng.choice(b"abcdefgh ") for _ in range(300)) for _ in range(500)]
    a, b, need = (np.concatenate(x) for x in list(zip(*[bwt.phrases(t, 400) for t in texts], strict=True))[:3])
    sizes = np.array([len(bwt.phrases(t, 400)[0]) for t in texts])
    state = bwt.with_phrases_before(*bwt.transform(a, b, need, np.cumsum(sizes) - sizes))
    for depth in range(1, 8):
        assert len(np.unique(state[3])) == len(state[3])  # a block is one stretch of the transform
        state, _ = bwt.refined(state, state[5].astype(np.int64), depth)
        assert len(state[3]) < 60 + len(texts) * 2
