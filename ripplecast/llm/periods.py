"""Periodic runs of words: seeds on diagonals of a document against itself, extended once each."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, tidied
from .substring import _ODD, _finish, runs

_CHUNK = 1 << 17  # words looked at together
RUN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("length", "<i8"), ("period", "<i8")])


def overlap(level: int, min_length: int, min_repeats: int) -> int:
    """Words that every run with a period of 2**level or more shares with itself at the lag of its period.

    Such a run of period q has at least max(min_length, min_repeats * q) words, so q fewer agree with those q on.
    """
    q = max(1 << level, min_length // min_repeats)  # what is shared falls up to here, then grows
    return min(max((min_repeats - 1) * p, min_length - p) for p in (q, q + 1))


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Number of places from the start at which x and y agree, looked at in blocks that double."""
    n, got, step = min(len(x), len(y)), 0, 32
    while got < n:
        other = np.flatnonzero(x[got : min(got + step, n)] != y[got : min(got + step, n)])
        if len(other):
            return got + int(other[0])
        got, step = got + step, step * 2
    return n


def find_runs(x: np.ndarray, sizes: np.ndarray, min_length: int = 6, min_repeats: int = 4) -> np.ndarray:
    """Runs (doc, start, length, period) in several documents at once, by doc, start and period.

    x: the words' numbers, document after document, ``sizes`` of them each.

    Periods are searched by levels that double. A run of a level repeats each of its k-grams, k = overlap(level),
    after exactly its period and not before: k is no less than the period, and a word that is no power of a shorter
    one meets itself in its own repetition at multiples of its length only. So the pairs of neighbouring occurrences
    of a k-gram in a document, at most one a place, hold a seed of each run. Seeds are extended along
    their diagonal; a table of the furthest covered place a lag leaves out those of a stretch seen before. A gram that
    occurs once in its document has no longer gram that occurs twice, so places drop out from level to level.
    """
    assert min_repeats >= 3, "neighbouring occurrences need a run of three periods"
    ends = np.cumsum(sizes)
    begin, end, doc = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), np.repeat(np.arange(len(sizes)), sizes)
    h = _finish(x.astype(np.uint64) + np.uint64(1))
    salt = _finish(doc.astype(np.uint64) + np.uint64(_ODD[1]))
    found, level, at = [], 0, np.arange(len(x))
    while len(at) and min_repeats << level <= sizes.max(initial=0):
        k = overlap(level, min_length, min_repeats)
        at = at[at + k <= end[at]]
        key = runs(h, k, _ODD[0])[at] + salt[at]
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        several = np.sort(by[np.r_[False, same] | np.r_[same, False]]) if len(by) else by
        at, key = at[several], key[several]
        by = np.argsort(key, kind="stable")
        one, two = at[by[:-1]], at[by[1:]]
        lag = two - one
        seed = (key[by[1:]] == key[by[:-1]]) & (doc[one] == doc[two]) & (lag >> level == 1)
        one, lag = one[seed], lag[seed]
        by = np.lexsort((one, lag))
        one, lag = one[by], lag[by]
        new = np.r_[True, (lag[1:] != lag[:-1]) | (one[1:] != one[:-1] + 1)][: len(one)]
        covered: dict[int, int] = {}
        for p, q in zip(one[new].tolist(), lag[new].tolist(), strict=True):
            if p < covered.get(q, 0):
                continue
            low, high = int(begin[p]), int(end[p])
            after = p + _agree(x[p : high - q], x[p + q : high])
            before = p - _agree(x[low:p][::-1], x[low + q : p + q][::-1])
            covered[q] = after
            if after - before + q >= max(min_length, min_repeats * q):
                found.append((int(doc[p]), before - low, after - before + q, q))
        level += 1
    return np.sort(np.array(found, RUN), order=["doc", "start", "period"])


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Places not in any run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found["start"] + found["period"], 1)
    np.subtract.at(edges, found["start"] + found["length"], 1)
    return np.cumsum(edges[:-1]) == 0


def collapse_runs(docs: DataFrame, min_length: int = 6, min_repeats: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's periodic runs of words, and its text with every run cut to its first period.

    A run is a stretch of consecutive words of smallest period q and at least max(min_length, min_repeats * q) words
    that no neighbouring word extends. Words are runs of anything but ASCII white space. Returns doc_id, n_runs;
    start, length, period and exponent_milli of the longest run (ties: smallest start, then period; no run: nulls);
    ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the kept words
    joined by one space (with digest: their SHA-256 in hex, of a line a run for ``runs_sha256``, and ``collapsed_sha256``).

    Null and empty texts have no words and no run. Rows without id and repeated rows are each answered; a document is looked
    at alone, so they change no other. Further columns are not read. An empty table gives no rows. Nothing is shuffled; a task
    holds some 2**17 words, or one longer text.
    """
    last = [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digest else [("runs", pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names[1:]]))), ("collapsed", pa.string())]
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + last)
    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, " + (
        "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )

    def answers(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number = defaultdict(itertools.count().__next__)
        x = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64)
        found = find_runs(x, np.array([len(w) for w in texts], np.int64), min_length, min_repeats)
        cuts = np.searchsorted(found["doc"], np.arange(len(texts) + 1))
        out = {f.name: [] for f in schema}
        for k, (doc, words) in enumerate(zip(ids, texts, strict=True)):
            own = found[cuts[k] : cuts[k + 1]]
            spans = own[list(RUN.names[1:])].tolist()
            first = min(spans, key=lambda r: (-r[1], r[0], r[2])) if spans else None
            kept = b" ".join(itertools.compress(words, _kept(len(words), own).tolist()) if spans else words)
            row = (doc, len(spans), *(first or (None, None, None)), 1000 * first[1] // first[2] if first else None)
            if digest:
                row += (hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in spans).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
            else:
                row += ([dict(zip(RUN.names[1:], r, strict=True)) for r in spans], kept.decode())
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return batch(schema, **out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc)
                texts.append((text.as_py() or b"").split())
                total += len(texts[-1]) + 1
                if total >= _CHUNK:
                    yield answers(ids, texts)
                    ids, texts, total = [], [], 0
        if ids:
            yield answers(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(answer), kind)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a run planted in every document whose id has a CRC-32 divisible by ten.

    With g the tenth part of that CRC and n words, words from a = g % n on repeat the p = 1 + (n - a) // (3 + g % 8) words there. Such texts
    come back as words joined by one space, all others unchanged.
    """

    def planted(doc: int | None, text: bytes | None) -> bytes | None:
        h = zlib.crc32(str(doc).encode())
        words = (text or b"").split() if doc is not None and h % 10 == 0 else []
        if not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([planted(d, t.as_py()) for d, t in zip(ids, part.column(1), strict=True)], pa.binary())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(plant), "doc_id long, text binary")
