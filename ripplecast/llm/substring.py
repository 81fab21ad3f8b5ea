"""Removal of repeated word windows: a count-min sketch picks what an exact pass then groups."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidied

ROWS = 2  # of the sketch
GRAM = 10  # words that stand for a window in the sketch
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CHUNK = 1 << 17  # words hashed at once
_AT = (1 << 40) - 1  # low bits that hold a place while the least gram is looked for


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(h: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A hash of the n words from each place on, put together from runs of powers of two."""
    power, size, out, got = h, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - got)
                out = _finish(out[: max(m, 0)] * np.uint64(odd) + power[got : got + max(m, 0)])
            got += size
        if got == n:
            return out
        power = _finish(power[: max(len(power) - size, 0)] * np.uint64(odd) + power[size:]) if len(power) > size else power[:0]
        size *= 2


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams' hashes, and for each window the place of its gram of least hash.

    Windows of equal words choose grams at equal offsets, so a window occurs twice only if
    its chosen gram does, at two places.
    """
    gram = min(GRAM, window)
    g, wide = runs(h, gram, _ODD[0]), window - gram + 1
    least = (g & ~np.uint64(_AT)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while size < wide:
        step = min(size, wide - size)
        least = np.minimum(least[: max(len(least) - step, 0)], least[step:])
        size += step
    return g, (least & np.uint64(_AT)).astype(np.int64)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_finish(hashes + np.uint64(_ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of several texts at once: ids, tags, first places, word hashes, and the places where a window starts."""
    ids, tags, held, total = [], [], [], 0

    def cut() -> tuple:
        sizes = np.array([len(x) for x in held])
        ends = np.cumsum(sizes)
        place = np.arange(total)
        starts = place[place + window <= np.repeat(ends, sizes)]
        return np.array(ids, np.int64), np.array(tags, np.uint32), ends - sizes, np.concatenate(held), starts

    for b in batches:
        for doc, text in zip(b.column(0), b.column(1), strict=True):
            raw = text.as_py() or b""
            words = raw.split()
            if len(words) < window:
                continue
            ids.append(doc.as_py())
            tags.append(xxhash.xxh32_intdigest(raw))
            held.append(word_hashes(words))
            total += len(words)
            if total >= _CHUNK:
                yield cut()
                ids, tags, held, total = [], [], [], 0
    if held:
        yield cut()


def sketch(docs: DataFrame, window: int, bits: int) -> list[bytes]:
    """For each row of a count-min sketch of all windows' grams, a bitmap of the cells counted twice or more.

    A task counts into cells that saturate at two and sends its bitmaps in compressed blocks;
    the blocks of one place are merged in a stream, one at a time. The result has
    ROWS * 2**bits / 8 bytes, whatever the input.
    """
    block = min(1 << 20, 1 << bits)
    blocks = (1 << bits) // block
    schema = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((ROWS, (1 << bits) // 8), np.uint8) for _ in range(2))
        for _, _, _, h, starts in _chunks(batches, window):
            g, at = anchors(h, window)
            used = np.zeros(len(g), bool)
            used[at[starts]] = True
            found = g[used]
            for r in range(ROWS):
                cell = np.sort(cells(found, r, bits))
                new = np.r_[True, cell[1:] != cell[:-1]]
                several = np.diff(np.r_[np.flatnonzero(new), len(cell)]) > 1
                cell = cell[new]
                byte, bit = cell >> 3, np.uint8(1) << (cell & 7).astype(np.uint8)
                again = several | ((once[r][byte] & bit) > 0)
                np.bitwise_or.at(twice[r], byte[again], bit[again])
                np.bitwise_or.at(once[r], byte, bit)
        for r, k in itertools.product(range(ROWS), range(blocks)):
            part = slice(k * block // 8, (k + 1) * block // 8)
            if once[r][part].any():
                yield pa.RecordBatch.from_arrays([pa.array([r * blocks + k], pa.int32()), *(pa.array([zlib.compress(x[r][part].tobytes(), 1)], pa.binary()) for x in (once, twice))], schema=schema)

    merged_schema = pa.schema([("block", pa.int32()), ("twice", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for row in itertools.chain((r for b in batches for r in zip(*(b.column(k) for k in range(3)), strict=True)), [None]):
            k = row[0].as_py() if row else None
            if now is not None and k != now:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], schema=merged_schema)
                once = None
            if row:
                a, t = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in row[1:])
                once, twice = (a, t) if once is None else (once | a, twice | t | (once & a))
            now = k

    parts = docs.mapInArrow(count, "block int, once binary, twice binary")
    merged = parts.repartition(ROWS * blocks, "block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary")
    out = [bytearray((1 << bits) // 8) for _ in range(ROWS)]
    for r in merged.collect():
        at = (r.block % blocks) * block // 8
        out[r.block // blocks][at : at + block // 8] = zlib.decompress(r.twice)
    return [bytes(x) for x in out]


_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<i4")])
_SENT = pa.schema([("bucket", pa.int32()), ("answer", pa.bool_()), ("packed", pa.binary())])
_SENT_KIND = "bucket int, answer boolean, packed binary"


def _first_and_later(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each word sequence, and those of them that start later elsewhere."""
    found = found[np.argsort(found["a"])]
    same = found["a"][1:] == found["a"][:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    alone, some = found[~shared], found[shared]
    some = some[np.lexsort((some["start"], some["tag"], some["doc"], some["b"], some["a"]))]
    first = np.r_[True, (some["a"][1:] != some["a"][:-1]) | (some["b"][1:] != some["b"][:-1])][: len(some)]
    head = some[np.flatnonzero(first)][np.cumsum(first) - 1] if len(some) else some
    later = (some["doc"] != head["doc"]) | (some["tag"] != head["tag"]) | (some["start"] != head["start"])
    return np.concatenate([alone, some[first]]), some[later]


def _by_document(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """found in the order of documents, and where each document begins."""
    found = found[np.lexsort((found["start"], found["tag"], found["doc"]))]
    return found, np.flatnonzero(np.r_[True, (found["doc"][1:] != found["doc"][:-1]) | (found["tag"][1:] != found["tag"][:-1])][: len(found)])


def _pack(found: np.ndarray, columns: tuple[str, ...]) -> bytes:
    """found by document, each document's id once; ``columns`` of its windows."""
    found, at = _by_document(found)
    sizes = np.diff(np.r_[at, len(found)]).astype("<u4")
    head = np.array([len(found), len(at)], "<u4")
    parts = (head, found["doc"][at], found["tag"][at], sizes, *(found[c] for c in columns))
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def _unpack(raw: bytes, columns: tuple[str, ...]) -> np.ndarray:
    n, docs = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    at, got = 8, []
    for kind, size in (("<i8", docs), ("<u4", docs), ("<u4", docs), *((_WINDOW[c], n) for c in columns)):
        got.append(np.frombuffer(raw, kind, size, at))
        at += got[-1].nbytes
    out = np.zeros(n, _WINDOW)
    out["doc"], out["tag"] = np.repeat(got[0], got[2]), np.repeat(got[1], got[2])
    for c, x in zip(columns, got[3:], strict=True):
        out[c] = x
    return out


_KEYS, _STARTS = ("a", "b", "start"), ("start",)


def _dealt(found: np.ndarray, to: np.ndarray, answer: bool, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """found, packed into a row for each value of ``to``."""
    by = np.argsort(to, kind="stable")
    found, to = found[by], to[by]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
    for part, k in zip(np.split(found, cuts[1:]), to[cuts].tolist(), strict=len(found) > 0):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([answer]), pa.array([_pack(part, columns)], pa.binary())], schema=_SENT)


def _owner(doc: np.ndarray, parts: int) -> np.ndarray:
    return ((_finish(doc.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def repeats(docs: DataFrame, window: int, bits: int, buckets: int, parts: int, at_once: int = 1_500_000) -> DataFrame:
    """(doc_id, tag, packed), one row a document: starts, packed as int32, of windows whose words also start earlier.

    Windows that the sketch estimates to occur once are left out. Of the others each task
    sends the first of every word sequence (by a 96-bit hash) to the bucket that owns the
    hash and answers its later ones itself, so a sequence costs one row a task at most,
    however common it is. The bucket then answers all but the first of each. Windows and answers
    travel packed, one row for each bucket or each of ``parts`` shares of the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, window, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = [np.frombuffer(x, np.uint8) for x in shared.value]
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            first, later = _first_and_later(np.concatenate(held))
            held.clear()
            yield from _dealt(later, _owner(later["doc"], parts), True, _STARTS)
            bucket = ((first["a"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            yield from _dealt(first, bucket, False, _KEYS)

        for ids, tags, begins, h, starts in _chunks(batches, window):
            g, at = anchors(h, window)
            used = np.zeros(len(g), bool)
            used[at[starts]] = True
            for r in range(ROWS):
                live = np.flatnonzero(used)
                c = cells(g[live], r, bits)
                used[live] = (twice[r][c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
            starts = starts[used[at[starts]]]
            if len(starts):
                of = np.searchsorted(begins, starts, side="right") - 1
                new = np.empty(len(starts), _WINDOW)
                new["a"], new["b"] = runs(h, window, _ODD[0])[starts], runs(h, window, _ODD[1])[starts] >> np.uint64(32)
                new["doc"], new["tag"], new["start"] = ids[of], tags[of], starts - begins[of]
                held.append(new)
                if sum(map(len, held)) >= at_once:
                    yield from send()
        if held:
            yield from send()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in itertools.chain((r for b in batches for r in zip(*(b.column(k) for k in range(3)), strict=True)), [None]):
            k = row[0].as_py() if row else None
            if k != now and held:
                later = _first_and_later(np.concatenate(held))[1]
                yield from _dealt(later, _owner(later["doc"], parts), True, _STARTS)
                held = []
            now = k
            if row and row[1].as_py():
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], f.type) for x, f in zip(row, _SENT, strict=True)], schema=_SENT)
            elif row:
                held.append(_unpack(row[2].as_py(), _KEYS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in itertools.chain((r for b in batches for r in zip(b.column(0), b.column(2), strict=True)), [None]):
            k = row[0].as_py() if row else None
            if k != now and held:
                found, at = _by_document(np.concatenate(held))
                starts = [x.astype("<i4").tobytes() for x in np.split(found["start"], at[1:])]
                for j in range(0, len(at), 1000):
                    some = at[j : j + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(found["doc"][some]), pa.array(found["tag"][some].astype(np.int64)), pa.array(starts[j : j + 1000], pa.binary())], names=["doc_id", "tag", "packed"])
                held = []
            now = k
            if row:
                held.append(_unpack(row[1].as_py(), _STARTS))

    sent = docs.mapInArrow(tidied(candidates), _SENT_KIND).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    settled = sent.mapInArrow(settle, _SENT_KIND).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return settled.mapInArrow(gather, "doc_id long, tag long, packed binary")


def kept_words(raw: bytes, found: list[tuple[int, bytes]], window: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space) of a text, given its answers."""
    words = raw.split()
    tag = xxhash.xxh32_intdigest(raw) if found else 0
    starts = [np.frombuffer(p, "<i4") for t, p in found if t == tag]
    if not starts:
        return len(words), 0, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate(starts))
    edges[starts] += 1
    np.subtract.at(edges, starts + window, 1)
    stay = np.cumsum(edges[:-1]) == 0
    return len(words), int(len(words) - stay.sum()), b" ".join(itertools.compress(words, stay.tolist()))


def remove_repeats(docs: DataFrame, window: int = 20, max_bits: int = 27, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Drop each word covered by a window of ``window`` words whose sequence also starts earlier.

    Earlier: in a document of smaller id, or before it in the same one. Returns doc_id, n_words,
    n_removed and the kept words, joined by one space, as ``kept`` (with digest: their SHA-256 in
    hex as ``kept_sha256``). Words are runs of anything but ASCII white space.

    The sketch has about two cells a gram, up to 2**max_bits cells in each of its two rows (a task
    holds 2**max_bits / 4 bytes of it when probing). Past that, more windows are estimated repeated and
    go to the exact pass; none is lost.

    Null and empty texts have no words. Rows without id are kept whole and compared with
    nothing. Repeated rows count as one document and are each answered; different texts of one
    id count as documents in the order of a hash of the text. Further columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    known = base.where("doc_id is not null")
    words = (known.agg(F.sum(F.length("text"))).first()[0] or 0) // 6  # enough to size tables by
    bits = min(max_bits, max(16, math.ceil(math.log2(max(words, 1) / 6)) + 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(parts, words // 3_000_000)  # each of a bounded number of windows, and so of their answers
    found = materialise(repeats(known, window, bits, shares, shares), "substring-starts")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "packed")).alias("found"))
    kind = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                got = [kept_words(t.as_py(), [(x["tag"], x["packed"]) for x in f.as_py() or ()], window) for t, f in zip(part.column(1), part.column(2), strict=True)]
                last = [hashlib.sha256(x).hexdigest() if digest else x.decode() for _, _, x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _, _ in got], pa.int64()), pa.array([x for _, x, _ in got], pa.int64()), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    alone = base.where("doc_id is null").withColumn("found", F.lit(None).cast("array<struct<tag:long,packed:binary>>"))
    joined = known.join(found, "doc_id", "left").select("doc_id", "text", "found")
    return joined.unionByName(alone).mapInArrow(tidied(answer), kind)
