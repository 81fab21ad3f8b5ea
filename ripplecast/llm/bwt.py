"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Texts are cut where the hash of eight bytes is least among its neighbours, so equal strings are cut alike but near their
ends. A shard sorts the suffixes of its sequences of phrases; merging refines the interleave of all shards one phrase
at a time, and tells of each suffix and depth at how many places its phrases stand. Bytes are compared, by hash, only at the ends of what is common.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard
from .common import batch, materialise, tidied
from .substring import _ODD, _finish

GRAM = 8  # bytes that decide on a cut
REACH = 32  # neighbours on each side among which a cut's hash is least
_TABLE = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary())])
_KIND = "shard long, bucket int, packed binary"
STATE, DOCS = -1, -2  # in place of a bucket; counts of depth d have DOCS - d


def _powers(base: int, n: int) -> np.ndarray:
    """base**k modulo 2**64 for k below n."""
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


class Powers:
    """Powers of an odd number modulo 2**64 from two short tables."""

    def __init__(self, base: int):
        self.low, self.step, self.high = _powers(base, 1 << 16), pow(base, 1 << 16, 1 << 64), np.ones(1, np.uint64)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        most = int(k.max(initial=0)) >> 16
        if not most:
            return self.low[k]
        if most >= len(self.high):
            self.high = _powers(self.step, 2 * most + 2)
        return self.low[k & 0xFFFF] * self.high[k >> 16]


_LANES = [(Powers(x), Powers(pow(x, -1, 1 << 64))) for x in _ODD]


class Sums:
    """Hashes of any stretch of a text's grams: differences of sums of grams times powers of an odd number."""

    def __init__(self, grams: np.ndarray):
        place = np.arange(len(grams))
        self.sums = [np.r_[np.uint64(0), np.cumsum(grams * up[place])] for up, _ in _LANES]

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for each stretch."""
        length = (end - start).astype(np.uint64)
        a, b = (_finish((s[end] - s[start]) * down[start] + length) for s, (_, down) in zip(self.sums, _LANES, strict=True))
        return a, (b >> np.uint64(32)).astype(np.uint32)


def grams_and_cuts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A one-to-one hash of the eight bytes from each place on, and the places, ascending, at which phrases begin.

    A cut's hash is less than the REACH before and no more than the REACH after it. What lies REACH before to
    REACH + GRAM bytes after a place decides, so cuts that near to an end of the text are left out.
    """
    n = len(raw) - GRAM + 1
    grams = _finish(np.ndarray((max(n, 0),), "<u8", raw, 0, (1,)).astype(np.uint64))
    if n <= 2 * REACH:
        return grams, np.zeros(0, np.int64)
    top = (grams >> np.uint64(32)).astype(np.uint32)
    least, size = top, 1
    while size < REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    own = top[REACH : n - REACH]
    return grams, np.flatnonzero((own < least[: len(own)]) & (own <= least[REACH + 1 : REACH + 1 + len(own)])) + REACH


def phrases(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of a text of at least ``length`` bytes: its phrases' hashes (64 and 32 bits), for each the number of phrases from it on
    that cover all windows which start inside it, and whether a window has less than two cuts.

    Phrases at the ends of a text equal only such phrases. Each is hashed with the GRAM - 1 bytes after it.
    """
    grams, cuts = grams_and_cuts(raw)
    edges = np.r_[0, cuts, len(grams)]
    a, b = Sums(grams).of(edges[:-1], edges[1:])
    a[0], a[-1] = _finish(a[:1] + np.uint64(_ODD[0]))[0], _finish(a[-1:] + np.uint64(_ODD[1]))[0]
    last = np.minimum(np.r_[cuts, len(raw)] - 1, len(raw) - length)
    need = 1 + np.searchsorted(cuts, last + length - GRAM + 1) - np.arange(len(a))
    count = np.cumsum(np.bincount(cuts, minlength=len(raw)), dtype=np.int32)
    first = np.arange(len(raw) - length + 1)
    bare = bool((count[first + length - REACH - GRAM] - count[first + REACH - 1] < 2).any())
    return a, b, need.astype(np.uint8), bare


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return np.array([len(raw), *map(len, arrays)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, kinds: str) -> list[np.ndarray]:
    own = kinds.split()
    size, *lengths = np.frombuffer(packed, "<i8", len(own) + 1).tolist()
    raw, at, out = pa.decompress(packed[8 * len(own) + 8 :], size, "zstd", asbytes=True), 0, []
    for kind, n in zip(own, lengths, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _row(shard: int, bucket: int, packed: bytes) -> pa.RecordBatch:
    return batch(_TABLE, shard=[shard], bucket=[bucket], packed=[packed])


def _buckets(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _questions(shard: int, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The shard's strings, each once with the number of its places, to the buckets that own their hashes."""
    to = _buckets(a, buckets)
    by = np.argsort(to, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
        if len(part):
            yield _row(shard, int(to[part[0]]), _pack(a[part], b[part], sizes[part].astype("<i8")))


def _answered(a: np.ndarray, replies: dict[int, bytes], buckets: int) -> np.ndarray:
    """For each string that was asked about: the number of its places in all shards."""
    out, to = np.zeros(len(a), np.int64), _buckets(a, buckets)
    by = np.argsort(to, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
        if len(part):
            out[part] = _unpack(replies[int(to[part[0]])], "<i8")[0]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows, in order, by their ``key`` column."""
    rows = (tuple(x.as_py() for x in r) for b in batches for r in zip(*b.columns, strict=True))
    for k, group in itertools.groupby(rows, lambda r: r[key]):
        yield k, group


def exchanged(table: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Each shard's state, then a row a bucket it asked with the number of places of each of its strings.

    A string costs one question a shard, however often it occurs there.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches, 1):
            shard, asked = [], []
            for s, _, packed in rows:
                shard.append(s)
                asked.append(_unpack(packed, "<u8 <u4 <i8"))
            a, b, sizes = (np.concatenate(x) for x in zip(*asked, strict=True))
            by = np.lexsort((b, a))
            at = np.flatnonzero(np.r_[True, (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])])
            total = np.empty(len(a), "<i8")
            total[by] = np.repeat(np.add.reduceat(sizes[by], at), np.diff(np.r_[at, len(a)]))
            for s, part in zip(shard, np.split(total, np.cumsum([len(x) for x, _, _ in asked])[:-1]), strict=True):
                yield _row(s, bucket, _pack(part))

    replies = table.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(settle), _KIND)
    return table.where(f"bucket = {STATE}").unionByName(replies).repartition(shards, "shard").sortWithinPartitions("shard", "bucket")


_FIRST, _SHARD = "<i4 <u8 <u4 <i4 <u1 <i4", "<i4 <u8 <u4 <u8 <u4 <i4 <u1"


def transform(a: np.ndarray, b: np.ndarray, need: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """A shard's Burrows-Wheeler transform, ready to be merged, at depth one.

    In the order of suffixes: the suffix and the hash of the phrase before it (zero: none). By block of suffixes that
    begin alike: the hash of the phrase and the number of suffixes. By suffix: the depth it is needed to. first: where texts begin.
    Phrases before suffixes follow from the blocks, so ``with_phrases_before`` adds them when the state has travelled. Suffixes are sorted, by doubling, as far as any is needed.
    """
    n, end = len(a), np.repeat(np.r_[first[1:], len(a)], np.diff(np.r_[first, len(a)]))
    rank, size = np.unique(a ^ b.astype(np.uint64) * np.uint64(_ODD[1]), return_inverse=True)[1], 1
    while size < need.max(initial=0):
        after = np.arange(n) + size
        then = np.where(after < end, rank[np.minimum(after, n - 1)] + 1, 0)
        rank, size = np.unique(rank * (n + 1) + then, return_inverse=True)[1], size * 2
    suffix = np.argsort(rank, kind="stable").astype(np.int32)
    return [suffix, *_blocks(a[suffix], b[suffix]), need, first.astype(np.int32)]


def with_phrases_before(suffix: np.ndarray, block_a: np.ndarray, block_b: np.ndarray, sizes: np.ndarray, need: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    own_a, own_b = np.empty(len(need), np.uint64), np.empty(len(need), np.uint32)
    own_a[suffix], own_b[suffix] = np.repeat(block_a, sizes), np.repeat(block_b, sizes)
    starts = np.zeros(len(need), bool)
    starts[first] = True
    starts = starts[suffix]
    return [suffix, np.where(starts, np.uint64(0), own_a[suffix - 1]), np.where(starts, np.uint32(0), own_b[suffix - 1]), block_a, block_b, sizes, need]


def _blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of equal hashes: the hash of each and its size."""
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return a[at], b[at], np.diff(np.r_[at, len(a)]).astype(np.int32)


def refined(state: list[np.ndarray], places: np.ndarray, depth: int) -> tuple[list[np.ndarray], bytes]:
    """A shard's part of the interleave at depth + 1, from that at depth and the number of places of each of its blocks;
    and, packed, which suffixes are in blocks of several places, and of how many.

    A suffix of a block found nowhere else has its common prefix settled and leaves. Of the others, each steps to the suffix
    one phrase before it: with that phrase, its block is one of depth + 1. These keep the order of the shard's transform.
    """
    suffix, before_a, before_b, block_a, block_b, sizes, need = state
    block = np.repeat(np.arange(len(sizes)), sizes)
    live = places[block] > 1
    suffix, before_a, before_b, block = suffix[live], before_a[live], before_b[live], block[live]
    count = np.zeros(len(need), np.int64)
    count[suffix] = places[block]
    place = np.full(len(need) + 1, -1, np.int64)
    place[suffix] = np.arange(len(suffix))
    to = np.where((before_a != 0) & (need[suffix - 1] > depth), place[suffix - 1], -1)
    of = np.flatnonzero(to >= 0)
    of = of[np.argsort(to[of])]
    to = to[of]
    a = _finish(block_a[block[of]] * np.uint64(_ODD[0]) + before_a[of])
    b = (_finish((block_b[block[of]].astype(np.uint64) << np.uint64(32) | before_b[of].astype(np.uint64)) + np.uint64(_ODD[1])) >> np.uint64(32)).astype(np.uint32)
    return [suffix[to], before_a[to], before_b[to], *_blocks(a, b), need], _pack(np.packbits(count > 0), count[count > 0])


def merged(docs: DataFrame, length: int, shard_bytes: int, buckets: int) -> DataFrame:
    """(key, places) of the texts (key, text) with a phrase that stands at several places, or a window of less than two cuts:
    for each depth, and for each phrase, at how many places it stands with the depth - 1 next (0: one, or no window needs it)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = itertools.count(TaskContext.get().partitionId() << 32)
        keys, held, total = [], [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            shard = next(name)
            a, b, need = (np.concatenate([x[k] for x in held]) for k in range(3))
            sizes = np.array([len(x[0]) for x in held], "<i4")
            state = transform(a, b, need, np.cumsum(sizes) - sizes)
            yield _row(shard, DOCS, _pack(np.frombuffer(b"".join(keys), np.uint8), sizes, np.array([x[3] for x in held], bool)))
            yield _row(shard, STATE, _pack(*state))
            yield from _questions(shard, *state[1:4], buckets)

        for rows in batches:
            for key, text in zip(*rows.columns, strict=True):
                raw = text.as_py()
                if len(raw) >= length:
                    keys.append(key.as_py())
                    held.append(phrases(raw, length))
                    total += len(raw)
                    if total >= shard_bytes:
                        yield from cut()
                        keys, held, total = [], [], 0
        if held:
            yield from cut()

    def step(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, rows in _grouped(batches, 0):
                packed = next(rows)[2]
                state = _unpack(packed, _SHARD) if depth > 1 else with_phrases_before(*_unpack(packed, _FIRST))
                state, counts = refined(state, _answered(state[3], {k: x for _, k, x in rows}, buckets), depth)
                yield _row(shard, DOCS - depth, counts)
                yield _row(shard, STATE, _pack(*state))
                yield from _questions(shard, *state[3:6], buckets)

        return run

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            packed = {k: x for _, k, x in rows}
            keys, sizes, bare = _unpack(packed.pop(DOCS), "<u1 <i4 ?")
            places = np.zeros((len(packed), int(sizes.sum())), "<i8")
            for k, x in packed.items():
                live, count = _unpack(x, "<u1 <i8")
                places[DOCS - k - 1, np.flatnonzero(np.unpackbits(live, count=places.shape[1]))] = count
            for k, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
                own = places[:, end - n : end]
                own = own[own.any(axis=1)]
                if bare[k] or len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[16 * k : 16 * k + 16].tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["key", "places"])

    table = materialise(docs.mapInArrow(tidied(build), _KIND), "bwt-shards")
    about, shards = table.where(f"bucket = {DOCS}"), max(table.where(f"bucket = {STATE}").count(), 1)
    depth, now = 1, table
    while not now.where("bucket >= 0").isEmpty():
        grown = exchanged(now, buckets, shards).mapInArrow(tidied(step(depth)), _KIND).unionByName(now.where(f"bucket < {DOCS}"))
        now = materialise(grown, f"bwt-depth-{depth + 1}", replaces=now if depth > 1 else None)
        depth += 1
    every = about.unionByName(now.where(f"bucket < {DOCS}")).repartition(shards, "shard").sortWithinPartitions("shard")
    found = every.mapInArrow(tidied(results), "key binary, places binary").groupBy("key").agg(F.first("places").alias("places"))
    found = materialise(found, "bwt-places", replaces=table)
    discard(now)
    return found


def decided(raw: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a text stand elsewhere too, by the counts of ``merged``; which need a comparison of bytes; and the text's grams.

    A window does if all phrases that it touches stand at several places. It may if those between its first and last certain
    cut do, or if it has less than two. If these stand at as many places as all that it touches, they never
    stand with others, and no window with them needs a comparison.
    """
    grams, cuts = grams_and_cuts(raw)
    n = len(raw) - length + 1
    count = np.cumsum(np.bincount(cuts, minlength=len(raw)), dtype=np.int32)  # cuts up to a place
    places = np.pad(places.reshape(-1, len(cuts) + 1), ((0, 1), (0, 1)))

    def at(depth: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        return places[np.minimum(depth, len(places)) - 1, np.minimum(phrase, places.shape[1] - 1)]

    first = count[REACH - 1 : REACH - 1 + n]
    inner = count[length - REACH - GRAM : length - REACH - GRAM + n] - first - 1
    all_, some = at(1 + count[length - GRAM : length - GRAM + n] - count[:n], count[:n]), at(np.maximum(inner, 1), first + 1)
    return all_ > 0, (inner < 1) | (some > 0) & (some != all_), grams


def repeated_spans(docs: DataFrame, length: int, shard_bytes: int, buckets: int, at_once: int = 1_000_000) -> DataFrame:
    """(key, spans) of the texts (key, text) that have a window of ``length`` bytes which starts at another place too: the bytes covered."""
    found = merged(docs, length, shard_bytes, buckets)
    held_texts = docs.join(found, "key").select("key", "text", "places")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = itertools.count(TaskContext.get().partitionId() << 32)
        keys, sure, may, hashes, total = [], [], [], [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            shard = next(name)
            a, b = (np.concatenate(x) for x in zip(*hashes, strict=True))
            by = np.lexsort((b, a))
            one_a, one_b, sizes = _blocks(a[by], b[by])
            of = np.empty(len(a), "<i4")
            of[by] = np.repeat(np.arange(len(sizes)), sizes)
            lengths = [np.array([len(x) for x in y], "<i4") for y in (sure, may)]
            yield _row(shard, STATE, _pack(np.frombuffer(b"".join(keys), np.uint8), *lengths, np.concatenate(sure), np.concatenate(may), of))
            yield from _questions(shard, one_a, one_b, sizes, buckets)

        for rows in batches:
            for key, text, places in zip(*rows.columns, strict=True):
                raw = text.as_py()
                yes, unsure, grams = decided(raw, np.frombuffer(places.as_py(), "<i8"), length)
                at = np.flatnonzero(unsure)
                if len(at) or yes.any():
                    keys.append(key.as_py())
                    sure.append(_stretches(np.flatnonzero(yes)))
                    may.append(at.astype("<i4"))
                    hashes.append(Sums(grams).of(at, at + length - GRAM + 1) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
                    total += len(at) + 100
                    if total >= at_once:
                        yield from cut()
                        keys, sure, may, hashes, total = [], [], [], [], 0
        if keys:
            yield from cut()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            keys, n_sure, n_may, sure, may, of = _unpack(next(rows)[2], "<u1 <i4 <i4 <i4 <i4 <i4")
            # strings were asked about in the order of their hashes, which is that of buckets
            places = np.concatenate([np.zeros(0, np.int64), *(_unpack(x, "<i8")[0] for _, _, x in rows)])
            hit = places[of] > 1
            names, spans = [], []
            for k, (s, at, yes) in enumerate(zip(*(np.split(x, np.cumsum(n)[:-1]) for x, n in ((sure, n_sure), (may, n_may), (hit, n_may))), strict=True)):
                more = _stretches(at[yes])
                starts = np.r_[s.reshape(-1, 2), more.reshape(-1, 2)]
                starts = starts[np.argsort(starts[:, 0])]
                if len(starts):
                    names.append(keys[16 * k : 16 * k + 16].tobytes())
                    spans.append(_covered(starts, length).tobytes())
            for k in range(0, len(names), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 1000], pa.binary()), pa.array(spans[k : k + 1000], pa.binary())], names=["key", "spans"])

    table = materialise(held_texts.mapInArrow(tidied(ask), _KIND), "bwt-windows", replaces=found)
    shards = max(table.where(f"bucket = {STATE}").count(), 1)
    spans = exchanged(table, buckets, shards).mapInArrow(tidied(resolve), "key binary, spans binary")
    return materialise(spans.groupBy("key").agg(F.first("spans").alias("spans")), "bwt-spans", replaces=table)


def _stretches(starts: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and last of each stretch without gaps, by turns."""
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + 1][: len(starts)])
    return np.c_[starts[new], starts[np.r_[new[1:], len(starts)] - 1]].astype("<i4").ravel() if len(starts) else np.zeros(0, "<i4")


def _covered(stretches: np.ndarray, length: int) -> np.ndarray:
    """Rows (first, last start), ascending, as the bytes their windows cover: starts and ends of maximal spans by turns."""
    end = np.maximum.accumulate(stretches[:, 1]) + length
    new = np.flatnonzero(np.r_[True, stretches[1:, 0] > end[:-1]])
    return np.c_[stretches[new, 0], end[np.r_[new[1:], len(stretches)] - 1]].astype("<i4").ravel()


def remove_repeated_bytes(docs: DataFrame, length: int = 400, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Drop each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another.

    Texts are UTF-8 bytes; strings are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and what
    is left, as binary ``kept`` (with digest: its SHA-256 in hex as ``kept_sha256``).

    Phrases and strings are compared by 96 bits of hash. A window needs at most about length / REACH rounds of the merge; in each, a shard
    sends one row of hashes to each bucket, a string once. Null and empty texts have no bytes. Every row is a text of its own: of
    repeated rows each is the other's copy, with or without id. Further columns are not read. An empty table gives no rows.
    """
    assert length >= 3 * (REACH + GRAM), "windows must hold cuts"
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    named = base.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5("text")))))
    whole = base.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // (32 << 20))
    spans = repeated_spans(named.where(F.length("text") >= length).select("key", "text"), length, shard_bytes, buckets)
    last = "kept_sha256" if digest else "kept"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                out = []
                for text, found in zip(part.column(1), part.column(2), strict=True):
                    raw, gone = text.as_py(), np.frombuffer(found.as_py() or b"", "<i4")
                    edges = [0, *gone.tolist(), len(raw)]
                    kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(gone) // 2, hashlib.sha256(kept).hexdigest() if digest else kept))
                columns = [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    joined = named.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidied(answer), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")
