"""Phrase collocations: pairs of ranked numbers counted in tiles, frequent pairs ranked again as the next level's words."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import numbered
from .common import batch, materialise, tidied
from .substring import _finish

#: Fixed: bytes that end a piece become full stops, A-Z become lower case.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(ord(".") if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
TILE = 1024  # numbers a side
DENSE = TILE * TILE // 16  # pairs from which a tile of a block is counted in a dense array


def pair_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, as left << 32 | right, and how often each occurs.

    Numbers are ranks by frequency, so common pairs crowd into few tiles of TILE x TILE cells. Tiles with DENSE pairs
    are counted by addressing their cells, the pairs of all others by sorting.
    """
    across = np.int64(max(int(right.max(initial=0)) // TILE + 1, 1))
    tile = left // TILE * across + right // TILE
    names, of, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    keys, counts = [], []
    for t in np.flatnonzero(sizes >= DENSE):
        inside = of == t
        cells = np.bincount(left[inside] % TILE * TILE + right[inside] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(cells)
        keys.append((names[t] // across * TILE + at // TILE) << 32 | (names[t] % across * TILE + at % TILE))
        counts.append(cells[at])
    sparse = sizes[of] < DENSE
    key, count = np.unique(left[sparse] << 32 | right[sparse], return_counts=True)
    return np.concatenate([*keys, key]), np.concatenate([*counts, count])


_ROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("bucket", pa.int32()), ("packed", pa.binary())])
_KIND = "block long, lang string, bucket int, packed binary"
STATE, KNOWN = -1, -2  # in place of a bucket


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32 or 64 bit numbers, compressed."""
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


def _row(block: int | None, lang: str, bucket: int, packed: bytes) -> pa.RecordBatch:
    return batch(_ROW, block=[block], lang=[lang], bucket=[bucket], packed=[packed])


def _parts(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value, ascending."""
    by = np.argsort(of, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
        if len(part):
            yield int(of[part[0]]), part


def _grouped(batches: Iterator[pa.RecordBatch], *key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (tuple(x.as_py() for x in r) for b in batches for r in zip(*b.columns, strict=True))
    for k, group in itertools.groupby(rows, lambda r: tuple(r[j] for j in key)):
        yield k, list(group)


def blocks(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Of each block of about ``size`` words of one language: a row with its words as numbers of its own, 0 between pieces, and to each
    bucket a row with the words it owns, their numbers and counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        total = defaultdict(int)
        next_block = itertools.count(TaskContext.get().partitionId() << 32)

        def emptied(lang: str) -> Iterator[pa.RecordBatch]:
            block, tokens, words = next(next_block), np.concatenate(held.pop(lang)), list(number.pop(lang))
            del total[lang]
            counts = np.bincount(tokens, minlength=len(words))
            yield _row(block, lang, STATE, _pack(tokens))
            to = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words[1:]), np.int64, len(words) - 1)
            for k, part in _parts(to):
                yield _row(block, lang, k, _pack((part + 1).astype("<i4"), counts[part + 1].astype("<i8"), np.frombuffer(b" ".join([words[j + 1] for j in part.tolist()]), np.uint8)))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or b"").translate(_FOLD).replace(b".", b" . ").split()
                if not words:
                    continue
                if lang not in number:
                    number[lang] = defaultdict(itertools.count().__next__)
                    number[lang][b"."]  # 0
                held[lang] += [np.fromiter(map(number[lang].__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
                total[lang] += len(words) + 1
                if total[lang] >= size:
                    yield from emptied(lang)
                if sum(total.values()) >= 2 * size:
                    yield from emptied(max(total, key=total.__getitem__))
        for lang in list(held):
            yield from emptied(lang)

    return docs.mapInArrow(tidied(cut), _KIND)


def _ids(counts: np.ndarray, order: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers of a bucket's keys: their rank by frequency (ties: order) among its own, dealt in turn with the other buckets'. So numbers are unique,
    and rise as frequencies fall."""
    by = np.lexsort((order, -counts))
    ids = np.empty(len(by), np.int64)
    ids[by] = np.arange(len(by)) * buckets + bucket
    return ids


def settled_words(asked: DataFrame, least: int, buckets: int) -> DataFrame:
    """The buckets' answers: to each block the numbers of its words that occur ``least`` times in all blocks; those words with
    their counts and numbers; and the count of all words, as a word of number -1."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, lang), rows in _grouped(batches, 2, 1):
            total: dict[bytes, int] = defaultdict(int)
            for _, _, _, packed in rows:
                _, counts, words = _unpack(packed, "<i4 <i8 u1")
                for w, c in zip(words.tobytes().split(b" "), counts.tolist(), strict=True):
                    total[w] += c
            known = sorted(w for w, c in total.items() if c >= least)
            f = np.array([total[w] for w in known], np.int64)
            number = dict(zip(known, _ids(f, np.arange(len(f)), bucket, buckets).tolist(), strict=True))
            yield _row(None, lang, KNOWN, _pack(np.r_[f, sum(total.values())], np.r_[np.array(list(number.values()), np.int64), -1], np.frombuffer(b" ".join([*known, b"."]), np.uint8)))
            for block, _, _, packed in rows:
                local, _, words = _unpack(packed, "<i4 <i8 u1")
                ids = np.fromiter((number.get(w, -1) for w in words.tobytes().split(b" ")), np.int32, len(local))
                yield _row(block, lang, bucket, _pack(local[ids >= 0], ids[ids >= 0]))

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(tidied(settle), _KIND)


def settled_pairs(asked: DataFrame, least: int, buckets: int) -> DataFrame:
    """As ``settled_words``, for pairs."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, lang), rows in _grouped(batches, 2, 1):
            parts = [_unpack(packed, "<i8 <i4") for _, _, _, packed in rows]
            keys = [np.cumsum(k) for k, _ in parts]
            key, of = np.unique(np.concatenate(keys), return_inverse=True)
            f = np.zeros(len(key), np.int64)
            np.add.at(f, of, np.concatenate([c for _, c in parts]))
            key, f = key[f >= least], f[f >= least]
            ids = _ids(f, key, bucket, buckets)
            if len(key):
                yield _row(None, lang, KNOWN, _pack(f, ids, key))
                for (block, *_), own in zip(rows, keys, strict=True):
                    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                    hit = key[at] == own
                    yield _row(block, lang, bucket, _pack(np.diff(own[hit], prepend=0), ids[at[hit]].astype("<i4")))

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(tidied(settle), _KIND)


def _known(settled: DataFrame, words: bool) -> DataFrame:
    """(lang, key, f, id) of the frequent words or pairs that buckets found."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.string() if words else pa.int64()), ("f", pa.int64()), ("id", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f, ids, key = _unpack(packed.as_py(), "<i8 <i8 u1" if words else "<i8 <i8 <i8")
                key = key.tobytes().decode().split(" ") if words else key
                for k in range(0, len(f), 20_000):
                    n = len(f[k : k + 20_000])
                    yield batch(schema, lang=[lang] * n, key=key[k : k + n], f=f[k : k + n], id=ids[k : k + n])

    return settled.where(f"bucket = {KNOWN}").select("lang", "packed").mapInArrow(tidied(rows), f"lang string, key {'string' if words else 'long'}, f long, id long")


def _answered(states: DataFrame, settled: DataFrame, parts: int) -> DataFrame:
    """Each block's row, then the answers to it."""
    both = states.unionByName(settled.where("bucket >= 0"))
    return both.repartition(parts, "block").sortWithinPartitions("block", "bucket")


def encoded(cut: DataFrame, settled: DataFrame, parts: int) -> DataFrame:
    """Blocks with the numbers of their frequent words, -1 for rare words and between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in _grouped(batches, 0):
            (own,) = _unpack(rows[0][3], "<i4")
            rank = np.full(int(own.max()) + 1, -1, np.int32)
            for _, _, _, packed in rows[1:]:
                local, ids = _unpack(packed, "<i4 <i4")
                rank[local] = ids
            words = rank[own]
            live, keep = _kept(words >= 0, 0)
            words = np.where(live, words, -1)[keep].astype("<i4")
            yield _row(block, rows[0][1], STATE, _pack(words, words[:0]))

    return _answered(cut.where(f"bucket = {STATE}"), settled, parts).mapInArrow(tidied(run), _KIND)


def _kept(live: np.ndarray, also: int) -> tuple[np.ndarray, np.ndarray]:
    """Live places and up to ``also`` places after each; and the same with one more after each stretch, which keeps stretches apart."""
    for _ in range(also):
        live = live | np.r_[False, live][:-1]
    return live, live | np.r_[False, live][:-1]


def _level(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's words, and the grams that start at them; grams of one word are the words."""
    words, grams = _unpack(packed, "<i4 <i4")
    return words, grams if len(grams) else words


def _pairs(words: np.ndarray, grams: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of grams of ``length`` words that may be extended by a word, those grams and those words.

    The gram at the next place must be frequent too: no phrase is more frequent than a part of it.
    """
    n = max(len(words) - length, 0)
    at = np.flatnonzero((grams[:n] >= 0) & (grams[1 : n + 1] >= 0) & (words[length : length + n] >= 0))
    return at, grams[at].astype(np.int64), words[at + length].astype(np.int64)


def _cells(lang: str, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    key = (left << 32 | right).astype(np.uint64) + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return (_finish(key) >> np.uint64(64 - bits)).astype(np.int64)


def common_cells(level: DataFrame, length: int, least: int, bits: int) -> bytes:
    """A bitmap of the cells, of 2**bits that pairs are hashed to, that get at least ``least`` pairs.

    A pair in another cell cannot be frequent. Tasks count up to ``least`` a cell and send what they have in segments, which are summed
    one at a time; the result has 2**bits / 8 bytes.
    """
    segment = min(1 << 18, 1 << bits)
    kind = np.uint8 if least <= 255 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, kind)
        for b in batches:
            for lang, packed in zip(b.column(1).to_pylist(), b.column(3), strict=True):
                _, left, right = _pairs(*_level(packed.as_py()), length)
                own = np.sort(_cells(lang, left, right, bits))
                at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
                cells[own[at]] = np.minimum(cells[own[at]] + np.diff(np.r_[at, len(own)]), least)
        for k in range(len(cells) // segment):
            part = cells[k * segment : (k + 1) * segment]
            if part.any():
                yield _row(None, "", k, pa.compress(part.tobytes(), "zstd", asbytes=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(2).to_pylist(), b.column(3), strict=True))
        for k, group in itertools.groupby(rows, lambda r: r[0]):
            total = np.zeros(segment, np.int64)
            for _, packed in group:
                total += np.frombuffer(pa.decompress(packed.as_py(), segment * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)
            yield _row(None, "", k, np.packbits(total >= least).tobytes())

    sums = level.mapInArrow(tidied(count), _KIND).repartition((1 << bits) // segment, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(add), _KIND)
    out = bytearray((1 << bits) // 8)
    for r in sums.collect():
        at = r.bucket * segment // 8
        out[at : at + segment // 8] = r.packed
    return bytes(out)


def asked_pairs(level: DataFrame, length: int, bits: int, cells: bytes, buckets: int) -> DataFrame:
    """To each bucket a row with the block's pairs (gram of ``length`` words, next word) that it owns, and their counts."""
    shared = level.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for k in range(b.num_rows):
                block, lang, _, packed = (c[k].as_py() for c in b.columns)
                _, left, right = _pairs(*_level(packed), length)
                cell = _cells(lang, left, right, bits)
                may = (bitmap[cell >> 3] << (cell & 7).astype(np.uint8)) & 128 > 0
                key, count = pair_counts(left[may], right[may])
                by = np.argsort(key)
                key, count = key[by], count[by]
                for j, part in _parts((_finish(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
                    yield _row(block, lang, j, _pack(np.diff(key[part], prepend=0), count[part].astype("<i4")))

    return level.mapInArrow(tidied(run), _KIND)


def extended(level: DataFrame, settled: DataFrame, length: int, parts: int) -> DataFrame:
    """Blocks with the grams of one word more; places that belong to none of them drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in _grouped(batches, 0):
            if len(rows) == 1:
                continue  # no pair of the block is frequent
            words, grams = _level(rows[0][3])
            at, left, right = _pairs(words, grams, length)
            found = [_unpack(r[3], "<i8 <i4") for r in rows[1:]]
            key, number = np.concatenate([np.cumsum(k) for k, _ in found]), np.concatenate([n for _, n in found])
            by = np.argsort(key)
            key, number, pair = key[by], number[by], left << 32 | right
            longer = np.full(len(words), -1, "<i4")
            if len(key):
                place = np.minimum(np.searchsorted(key, pair), len(key) - 1)
                hit = key[place] == pair
                longer[at[hit]] = number[place[hit]]
            live, keep = _kept(longer >= 0, length)
            if keep.any():
                yield _row(block, rows[0][1], STATE, _pack(np.where(live, words, -1)[keep].astype("<i4"), longer[keep]))

    return _answered(level, settled, parts).mapInArrow(tidied(run), _KIND)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, block: int = 1_000_000, max_bits: int = 27, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of up to ``longest`` words that occur at least ``least`` times in pieces, and
    (lang, n), the words of each language.

    Level 1 ranks the frequent words by frequency; level m + 1 counts pairs of a phrase of m words and the word after it, block by block in
    tiles, sums them over all blocks, and ranks the frequent ones anew as the phrases of m + 1 words. Blocks send keys and counts, packed, to
    the buckets that own the keys, and get the numbers of the frequent ones back, so no task holds a dictionary of the whole corpus. Pairs in
    hashed cells that get too few pairs in all are not sent; there are up to 2**max_bits cells (past that more pairs are sent, none is lost).
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words = (base.agg(F.sum(F.length("text"))).first()[0] or 0) // 6  # enough to size tables by
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, words // 3_000_000)
    bits = min(max_bits, max(16, math.ceil(math.log2(max(words, 1) / 16))))
    cut = materialise(blocks(base, block, buckets), "phrases-blocks")
    settled = materialise(settled_words(cut.where("bucket >= 0"), least, buckets), "phrases-1")
    known = _known(settled, words=True)
    level = materialise(encoded(cut, settled, parts), "phrases-level-1", replaces=cut)
    total = known.where("id < 0").groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = materialise(known.where("id >= 0").select("lang", "id", F.col("key").alias("phrase"), "f"), "phrases-named-1")
    named, last = [vocabulary], vocabulary.select("lang", F.col("id").alias("right"), F.col("phrase").alias("word"))
    for length in range(1, longest):
        asked = asked_pairs(level, length, bits, common_cells(level, length, least, bits), buckets)
        settled = materialise(settled_pairs(asked, least, buckets), f"phrases-{length + 1}")
        if length + 1 < longest:
            level = materialise(extended(level, settled, length, parts), f"phrases-level-{length + 1}", replaces=level)
        pairs = _known(settled, words=False).select("lang", "id", "f", F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("right"))
        before = named[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("start"))
        spelt = pairs.join(before, ["lang", "left"]).join(last, ["lang", "right"])
        named.append(materialise(spelt.select("lang", "id", F.concat_ws(" ", "start", "word").alias("phrase"), "f"), f"phrases-named-{length + 1}"))
    every = [x.select("lang", "phrase", F.lit(m + 1).alias("m"), "f") for m, x in enumerate(named)]
    return reduce(DataFrame.unionByName, every), total


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorbed: int = 100, block: int = 1_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language whose parts keep company most.

    Texts lose the case of A-Z and are cut into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs; n counts a
    language's words, f(phrase) its occurrences inside pieces, overlaps included. Phrases with a = f(phrase) >= least are candidates. Cut after its first
    k words into parts of frequencies l and r, a phrase scores floor(1000 * a * n / (l * r)); its lowest cut counts (ties: smallest k).
    Candidates inside a longer one of at least ``absorbed`` percent of their frequency go. Returns lang, rank, phrase, a, l, r, n, score by
    score and frequency, descending, then phrase in the order of its bytes. Products are decimals of 38 digits, so scores are exact.

    Null texts have no words; a null language is ``und``. Rows without id and repeated rows count like all others; ids and further
    columns are not read. An empty table gives no rows.
    """
    every, total = frequent_phrases(docs, least, longest, block, lang_col=lang_col, text_col=text_col)
    every = materialise(every, "phrases-all")
    long = every.where("m > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", "w", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    part = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    cuts = cuts.withColumn("over", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).withColumn("under", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where("m > 2").select("lang", "w", "m", "f", F.explode(F.expr("sequence(2, m - 1)")).alias("size"))
    inner = inner.select("lang", "w", "f", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("from"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    alone = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    rows = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    placed = numbered(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "rank")  # by ranges: a language may have most of all candidates
    return placed.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
