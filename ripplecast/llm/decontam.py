"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialise, tidied, values
from .substring import runs

SHINGLE = 3
_ODD = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20  # bits of a filter that are merged at once
_CHUNK = 1 << 17  # words looked at together

#: ASCII letters fold to lower case, digits and all bytes of non-ASCII characters stay, the rest separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for the ``size`` words from each place on, of word hashes h; sizes don't share hashes."""
    return runs(h, size, _ODD) ^ np.uint64(size * 0xD6E8FEB86659FD93 & (2**64 - 1))


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def text_key(text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(text or b"")


def item_windows(items: DataFrame, length: int) -> DataFrame:
    """(item, window, n, size, shingles): the windows of items (item, text binary), words joined by spaces; an item of fewer
    than ``length`` words is one window. shingles: hashes of its ``size``-word shingles in order; a shorter window is one shingle."""
    schema = pa.schema([("item", pa.string()), ("window", pa.string()), ("n", pa.int32()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(text)
                n, size = min(length, len(found)), min(SHINGLE, len(found), length)
                if not found:
                    continue
                g, seen = shingle_hashes(word_hashes(found), size).view(np.int64), {}
                for k in range(len(found) - n + 1):
                    seen.setdefault(b" ".join(found[k : k + n]).decode(), k)
                for some in itertools.batched(seen.items(), 5000):
                    yield batch(schema, item=[item] * len(some), window=[w for w, _ in some], n=[n] * len(some), size=[size] * len(some), shingles=[g[k : k + n - size + 1] for _, k in some])

    return items.mapInArrow(run, "item string, window string, n int, size int, shingles array<long>")


def bit_filter(hashes: DataFrame, max_bits: int) -> tuple[bytes, int]:
    """A bitmap of the high bits of all hashes (hash long), eight cells a hash or more up to 2**max_bits; and its bits.

    Tasks send blocks of it, which are merged in a stream one block at a time; the driver gets the result alone.
    """
    n = hashes.count()
    bits = min(max_bits, max(10, math.ceil(math.log2(max(n, 1) * 8))))
    block = min(_BLOCK, 1 << bits)
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = values(b.column(0)).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(cells, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for k, part in enumerate(cells.reshape(-1, block // 8)):
            if part.any():
                yield batch(schema, block=[k], cells=[zlib.compress(part.tobytes(), 1)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for row in itertools.chain((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), [None]):
            if now is not None and (row is None or row[0] != now):
                yield batch(schema, block=[now], cells=[zlib.compress(held.tobytes(), 1)])
                held = None
            if row:
                part = np.frombuffer(zlib.decompress(row[1]), np.uint8)
                now, held = row[0], part if held is None else held | part

    kind = "block int, cells binary"
    merged = hashes.mapInArrow(mark, kind).repartition((1 << bits) // block, "block").sortWithinPartitions("block").mapInArrow(merge, kind)
    out = bytearray((1 << bits) // 8)
    for r in merged.toLocalIterator():
        out[r.block * block // 8 : (r.block + 1) * block // 8] = zlib.decompress(r.cells)
    return bytes(out), bits


def _places(texts: list[bytes | None], sizes: list[int], cells: np.ndarray, bits: int) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """Of several texts at once: their words, and (text, place, hash) of the shingles that the filter knows."""
    held, total = [], 0
    for k, text in enumerate([*texts, None]):
        if k == len(texts) or total >= _CHUNK:
            n = np.array([len(w) for w in held], np.int64)
            ends, h = np.cumsum(n), word_hashes(list(itertools.chain.from_iterable(held)))
            of, place, found = [], [], []
            for size in sizes:
                g = shingle_hashes(h, size) if len(h) >= size else h[:0]
                at = g >> np.uint64(64 - bits)
                p = np.flatnonzero(cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                d = np.searchsorted(ends, p, side="right")
                inside = p + size <= ends[d]
                of.append(d[inside])
                place.append(p[inside] - (ends - n)[d[inside]])
                found.append(g[p[inside]])
            yield held, np.concatenate(of), np.concatenate(place), np.concatenate(found)
            held, total = [], 0
        if k < len(texts):
            held.append(words(text))
            total += len(held[-1])


def rarest(docs: DataFrame, windows: DataFrame, sizes: list[int], max_bits: int) -> DataFrame:
    """(window, n, size, offset, hash): each window's prefix, its shingle of least frequency over all documents (ties to the first)."""
    each = windows.select("window", "n", "size", F.posexplode("shingles").alias("offset", "hash"))
    cells, bits = bit_filter(each.select("hash").distinct(), max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("hash", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, total = np.frombuffer(shared.value, np.uint8), [], 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return batch(schema, hash=found.view(np.int64), docs=n)

        for b in batches:
            for _, _, _, found in _places(b.column(0).to_pylist(), sizes, own, bits):
                held.append(found)
                total += len(found)
                if total > 1_000_000:
                    yield counted()
                    held, total = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(tidied(count), "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs"))
    chosen = F.min_by(F.struct("n", "size", "offset", "hash"), F.struct(F.coalesce("docs", F.lit(0)), F.col("offset")))
    return each.join(counts, "hash", "left").groupBy("window").agg(chosen.alias("p")).select("window", "p.*")


def occurrences(docs: DataFrame, prefixes: DataFrame, sizes: list[int], length: int, max_bits: int) -> DataFrame:
    """(key, start, n, window): every place where a window stands in a text, by the text's key.

    A document sends only the places of its shingles that may be a prefix, with the words around, and these meet the prefixes by hash;
    the window must fit in the text at its offset and its words are compared.
    """
    cells, bits = bit_filter(prefixes.select("hash").distinct(), max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("hash", pa.int64()), ("key", pa.binary()), ("place", pa.int32()), ("left", pa.int32()), ("around", pa.string())])
    reach = max(length - 1, 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            texts, done = b.column(0).to_pylist(), 0
            for held, of, place, found in _places(texts, sizes, own, bits):
                keys = {d: text_key(texts[done + d]) for d in np.unique(of).tolist()}
                done += len(held)
                for k in range(0, len(of), 20_000):
                    part = list(zip(of[k : k + 20_000].tolist(), place[k : k + 20_000].tolist(), strict=True))
                    around = [b" ".join(held[d][max(p - reach, 0) : p + reach + 1]).decode() for d, p in part]
                    yield batch(schema, hash=found[k : k + 20_000].view(np.int64), key=[keys[d] for d, _ in part], place=[p for _, p in part], left=[min(p, reach) for _, p in part], around=around)

    met = docs.select("text").mapInArrow(tidied(find), "hash long, key binary, place int, left int, around string").join(prefixes, "hash")
    here = F.array_join(F.slice(F.split("around", " "), F.col("left") - F.col("offset") + 1, F.col("n")), " ")
    return met.where(F.when(F.col("left") >= F.col("offset"), here == F.col("window")).otherwise(False)).select("key", (F.col("place") - F.col("offset")).alias("start"), "n", "window")


def _covered(spans: Column) -> Column:
    """Words in the union of spans (start, n), sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, x: Column) -> Column:
        end = (x["start"] + x["n"]).cast("long")
        return F.struct(F.greatest(s["reach"], end).alias("reach"), (s["total"] + F.greatest(end - F.greatest(s["reach"], x["start"].cast("long")), F.lit(0).cast("long"))).alias("total"))

    return F.aggregate(spans, zero, step, lambda s: s["total"])


def _found(docs: DataFrame, benchmark: DataFrame, length: int, item_col: str, item_text: str, max_bits: int) -> DataFrame:
    """(key, n_hit, items) of the texts of docs (text binary) in which a window of an item stands."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("item is not null and text is not null")
    windows = materialise(item_windows(items, length), "decontam-windows")
    distinct = windows.groupBy("window").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # SHINGLE at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "key binary, n_hit long, items array<string>")
    prefixes = materialise(rarest(docs, distinct, sizes, max_bits), "decontam-prefixes")
    hits = materialise(occurrences(docs, prefixes, sizes, length, max_bits), "decontam-hits")
    spans = hits.groupBy("key").agg(_covered(F.array_sort(F.collect_set(F.struct("start", "n")))).alias("n_hit"))
    named = hits.select("key", "window").distinct().join(windows.select("window", "item").distinct(), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return materialise(spans.join(named, "key"), "decontam-found")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], length: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bits: int = 27, small: int = 100_000) -> DataFrame:
    """Columns ``keep`` of each row with struct ``found``: (n_words, n_hit, items, contaminated). Where keep holds a column ``found``, the
    struct's name gets as many underscores behind it as it takes to be another.

    Words are runs of ASCII letters (folded), digits and non-ASCII characters. A window is
    ``length`` consecutive words of an item, or all of a shorter item. A document word inside
    any occurrence of a window is hit; items lists the ids with occurring windows, as text.

    Items, their windows and prefixes are tables; the driver and each task hold a bitmap of 2**max_bits bits at most. Documents
    are read three times and send only shingles that may be a prefix; results by text meet the rows again by the text's 128-bit hash, broadcast
    up to ``small`` texts with fifty items each, else in a shuffle. Null texts have no words; items without
    id or words match nothing; items of one id count once. Repeated rows are each answered. An
    empty benchmark hits nothing. Further columns, of any name, are carried only if named in keep.
    """
    plain = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(text_col).cast("binary").alias("text"))
    found = _found(plain.select("text"), benchmark, length, item_col, item_text, max_bits)
    n, items = found.agg(F.count("*"), F.sum(F.size("items"))).first()
    found = F.broadcast(found) if n <= small and (items or 0) <= 50 * small else found

    @F.pandas_udf("key binary, n_words long")
    def looked_at(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": [text_key(t) for t in texts], "n_words": [len(words(t)) for t in texts]})

    rows = plain.withColumn("seen", looked_at("text")).drop("text").withColumn("key", F.col("seen.key"))
    met = rows.join(found, "key", "left")
    none = F.array().cast("array<string>")
    out = F.struct(F.col("seen.n_words").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
    name = "found"
    while name in keep:
        name += "_"
    return met.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], out.alias(name))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bits: int = 27, small: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs. Up to ``small`` contaminated texts are broadcast, as 16 bytes each."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = F.col(f"c{names.index(text_col)}").cast("binary")
    keys = _found(plain.select(text.alias("text")), benchmark, length, item_col, item_text, max_bits).select("key")
    n = keys.count()

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_key(t) for t in texts], dtype=object)

    if not n:
        return docs
    keyed = plain.withColumn("key", key_of(text))
    kept = keyed.join(F.broadcast(keys) if n <= small else keys.hint("merge"), "key", "left_anti")
    return kept.select(*plain.columns).toDF(*names)
