"""Token ids as Parquet list columns: written in document order, read back by column and by range."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, tidied

FORMAT = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",  # ids of a small vocabulary: two bytes or less each
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",  # narrow pages, so that the page index skips most of a row group
}
DELTA = FORMAT | {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}


#: ASCII marks other than the apostrophe, which some pre-tokens hold together with letters.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class WordEncoder:
    """Ids of whole texts, by way of a bounded cache of words.

    Exact for tokenizers that fold ASCII case, drop white space and never join letters with the marks behind
    them, so that a text is encoded as its words one by one, and a word as its letters and the
    marks behind. A text that may hold a special token's name is encoded as a whole.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def _ids(self, texts: list[str], at_once: int = 20_000) -> pa.ListArray:
        flat, sizes = array("i"), []
        for k in range(0, len(texts), at_once):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                sizes.append(len(ids))
        return _lists(np.cumsum([0, *sizes]), np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))

    def _parts(self, parts: pa.StringArray) -> pa.ListArray:
        """Ids of distinct letters or marks; the first of a corpus, which hold its frequent ones, stay known up to the limit."""
        at = pc.index_in(parts, self.known)
        new = parts.filter(pc.is_null(at))
        if not len(new):
            return self.lists.take(at)
        found = self._ids(new.to_pylist())
        place = at.to_numpy(zero_copy_only=False).copy()
        place[np.isnan(place)] = len(self.known) + np.arange(len(new))
        out = pa.concat_arrays([self.lists, found]).take(pa.array(place.astype(np.int32)))
        room = max(0, min(len(new), self.limit - len(self.known)))
        if room:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.lists = pa.concat_arrays([self.lists, found.slice(0, room)])
        return out

    def _words(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct words."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        split = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(words)), pc.match_substring_regex(core, r"\pL$"))
        core = pc.if_else(split, core, words)
        cut = np.flatnonzero(split.to_numpy(zero_copy_only=False))
        tails = [w[len(c) :] for w, c in zip(words.take(pa.array(cut)).to_pylist(), core.take(pa.array(cut)).to_pylist(), strict=True)]
        tail = np.zeros(len(words), np.int64)  # "" is the first part
        parts = pa.concat_arrays([pa.array([""], pa.string()), pa.array(tails, pa.string()), core]).dictionary_encode()
        of = parts.indices.to_numpy(zero_copy_only=False)
        tail[cut] = of[1 : len(cut) + 1]
        pairs = np.stack([of[len(cut) + 1 :], tail], axis=1).ravel()
        both = self._parts(parts.dictionary).take(pa.array(pairs))
        return _lists(both.offsets.to_numpy()[::2], both.values.to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (binary), those of ``end`` after each, and the number of ids of each."""
        texts = pc.fill_null(texts, b"").cast(pa.string())
        whole = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        plain = pc.if_else(pc.match_substring(texts, "<|"), "", texts) if len(whole) else texts
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = lists.flatten().dictionary_encode()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        # of each text its words, then the end; a text encoded whole has an entry of its own
        of = np.insert(words.indices.to_numpy(zero_copy_only=False), ends, len(words.dictionary))
        rows = np.arange(len(texts)) + ends
        table = [self._words(words.dictionary), _lists(np.array([0, len(end)]), end)]
        if len(whole):
            table.append(self._ids([texts[k].as_py() for k in whole.tolist()]))
            of = np.insert(of, rows[whole], len(words.dictionary) + 1 + np.arange(len(whole)))
            rows = rows + np.searchsorted(whole, np.arange(len(texts)), side="right")
        taken = pa.concat_arrays(table).take(pa.array(of))
        return taken.values.to_numpy(zero_copy_only=False), np.diff(taken.offsets.to_numpy()[rows + 1], prepend=0).astype(np.int64)


def _lists(at: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()))


@cache
def _encoder(path: str) -> WordEncoder:
    """One a worker process, so that tasks share what is known."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", options: dict[str, str] = FORMAT) -> None:
    """Encode whole texts and write (doc_id, part, at, n_tokens, tokens) in ascending id order.

    part is the file's place in that order and at the number of ids before the row in its file.
    Rows of one id follow each other by text; null ids come first; a null text is empty.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
    end = np.array([] if end_id is None else [end_id], np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = _encoder(tokenizer_path), 0
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                part = b.slice(k, 4000)
                flat, sizes = encoder.encode(part.column(1), end)
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(at + ends - sizes), pa.array(sizes), tokens], schema=schema)
                at += int(ends[-1])

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    ordered.mapInArrow(tidied(encode), "doc_id long, part int, at long, n_tokens long, tokens array<int>").write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, tokens: bool = True) -> DataFrame:
    """Rows with low <= doc_id < high, with their place ``start`` among all ids.

    The id range reaches the scan, where file, row group and page statistics skip the rest;
    without ``tokens`` only the metadata columns are read.
    """
    rows = spark.read.parquet(path)
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") < high)
    if before.count() <= 100_000:  # one row a file, so the token lists needn't be shuffled to meet them
        before = F.broadcast(before)
    return rows.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", *(["tokens"] if tokens else []))


def with_checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), the last two from the token lists themselves."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    return rows.select("doc_id", "start", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Write docs' tokens to the shared folder and read the whole back.

    A null text is empty and gets the end id alone. Rows of equal ids each get their own place.
    Only the id and text columns are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), **options)
    return read_tokens(spark, path)
