"""A quality classifier: random-indexing word vectors pooled per document, and a small calibrated network."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

WORDS = 1 << 13  # hashed word vectors
SHAPES = 1 << 11  # hashed vectors of letter-case and punctuation shapes
DIM, NONZERO = 32, 4  # of a vector; of an index vector
_ROWS = WORDS + SHAPES
_REPEAT = WORDS  # the shape of a word that stood one or two places before
_BLOCKS = 20


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse ternary index vector of each row."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((_ROWS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (_ROWS, NONZERO))


_SHAPE = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")


def _shape_of(m: re.Match) -> bytes:
    c = m[0][:1]
    return b"0" if c.isdigit() else b"A" if c.isupper() else b"a"


class Units:
    """Row numbers of words and of their shapes, by way of a bounded cache."""

    def __init__(self, limit: int = 150_000):
        self.known, self.limit = {}, limit

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or b"").split()
        known = self.known
        try:
            packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
            for w in new:
                shape = _SHAPE.sub(_shape_of, w)[:24]
                known[w] = (xxhash.xxh3_64_intdigest(w.lower()) >> 18) << 16 | (WORDS + 1 + xxhash.xxh3_64_intdigest(shape) % (SHAPES - 1))
            packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            for w in new if len(known) > self.limit else ():  # the first words of a corpus hold its frequent ones
                del known[w]
        word, shape = packed >> 16, packed & 65535
        for d in (1, 2):
            shape[d:][word[d:] == word[:-d]] = _REPEAT
        return word % WORDS, shape


def context_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of every row: the sum of its neighbours' index vectors over all documents, and its count.

    A task sums into one table of fixed size and sends it in compressed blocks; blocks of one
    place are added in a stream. The driver gets _ROWS * (DIM + 1) numbers, whatever the input.
    """
    places, signs = index_vectors()
    schema = pa.schema([("block", pa.int32()), ("table", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, table, seen = Units(), np.zeros(_ROWS * DIM), np.zeros(_ROWS)

        def add(held: list[np.ndarray]) -> None:
            row = np.concatenate(held)  # -1 ends a document
            seen[:] += np.bincount(row[row >= 0], minlength=_ROWS)
            left, right = row[:-1], row[1:]
            both = (left >= 0) & (right >= 0)
            left, right = left[both], right[both]
            for a, b in ((left, right), (right, left)):
                for j in range(NONZERO):
                    table[:] += np.bincount(a * DIM + places[b, j], weights=signs[b, j], minlength=_ROWS * DIM)

        held, total = [], 0
        for b in batches:
            for t in b.column(0):
                word, shape = units(t.as_py())
                held += (word, [-1], shape, [-1])
                total += len(word)
                if total > 400_000:
                    add(held)
                    held, total = [], 0
        if held:
            add(held)
        out = np.concatenate([table.reshape(_ROWS, DIM), seen[:, None]], axis=1).astype(np.int64)
        for k, part in enumerate(np.array_split(out, _BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for row in itertools.chain((r for b in batches for r in zip(b.column(0), b.column(1), strict=True)), [None]):
            k = row[0].as_py() if row else None
            if now is not None and k != now:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], schema=schema)
                total = None
            if row:
                part = np.frombuffer(zlib.decompress(row[1].as_py()), np.int64)
                total = part.copy() if total is None else total + part
            now = k

    kind = "block int, table binary"
    sums = docs.select("text").mapInArrow(tidied(count), kind).repartition(_BLOCKS, "block").sortWithinPartitions("block").mapInArrow(merge, kind).collect()
    table = np.zeros((_ROWS, DIM + 1))
    for (a, z), r in ((((x := np.array_split(np.arange(_ROWS), _BLOCKS)[r.block])[0], x[-1] + 1), r) for r in sums):
        table[a:z] = np.frombuffer(zlib.decompress(r.table), np.int64).reshape(-1, DIM + 1)
    return table[:, :DIM], table[:, DIM]


def word_vectors(context: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(_ROWS, 2 * DIM): the unit context vector beside the row's own index vector; frequent words weigh less."""
    places, signs = index_vectors()
    own = np.zeros((_ROWS, DIM))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    both = np.concatenate([context / np.maximum(norm, 1), own], axis=1)
    share = seen / max(seen[:WORDS].sum(), 1)
    weight = np.ones(_ROWS)
    weight[:WORDS] = 1e-3 / (1e-3 + share[:WORDS])
    return (both * weight[:, None]).astype(np.float32)


def pooled(units: Units, vectors: np.ndarray, text: bytes | None) -> np.ndarray:
    """Mean vector of the words, mean vector of the shapes, and the length; zeros where there is no word."""
    word, shape = units(text)
    if not len(word):
        return np.zeros(4 * DIM + 1, np.float32)
    counts = np.bincount(shape - WORDS, minlength=SHAPES)
    used = np.flatnonzero(counts)
    shapes = counts[used] @ vectors[WORDS + used] / len(shape)
    return np.concatenate([vectors[word].mean(axis=0), shapes, [np.log1p(len(word))]]).astype(np.float32)


@dataclass
class Network:
    """Two layers on standardised inputs; probabilities at a fitted temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, validate: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> Network:
    """Adam on the log loss of the rows not in ``validate``, whose log loss then fixes the temperature.

    Without rows, or rows of one class, every score is the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), x.std(axis=0) + 1e-3 if len(x) else np.ones(d), rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return net
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    train = ~validate if validate.any() and (~validate).any() else np.ones(len(y), bool)
    xs, ys = (x[train] - net.mean) / net.scale, y[train].astype(float)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // 512)):
            h = np.tanh(xs[part] @ weights[0] + weights[1])
            err = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - ys[part]) / len(part)
            back = np.outer(err, weights[2]) * (1 - h * h)
            grads = [xs[part].T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ err + 1e-4 * weights[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] = weights[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if validate.any():
        z, t = net.logits(x[validate]), y[validate]
        loss = lambda k: np.logaddexp(0, np.where(t == 1, -z, z) / k).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents; the network from at most max_rows labelled ones, chosen by a hash of the id.

    docs: (doc_id, text as binary). Only rows of labels outside the held-out fold are used; of
    several labels of one id the largest.
    """
    spark = docs.sparkSession
    vectors = word_vectors(*context_vectors(docs))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    sample = usable.where(_fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    shared = spark.sparkContext.broadcast(vectors)
    width = 4 * DIM + 1
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pooled(units, shared.value, t.as_py()).tobytes() for t in b.column(2)], pa.binary())], schema=schema)

    chosen = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")  # max_rows ids
    rows = chosen.mapInArrow(tidied(features), "doc_id long, quality int, x binary").orderBy("doc_id", "x").limit(2 * max_rows).collect()
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, width)
    y = np.array([r.quality for r in rows], np.int64)
    validate = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows], bool)
    return vectors, fit(x.astype(np.float64), y, validate)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    held_out: crc32 of the id as text is divisible by 5; such labels are not learned from. A null
    id is never held out. Null and empty texts get the score of the zero vector. Repeated rows are each
    scored. Without usable labels every score is one half. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(train(plain, labels, max_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, (vectors, net) = Units(), shared.value
        for b in batches:
            x = np.stack([pooled(units, vectors, t.as_py()) for t in b.column(1)]).astype(np.float64) if b.num_rows else np.zeros((0, 4 * DIM + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.scores(x))], schema=schema)

    scored = plain.mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; scored in one narrow pass."""
    names = docs.columns
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(plain, labels, max_rows))
    safe = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, (vectors, net) = Units(), shared.value
        for b in batches:
            if b.num_rows:
                x = np.stack([pooled(units, vectors, t.as_py()) for t in b.column(at).cast(pa.binary())]).astype(np.float64)
                yield b.filter(pa.array(net.scores(x) >= threshold))

    return safe.mapInArrow(tidied(run), safe.schema).toDF(*names)
