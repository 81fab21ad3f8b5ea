"""Near-duplicate classes by SimHash: a generalised pigeonhole search over fingerprints of 64 bits within an exact radius,
and over long fingerprints for a shingle similarity that is then verified."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, components, materialise, tidied, values

BITS = 64
_SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256
#: Words of 64 bits of a long fingerprint: those that keys are made of, then those that compare rows of a bucket.
LONG, CHECK = 14, 2
_WORDS = LONG + CHECK
_FLIP, _FACTOR = np.random.default_rng(_SEED).integers(0, 2**64, (2, _WORDS), dtype=np.uint64) | np.array([[0], [1]], np.uint64)
_LONG_AT = np.arange(8 * _WORDS, dtype=np.int64) * 256


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles, in order; of all words where there are fewer; none where there is no word."""
    words = (text or b"").lower().split()  # bytes: folds A-Z and splits on ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, _SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], _SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype=np.uint64)


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash of the ``width``-word shingles; 0 where there is no word."""
    hashes = shingles(text, width)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) of every row; a null text has no words. fp holds the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, width) for t in (x.as_py() for x in b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Groups of bits and the distance allowed in each; the thresholds sum to radius - groups + 1."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def bit_groups(cov: np.ndarray, m: int, used: int = BITS) -> tuple[tuple[int, ...], ...]:
    """Greedy grouping of correlated bits into m groups of near-equal width, of ``used`` bits in all."""
    dev = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = math.ceil((used - sum(map(len, out))) / (m - k))
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(tuple(sorted(group)))
    return tuple(out)


def allocate(costs: list[list[float]], total: int) -> tuple[tuple[int, ...], float]:
    """Thresholds t_i >= -1 with sum ``total`` of least summed costs[i][t_i + 1], by dynamic programming."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if spent + t not in step or cost + c < step[spent + t][0]:
                    step[spent + t] = (cost + c, (*chosen, t))
        best = step
    cost, chosen = best[total]
    return chosen, cost


def group_costs(group: tuple[int, ...], ones: np.ndarray, n: int, equal_pairs: float, radius: int, probe: float) -> list[float]:
    """Estimated work of thresholds -1..radius in one group: keys made and pairs compared.

    equal_pairs is exact (from counts over all fingerprints). Pairs at distance d follow from
    it by the ratio that independent bits of these frequencies would have.
    """
    p = ones[list(group)] / max(n, 1)
    dist = np.array([1.0])
    for differ in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - differ, differ])
    pairs = equal_pairs * dist / max(dist[0], 1e-300)
    out, w = [0.0], len(group)
    for t in range(radius + 1):
        compared = sum(math.comb(w - d, t - d) * min(pairs[d], n * n / 2) for d in range(t + 1))
        out.append(probe * n * math.comb(w, t) + compared)
    return out


def gather_bits(fps: np.ndarray, group: tuple[int, ...]) -> np.ndarray:
    """The bits of ``group``, packed; fps: one word a row, or a column for each word."""
    words, out = fps[:, None] if fps.ndim == 1 else fps, np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((words[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)) << np.uint64(k)
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def plan(distinct: DataFrame, radius: int, choices: tuple[int, ...] = (2, 3, 4, 5, 6), probe: float = 20.0) -> Plan:
    """Choose the bit groups and thresholds of least estimated work, from statistics of all fingerprints.

    Collected to the driver: the 64 x 64 counts of bits set together and one number a group.
    """
    pair_schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(values(b.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(bits), 1 << 20):
                both += (part := bits[k : k + (1 << 20)]).T @ part
        i, j = np.indices((BITS, BITS))
        yield batch(pair_schema, i=i.ravel().astype(np.int32), j=j.ravel().astype(np.int32), n=both.ravel().astype(np.int64))

    n = distinct.count()
    both = np.zeros((BITS, BITS))
    for r in distinct.select("fp").mapInArrow(together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toLocalIterator():
        both[r.i, r.j] = r.n
    ones = np.diag(both).copy()
    cov = both / max(n, 1) - np.outer(ones, ones) / max(n, 1) ** 2
    groupings = {m: bit_groups(cov, m) for m in choices}
    flat = [(m, k, g) for m, groups in groupings.items() for k, g in enumerate(groups)]
    key_schema = pa.schema([("g", pa.int32()), ("v", pa.int64())])

    def group_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = values(b.column(0)).view(np.uint64)
            for k, (_, _, group) in enumerate(flat):
                yield batch(key_schema, g=np.full(len(fps), k, np.int32), v=gather_bits(fps, group).view(np.int64))

    counts = distinct.select("fp").mapInArrow(group_values, "g int, v long").groupBy("g", "v").count()
    pairs = {r.g: float(r.p) for r in counts.groupBy("g").agg(F.sum(F.expr("count * (count - 1D) / 2")).alias("p")).collect()}
    best = None
    for m, groups in groupings.items():
        costs = [group_costs(g, ones, n, pairs.get(k, 0.0), radius, probe) for k, (mm, _, g) in enumerate(flat) if mm == m]
        chosen, cost = allocate(costs, radius - m + 1)
        if best is None or cost < best.cost:
            best = Plan(groups, chosen, cost)
    return best


def probes(chosen: Plan) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(number, bits that the key fixes) of every key a row gets."""
    salt = 0
    for group, t in zip(chosen.groups, chosen.thresholds, strict=True):
        for masked in itertools.combinations(group, t) if t >= 0 else ():
            salt += 1
            yield salt, tuple(b for b in group if b not in masked)


def probe_keys(fps: np.ndarray, chosen: Plan) -> Iterator[tuple[np.ndarray, tuple[int, ...]]]:
    """Keys, and the bits they fix, such that two fingerprints within the radius share one: in some group they differ in at
    most t of its bits, so they agree once the right t bits are left out."""
    for salt, fixed in probes(chosen):
        yield _mix(gather_bits(fps, fixed), salt), fixed


def _group_links(fps: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) indices of a spanning star for each component of one bucket."""
    todo, members, roots = np.arange(len(fps)), [], []
    while len(todo):
        root, todo, front = todo[0], todo[1:], todo[:1]
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for k in range(0, len(front), block):
                rest = np.flatnonzero(~near)
                near[rest] = (np.bitwise_count(fps[front[k : k + block], None] ^ fps[None, todo[rest]]) <= radius).any(axis=0)
            front, todo = todo[near], todo[~near]
            members.append(front)
            roots.append(np.full(len(front), root))
    return (np.concatenate(members), np.concatenate(roots)) if members else (np.zeros(0, int), np.zeros(0, int))


def bucket_links(group: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect whatever is within the radius inside a bucket; rows sorted by group."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edges, len(group)])
    of = np.repeat(size, size)
    us, vs = [], []
    small = np.flatnonzero((of > 1) & (of <= 4))
    for d in (1, 2, 3):
        i = small[small + d < len(group)]
        i = i[group[i] == group[i + d]]
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        us.append(ids[i])
        vs.append(ids[i + d])
    for start, n in zip(edges[size > 4].tolist(), size[size > 4].tolist(), strict=True):
        a, b = _group_links(fps[start : start + n], radius)
        us.append(ids[start + a])
        vs.append(ids[start + b])
    return np.concatenate(us), np.concatenate(vs)


def _mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def split_again(fps: np.ndarray, key: np.ndarray, fixed: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, keys, fixed bits) of a further pigeonhole step inside buckets whose rows agree in the bits ``fixed``.

    What two rows of a bucket differ in lies in the free bits; of radius + 1 parts of these they agree in one at least.
    """
    for mask in np.unique(fixed):
        rows = np.flatnonzero(fixed == mask)
        free = [b for b in range(BITS) if not int(mask) >> b & 1]
        for k in range(radius + 1):
            part = tuple(free[k :: radius + 1])
            yield rows, _mix(gather_bits(fps[rows], part) ^ _mix(key[rows], 7), k + 1), np.full(len(rows), mask | np.uint64(_mask(part)), np.uint64)


def links(distinct: DataFrame, chosen: Plan, radius: int, block_rows: int = 8192) -> DataFrame:
    """Links (u, v) between representatives (``node``) of distinct fingerprints (``fp``).

    Rows of a bucket are compared in one task. A bucket of more than block_rows rows is first split by a
    further pigeonhole step on the bits that its key leaves free, again and again, each time at the cost of radius + 1 keys
    for its rows alone. As fingerprints are distinct, a bucket of few free bits is small: the steps end, and
    no pair within the radius goes unchecked. Each bucket returns at most one link a row.
    """
    schema = pa.schema([("key", pa.int64()), ("fixed", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])
    kind = "key long, fixed long, fp long, node long"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = values(b.column(0)).view(np.uint64)
            for keys, fixed in probe_keys(fps, chosen):
                mask = np.full(len(fps), _mask(fixed), np.uint64)
                yield batch(schema, key=keys.view(np.int64), fixed=mask.view(np.int64), fp=b.column(0), node=b.column(1))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fixed, fps, node = (values(c) for c in b.columns)
            for rows, keys, mask in split_again(fps.view(np.uint64), key.view(np.uint64), fixed.view(np.uint64), radius):
                yield batch(schema, key=keys.view(np.int64), fixed=mask.view(np.int64), fp=fps[rows], node=node[rows])

    link_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fps, ids in whole_groups(batches):
            u, v = bucket_links(key, fps.view(np.uint64), ids, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=link_schema)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, ready = distinct.select("fp", "node").mapInArrow(keyed, kind), []
    while True:
        large = materialise(keys.groupBy("key").count().where(F.col("count") > block_rows).select("key"), "simhash-large")
        if large.isEmpty():
            ready.append(keys)
            break
        ready.append(keys.join(large, "key", "left_anti"))
        keys = materialise(keys.join(large, "key").select(*schema.names).mapInArrow(finer, kind), "simhash-finer")
    found = [k.select("key", "fp", "node").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidied(compare), "u long, v long") for k in ready]
    return functools.reduce(DataFrame.unionByName, found)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, cut where it changes; a column of equal-sized binaries becomes rows of words."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            new = [words_of(c) if pa.types.is_binary(c.type) else values(c) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if held is None or not len(held[0]):
            continue
        cut = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
        if cut:
            yield [h[:cut] for h in held]
            held = [h[cut:] for h in held]


def words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes: one row a document (doc_id, fingerprint, component_id).

    Documents link where their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest doc_id reachable. Only doc_id and text are read, so further columns of any
    name do no harm. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows come back as often as they went in. A row without a doc_id gets its
    fingerprint, links to nothing and has a null component_id. An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, width, id_col, text_col), "simhash-fps")
    distinct = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    found = components(links(distinct, plan(distinct, radius), radius), "simhash-links")
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes in _WORDS words; each word comes from hashes mixed anew."""
    x = (hashes[:, None] ^ _FLIP) * _FACTOR
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    raw = x.view(np.uint8).reshape(len(hashes), 8 * _WORDS)
    if len(hashes) < 128:
        ones = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    else:
        seen = np.zeros(256 * 8 * _WORDS, np.int64)
        for k in range(0, len(raw), 4096):
            seen += np.bincount((raw[k : k + 4096] + _LONG_AT).ravel(), minlength=len(seen))
        ones = (seen.reshape(-1, 256).astype(np.float64) @ _BYTE_BITS.astype(np.float64)).ravel()
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def set_rows(docs: DataFrame, width: int, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """(doc_id, digest, n, sig) of the shingle set of every row, or with ``whole`` (doc_id, digest, hashes)."""
    kind = [("n", pa.int32()), ("sig", pa.binary())] if not whole else [("hashes", pa.list_(pa.int64()))]
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), *kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                sets = [np.unique(shingles(t.as_py(), width)) for t in part.column(1)]
                digest = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), _SEED) for h in sets), np.uint64, len(sets)).view(np.int64)
                if whole:
                    rest = {"hashes": [h.view(np.int64) for h in sets]}
                else:
                    rest = {"n": [len(h) for h in sets], "sig": [long_fingerprint(h).tobytes() for h in sets]}
                yield batch(schema, doc_id=part.column(0), digest=digest, **rest)

    kind = "hashes array<long>" if whole else "n int, sig binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(run), f"doc_id long, digest long, {kind}")


def differing_share(similarity: float) -> float:
    """The greatest expected share of bits in which sets of at least this Jaccard similarity differ.

    A bit differs with probability angle / pi, and the cosine of sets a, b is at least 2 J / (1 + J), as
    their common part is J / (1 + J) of |a| + |b|.
    """
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def cover(costs: list[list[float]], gains: list[list[float]], needed: float, steps: int = 400) -> tuple[tuple[int, ...], float]:
    """Thresholds t_i >= -1 of least summed costs[i][t_i + 1] whose gains sum to ``needed`` at least, by dynamic programming on
    gains in units of needed / steps; where none reach it, the largest."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row, gain in zip(costs, gains, strict=True):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for got, (cost, chosen) in best.items():
            for t, (c, g) in enumerate(zip(row, gain, strict=True), start=-1):
                at = min(steps, got + int(g / needed * steps))
                if at not in step or cost + c < step[at][0]:
                    step[at] = (cost + c, (*chosen, t))
        best = step
    cost, chosen = best[max(best)]
    return chosen, cost


def word_groups(both: np.ndarray, n: int, width: int) -> list[tuple[int, ...]]:
    """Groups of ``width`` correlated bits of each word; what is left of a word stays unused."""
    out = []
    for w in range(LONG):
        ones = np.diag(both[w])
        cov = both[w] / max(n, 1) - np.outer(ones, ones) / max(n, 1) ** 2
        out += [tuple(64 * w + b for b in g) for g in bit_groups(cov, 64 // width, 64 - 64 % width)]
    return out


def similarity_plan(distinct: DataFrame, similarity: float, miss: float, widths: tuple[int, ...] = (8, 10, 12, 14, 16, 18, 20, 24), probe: float = 200.0) -> tuple[Plan, float]:
    """Bit groups and thresholds of least estimated work that leave out a pair at ``similarity`` with a probability of
    ``miss`` at most; and a bound on the rows of a bucket.

    Bits differ independently with probability ``differing_share``, so a group of w bits finds the pair where a binomial
    number of differing bits is within its threshold. The width follows from bit frequencies of all
    fingerprints, the thresholds from exact counts of equal pairs in each group. Collected: the counts of bits set together within
    a word, and two numbers a group.
    """
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64())])
    upper = np.flatnonzero(np.triu(np.ones((64, 64), bool)).ravel())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((LONG, 64, 64))
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                sig = words_of(b.column(0).slice(k, 4096))[:, :LONG]
                bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1, bitorder="little").reshape(len(sig), LONG, 64).astype(np.float32)
                both += np.einsum("rwi,rwj->wij", bits, bits, optimize=True)
        at = (np.arange(LONG)[:, None] * 4096 + upper).ravel()
        yield batch(schema, at=at.astype(np.int32), n=both.reshape(LONG, -1)[:, upper].ravel().astype(np.int64))

    n = distinct.count()
    both = np.zeros(LONG * 4096)
    for r in distinct.select("sig").mapInArrow(together, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        both[r["at"]] = r["n"]
    both = both.reshape(LONG, 64, 64)
    both = np.maximum(both, both.transpose(0, 2, 1))
    ones, p = np.concatenate([np.diag(w) for w in both]), differing_share(similarity)
    needed = -math.log(miss)

    def thresholds(groups: list[tuple[int, ...]], pairs: list[float]) -> tuple[Plan, float]:
        hits = [np.cumsum([0.0, *(math.comb(len(g), d) * p**d * (1 - p) ** (len(g) - d) for d in range(3))]) for g in groups]
        costs = [group_costs(g, ones, n, e, 2, probe) for g, e in zip(groups, pairs, strict=True)]
        chosen, cost = cover(costs, [(-np.log1p(-h)).tolist() for h in hits], needed)
        return Plan(tuple(groups), chosen, cost), cost

    def expected(group: tuple[int, ...]) -> float:
        f = ones[list(group)] / max(n, 1)
        return float(np.prod(1 - 2 * f * (1 - f))) * n * n / 2

    guesses = [thresholds(g := word_groups(both, n, w), [expected(x) for x in g]) for w in widths]
    groups = min(guesses, key=lambda x: x[1])[0].groups
    key_schema = pa.schema([("g", pa.int32()), ("v", pa.int64())])

    def group_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            sig = words_of(b.column(0))
            for k, group in enumerate(groups):
                yield batch(key_schema, g=np.full(len(sig), k, np.int32), v=gather_bits(sig, group).view(np.int64))

    counts = distinct.select("sig").mapInArrow(group_values, "g int, v long").groupBy("g", "v").count()
    found = {r.g: r for r in counts.groupBy("g").agg(F.sum(F.expr("count * (count - 1D) / 2")).alias("p"), F.max("count").alias("most")).collect()}
    chosen, _ = thresholds(list(groups), [float(found[k].p) if k in found else 0.0 for k in range(len(groups))])
    most = max((found[k].most << t for k, t in enumerate(chosen.thresholds) if t >= 0 and k in found), default=0)
    return chosen, most


def limit_of(similarity: float, words: int) -> int:
    """Differing bits of so many words, four standard deviations over the expected."""
    p, n = differing_share(similarity), 64 * words
    return math.floor(p * n + 4 * math.sqrt(n * p * (1 - p)))


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= limit


def bucket_candidates(key: np.ndarray, node: np.ndarray, n: np.ndarray, check: np.ndarray, similarity: float, wide: int = 2048, dense: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, u, v) of rows sorted by key: pairs of a bucket that are near in their check words and in size; bucket is 0.

    A bucket of over ``wide`` rows, or with more than ``dense`` such pairs a row, gives instead a star for
    each of its components, under the bucket's key: members that are then not alike are compared by ``rest_of_stars``.
    """
    limit = limit_of(similarity, CHECK)
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[edges, len(key)])
    of = np.repeat(np.arange(len(edges)), size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = np.flatnonzero(size[of] <= wide)
    d = 0
    while len(live := live[live + d + 1 < edges[of[live]] + size[of[live]]]):
        d += 1
        j = live + d
        i = live[np.minimum(n[live], n[j]) + 1e-9 >= similarity * np.maximum(n[live], n[j])]
        i = i[_near(check[i], check[i + d], limit)]
        left.append(i)
        right.append(i + d)
    left, right = np.concatenate(left), np.concatenate(right)
    full = (np.bincount(of[left], minlength=len(edges)) > dense * size) | (size > wide)
    plain = ~full[of[left]]
    found = [(np.zeros(int(plain.sum()), np.int64), node[left[plain]], node[right[plain]])]
    for k in np.flatnonzero(full).tolist():
        at = slice(edges[k], edges[k] + size[k])
        by = np.argsort(node[at], kind="stable")
        member, root = _stars(check[at][by], n[at][by], limit, similarity)
        found.append((np.full(len(member), key[edges[k]]), node[at][by][root], node[at][by][member]))
    bucket, u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return bucket, np.minimum(u, v), np.maximum(u, v)


def _stars(check: np.ndarray, n: np.ndarray, limit: int, similarity: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of a spanning star for each component of one bucket."""
    todo, members, roots = np.arange(len(n)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(todo):
        root, todo, front = todo[0], todo[1:], todo[:1]
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for k in range(0, len(front), block):
                rest = np.flatnonzero(~near)
                a, b = front[k : k + block, None], todo[rest][None]
                near[rest] = (_near(check[a], check[b], limit) & (np.minimum(n[a], n[b]) + 1e-9 >= similarity * np.maximum(n[a], n[b]))).any(axis=0)
            front, todo = todo[near], todo[~near]
            members.append(front)
            roots.append(np.full(len(front), root))
    return np.concatenate(members), np.concatenate(roots)


_ALIKE = "bucket long, u long, v long"


def candidates(distinct: DataFrame, chosen: Plan, most: float, similarity: float, block_rows: int = 8192) -> DataFrame:
    """(bucket, u, v) by ``bucket_candidates`` over all buckets of the plan's keys.

    Where a bucket may pass block_rows rows, the rows of such buckets are dealt by size: sets alike in ``similarity`` lie
    in the same or in neighbouring classes of sizes, so each row goes to its own class and the next.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            sig = words_of(b.column(2))
            check = pa.array([x.tobytes() for x in sig[:, LONG:]], pa.binary())
            for keys, _ in probe_keys(sig, chosen):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0), b.column(1), check], schema=schema)

    # of sets this small only equal ones are alike
    some = distinct.where(F.col("n") >= math.ceil(similarity / (1 - similarity) - 1e-9)).select("node", "n", "sig")
    keys = some.mapInArrow(keyed, "key long, node long, n int, sig binary")
    if most > block_rows:
        large = materialise(keys.groupBy("key").count().where(F.col("count") > block_rows).select("key", F.lit(True).alias("large")), "near-large")
        own = F.floor(F.log("n") / -math.log(similarity)).cast("int")
        classes = F.when(F.col("large"), F.array(own, own + 1)).otherwise(F.array(F.lit(-1)))
        keys = keys.join(large, "key", "left").withColumn("class", F.explode(classes))
        keys = keys.withColumn("key", F.when(F.col("large"), F.xxhash64("key", "class")).otherwise(F.col("key"))).select(*schema.names)
    out_schema = pa.schema([("bucket", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, check in whole_groups(batches):
            bucket, u, v = bucket_candidates(key, node, n, check, similarity)
            yield batch(out_schema, bucket=bucket, u=u, v=v)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidied(compare), _ALIKE)


def near_pairs(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (u, v) whose whole fingerprints are near enough to be worth an exact count."""
    limit = limit_of(similarity, _WORDS)
    one, two = (distinct.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}")) for c in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["u", "v"]).filter(pa.array(_near(words_of(b.column(2)), words_of(b.column(3)), limit)))

    return pairs.select("u", "v").where("u != v").distinct().join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def rest_of_stars(stars: DataFrame, labels: DataFrame, distinct: DataFrame, similarity: float, block_rows: int = 8192) -> DataFrame:
    """(u, v): pairs of different labels, near in their whole fingerprints, among the members of each star (bucket, u, v).

    Stars whose members all got one label are done. The members of a star of over block_rows are dealt by size, as
    in ``candidates``.
    """
    rows = stars.select(F.xxhash64("bucket", "u").alias("star"), F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    rows = materialise(rows, "near-stars-labelled")
    open_ = rows.groupBy("star").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count("*").alias("size")).where("a != z").select("star", "size")
    rows = rows.join(open_, "star").join(distinct.select("node", "n", "sig"), "node")
    own = F.floor(F.log("n") / -math.log(similarity)).cast("int")
    classes = F.when(F.col("size") > block_rows, F.array(own, own + 1)).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("class", F.explode(classes)).select(F.xxhash64("star", "class").alias("group"), "node", "label", "n", "sig")
    limit = limit_of(similarity, _WORDS)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, node, label, n, sig in whole_groups(batches):
            for at in np.split(np.arange(len(group)), np.flatnonzero(group[1:] != group[:-1]) + 1):
                for u, v in cross_label_pairs(node[at], label[at], n[at], sig[at], limit, similarity):
                    yield batch(schema, u=u, v=v)

    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(tidied(compare), "u long, v long").distinct()


def cross_label_pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray, limit: int, similarity: float, block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of rows of different labels; rows of the most frequent label aren't compared among themselves."""
    kinds, of, size = np.unique(label, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(of != size.argmax())
    for k in range(0, len(rest), block):
        a = rest[k : k + block]
        i, j = np.nonzero((of[a, None] != of[None]) & (np.minimum(n[a, None], n[None]) + 1e-9 >= similarity * np.maximum(n[a, None], n[None])))
        for c in range(0, len(i), 1 << 16):
            x, y = a[i[c : c + (1 << 16)]], j[c : c + (1 << 16)]
            near = _near(sig[x], sig[y], limit)
            x, y = node[x[near]], node[y[near]]
            yield np.minimum(x, y), np.maximum(x, y)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of at least ``similarity``, counted exactly."""
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "uv")
    both = F.size(F.array_intersect("hu", "hv"))
    found = pairs.join(one, "u").join(two, "v").select("u", "v", both.alias("both"), (F.size("hu") + F.size("hv")).alias("total"))
    return found.where(F.col("both") + 1e-9 >= similarity * (F.col("total") - F.col("both"))).select("u", "v")


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", miss: float = 0.001, small: int = 2_000_000, block_rows: int = 8192) -> DataFrame:
    """(doc_id, component_id) of every row with an id: documents link where the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``similarity``; component_id is the smallest doc_id reachable.

    Candidates agree in a bit group of their long SimHash up to its threshold; the plan finds a pair at the
    similarity with a calculated probability of 1 - ``miss``, more similar ones more surely, and every link is verified on
    the sets. First each document is compared with the least of its candidates, then only candidates not yet in one
    component. Texts without a word are alike; different texts of one id count as one document.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    rows = materialise(set_rows(docs, width, id_col, text_col), "near-rows")
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    distinct = materialise(distinct, "near-distinct")
    chosen, most = similarity_plan(distinct, similarity, miss)
    found = materialise(candidates(distinct, chosen, most, similarity, block_rows), "near-candidates")
    pairs = materialise(near_pairs(found, distinct, similarity), "near-pairs")
    stars = found.where("bucket != 0")
    ends = pairs.select("u", "v").unionByName(stars.select("u", "v")).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = materialise(distinct.select("digest", "node").join(ends, "node"), "near-wanted")
    ids = wanted.select(F.col("node").alias(id_col)).distinct()
    ids = F.broadcast(ids) if wanted.count() <= small else ids.hint("merge")
    texts = set_rows(docs.select(id_col, text_col).join(ids, id_col, "left_semi"), width, id_col, text_col, whole=True)
    sets = materialise(texts.join(wanted, "digest").groupBy("digest", "node").agg(F.first("hashes").alias("hashes")), "near-sets")
    least = pairs.groupBy("v").agg(F.min("u").alias("u"))
    first = materialise(alike(least, sets, similarity), "near-first")
    labels = components(first, "near-labels")
    one, two = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
    open_ = pairs.join(one, "u", "left").join(two, "v", "left").where("coalesce(ru, u) != coalesce(rv, v)").select("u", "v")
    rest = open_.unionByName(rest_of_stars(stars, labels, distinct, similarity, block_rows)).distinct()
    rest = materialise(alike(rest, sets, similarity), "near-rest")
    linked = components(first.unionByName(rest), "near-links")
    classes = distinct.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return rows.select("doc_id", "digest").join(classes, "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each class of similar_texts the row of the smallest id stays.

    Rows without an id stay; of repeated rows of the kept id all stay.
    """
    classes = similar_texts(docs, width, similarity, id_col, text_col)
    drop = classes.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drop.hint("merge"), id_col, "left_anti")  # grows with docs: never broadcast
