"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: No piece holds a space after another character, or a line end; so the lattice falls apart at these.
_CHUNK = re.compile(rb" +[^ \n]*|\n|[^ \n]+")
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


_BASE = np.uint64(0x100000001B3)
_FILTER_BITS = 20
_FEW = 4  # chunks that are better taken one by one
_UNIT = 2.0**28  # of a probability: coarse enough that rounding of sums can't move a draw


def _hash(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the bytes from start to end, ``size`` apart, by prefix sums along the last axis."""
    power = np.uint64(pow(int(_BASE), size, 1 << 64))
    x = sums[..., end] - sums[..., start] * power
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _prefix_sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[0], x.shape[1] + 1), np.uint64)
    for k in range(x.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + x[:, k] + np.uint64(1)
    return out


def _padded(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    out = np.zeros((len(chunks), int(sizes.max())), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
    return out, sizes


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by the hash of their bytes, sorted; rank is the place in the order of merges."""

    known: dict[bytes, tuple[int, int]]  # id and rank
    hashes: np.ndarray
    ids: np.ndarray
    ranks: np.ndarray
    filter: np.ndarray  # by the high bits of a hash, whether a piece has them
    lengths: tuple[int, ...]
    of_byte: np.ndarray
    table: list[bytes]  # of each id
    eights: np.ndarray  # the bytes of each hash, padded, eight to a number


@cache
def vocabulary(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    text = {i: model.id_to_piece(i).replace("▁", " ").encode() for i in plain}
    of_byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
    table = [text.get(i, b"") for i in range(n)]
    for b, i in of_byte.items():
        table[i] = bytes([b])
    x, sizes = _padded(list(text.values()))
    sums, hashes = _prefix_sums(x), np.zeros(len(sizes), np.uint64)
    for size in np.unique(sizes).tolist():
        hashes[sizes == size] = _hash(sums[sizes == size], 0, size, size)
    by = np.argsort(hashes)
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    known = {t: (i, rank) for rank, (i, t) in enumerate(text.items())}
    return Vocabulary(known, hashes[by], np.array(plain, np.int32)[by], by, seen, tuple(np.unique(sizes).tolist()), np.array([of_byte[b] for b in range(256)], np.int32), table, np.pad(x[by], ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64))


class Lattices:
    """Filtered lattices of chunks, kept in flat arrays so that many chunks are sampled at once.

    A piece of rank r weighs 1 / (r + 2) to the power alpha, pieces being ranked by the order of
    their merges; characters without a piece are spelled in bytes. Node 0 is the start of any chunk. The
    edges into a node lie together, the likeliest first, with their cumulated probability; so an edge is
    drawn for every node of a batch by stepping from the first, mostly no further than one.
    """

    def __init__(self, path: str, alpha: float, limit: int = 300_000):
        self.pieces, self.alpha, self.limit = vocabulary(path), alpha, limit
        self.ends: dict[bytes, int] = {}
        self.nodes = 0
        self.parts = [(np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int32))]
        self.n_edges = 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cumulated probability, piece, node before) of all edges, and the first edge of each node."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        return self.parts[0]

    def add(self, chunks: list[bytes]) -> None:
        """Forward filtering of new chunks, those of about one length together."""
        by_width: dict[int, list[bytes]] = {}
        for c in chunks:
            by_width.setdefault((len(c) - 1).bit_length(), []).append(c)
        for width, own in by_width.items():
            at_once = max(1, (1 << 16) >> width)
            for k in range(0, len(own), at_once):
                self._filter(own[k : k + at_once])

    def _lattice(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(chunk, start, end, piece, log weight) of every edge."""
        v, sums, inside = self.pieces, _prefix_sums(x), np.arange(x.shape[1]) < sizes[:, None]
        lead = ((x & 0xC0) != 0x80) & inside
        wide = 1 + (x >= 0xC0) + (x >= 0xE0) + (x >= 0xF0)
        bare = lead.copy()  # characters without a piece
        padded = np.pad(x, ((0, 0), (0, 8)))
        eight = np.ndarray((len(x), x.shape[1] + 1), np.uint64, padded, strides=(padded.shape[1], 1))  # the eight bytes from each place on
        found = []
        for size in v.lengths:
            if size > x.shape[1]:
                break
            h = _hash(sums, slice(0, x.shape[1] - size + 1), slice(size, None), size)
            row, at = np.nonzero(v.filter[h >> np.uint64(64 - _FILTER_BITS)] & lead[:, : h.shape[1]])
            h = h[row, at]
            k = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            hit = (v.hashes[k] == h) & (at + size <= sizes[row])
            row, at, k = row[hit], at[hit], k[hit]
            same = np.ones(len(row), bool)
            for j in range(0, size, 8):  # a hash may collide, bytes cannot
                rest = np.uint64((1 << 8 * min(8, size - j)) - 1)
                same &= (eight[row, at + j] & rest) == v.eights[k, j // 8]
            if not same.all():
                row, at, k = row[same], at[same], k[same]
            found.append((row, at, at + size, v.ids[k], -self.alpha * np.log(v.ranks[k] + 2.0)))
            one = wide[row, at] == size
            bare[row[one], at[one]] = False
        for k in range(4):
            row, at = np.nonzero(bare & (wide > k))
            at = at + k
            found.append((row, at, at + 1, v.of_byte[x[row, at]], np.full(len(row), -self.alpha * np.log(len(v.hashes) + 2.0))))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    @staticmethod
    def _shares(first: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Each edge's share of its node's weight, for all chunks at once, place by place; total gets the weights of all places."""
        share = np.zeros(len(row))
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)]))
        cuts = np.searchsorted(end[first], np.arange(1, total.shape[1] + 1))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # nodes of one end
            if a == z:
                continue
            e, f = first[a], first[z] if z < len(first) else len(row)
            heads, own = first[a:z] - e, of[e:f] - a
            value = total[row[e:f], start[e:f]] + weight[e:f]
            top = np.maximum.reduceat(value, heads)
            odds = np.exp(value - top[own])
            mass = np.add.reduceat(odds, heads)
            total[row[first[a:z]], end[first[a:z]]] = top + np.log(mass)
            share[e:f] = odds / mass[own]
        return share

    @staticmethod
    def _shares_one_by_one(first: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The same for a few long chunks, where a place has too few edges to be worth an array: a few microseconds a byte."""
        share = [0.0] * len(row)
        bounds, own, ends, sums = np.r_[first, len(row)].tolist(), row[first].tolist(), end[first].tolist(), total.tolist()
        starts, weights = start.tolist(), weight.tolist()
        for r, at, e, f in zip(own, ends, bounds[:-1], bounds[1:], strict=True):  # nodes by their end
            so_far = sums[r]
            value = [so_far[s] + w for s, w in zip(starts[e:f], weights[e:f], strict=True)]
            top = max(value)
            odds = [math.exp(x - top) for x in value]
            mass = math.fsum(odds)
            so_far[at] = top + math.log(mass)
            for k, x in enumerate(odds, e):
                share[k] = x / mass
        return np.array(share)

    def _filter(self, chunks: list[bytes]) -> None:
        """The summed weight of all segmentations up to each place, in logarithms, and each edge's share of it."""
        x, sizes = _padded(chunks)
        row, start, end, piece, weight = self._lattice(x, sizes)
        by = np.lexsort((start, row, end))
        row, start, end, piece, weight = row[by], start[by], end[by], piece[by], weight[by]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (end[1:] != end[:-1])])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)]))
        total = np.zeros((len(chunks), x.shape[1] + 1))
        node = np.zeros((len(chunks), x.shape[1] + 1), np.int64)
        node[row[first], end[first]] = self.nodes + 1 + np.arange(len(first))
        if len(chunks) <= _FEW:
            share = self._shares_one_by_one(first, row, start, end, weight, total)
        else:
            share = self._shares(first, row, start, end, weight, total)
        by = np.lexsort((-share, of))
        run, piece, before = share[by], piece[by], node[row, start][by].astype(np.int32)
        order = np.arange(len(row)) - first[of]
        for k in range(1, int(order.max()) + 1):
            at = np.flatnonzero(order == k)
            run[at] += run[at - 1]
        run[np.r_[first[1:], len(row)] - 1] = 1
        self.parts.append((np.floor(np.minimum(run, 1) * _UNIT) / _UNIT, piece, before, (self.n_edges + first).astype(np.int32)))
        self.n_edges += len(row)
        self.ends.update(zip(chunks, node[np.arange(len(chunks)), sizes].tolist(), strict=True))
        self.nodes += len(first)

    def encode(self, texts: list[bytes], seeds: list[int]) -> list[np.ndarray]:
        """Ids of each text, sampled by its seed alone.

        Past the limit new chunks are forgotten after the call: those met first hold the frequent ones. What
        is kept is under the limit and one call's chunks.
        """
        ends, sizes = [], []
        for text in texts:
            chunks = _CHUNK.findall(b" " + text) if text else []  # the space that decoding takes off again
            ends += chunks
            sizes.append(len(chunks))
        new, kept = set(ends).difference(self.ends), (self.nodes, self.n_edges)
        if new:
            self.add(sorted(new))
        at = np.fromiter(map(self.ends.__getitem__, ends), np.int64, len(ends))
        cumulated, piece, before, first = self.arrays()
        if new and self.nodes > self.limit and kept[0] > self.limit // 2:
            self.nodes, self.n_edges = kept
            self.parts = [(*(x[: kept[1]] for x in self.parts[0][:3]), first[: kept[0] + 1])]
            for c in new:
                del self.ends[c]
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        state = np.repeat(np.array(seeds, np.uint64), sizes) + place.astype(np.uint64) * _STEPS[0]
        live, drawn, lengths = np.arange(len(at)), [], np.zeros(len(at), np.int64)
        alone: list[tuple[int, int, list[int]]] = []  # chunk, steps before, pieces
        while len(live):
            if len(live) <= _FEW:
                for c in live.tolist():
                    ids = _drawn(int(state[c]), int(at[c]), cumulated, piece, before, first)
                    alone.append((c, len(drawn), ids))
                    lengths[c] += len(ids)
                break
            state[live] += _STEPS[1]
            u = state[live]
            u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((u ^ (u >> np.uint64(31))) >> np.uint64(36)).astype(float) / _UNIT
            edge = first[at[live]]
            on = np.flatnonzero(cumulated[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[cumulated[edge[on]] <= u[on]]
            lengths[live] += 1
            drawn.append((live, piece[edge]))
            at[live] = before[edge]
            live = live[at[live] > 0]
        last = np.cumsum(lengths)
        out = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for step, (rows, ids) in enumerate(drawn):  # drawn from the end backwards
            out[last[rows] - 1 - step] = ids
        for c, step, ids in alone:
            end = int(last[c]) - step
            out[end - len(ids) : end] = ids[::-1]
        upto = np.r_[0, last][np.cumsum(np.r_[0, sizes])] if len(last) else np.zeros(len(sizes) + 1, np.int64)
        return [out[a:z] for a, z in zip(upto[:-1], upto[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.table.__getitem__, ids.tolist()))[1:]


def _drawn(state: int, at: int, cumulated: np.ndarray, piece: np.ndarray, before: np.ndarray, first: np.ndarray) -> list[int]:
    """The pieces of one chunk from its end backwards, drawn as ``Lattices.encode`` draws those of many."""
    ids, whole = [], (1 << 64) - 1
    while at > 0:
        state = (state + int(_STEPS[1])) & whole
        u = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 & whole
        u = (u ^ (u >> 27)) * 0x94D049BB133111EB & whole
        draw = ((u ^ (u >> 31)) >> 36) / _UNIT
        edge = int(first[at])
        while cumulated[edge] <= draw:
            edge += 1
        ids.append(int(piece[edge]))
        at = int(before[edge])
    return ids


@cache
def _lattices(path: str, alpha: float, cache_nodes: int = 300_000) -> Lattices:
    """One a worker process, so that tasks share what is filtered."""
    return Lattices(path, alpha, cache_nodes)


def encode(docs: DataFrame, path: str | None = None, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, cache_nodes: int = 300_000, at_once: int = 200) -> DataFrame:
    """(doc_id, pieces array<int>, n_pieces, lossless) of every row; with digest ids_crc32 in place of pieces.

    A segmentation is drawn with probability in proportion to its pieces' weights, from random numbers fixed
    by seed, id and place in the text: the same row gets the same pieces on any cluster.
    lossless: the pieces, decoded, give back the text's bytes. Null and empty texts have no
    pieces. Rows without id share the id's place in the seed. Repeated rows get equal
    pieces. Further columns are not read. An empty table gives no rows. A worker keeps about cache_nodes nodes of lattices and
    takes ``at_once`` texts together; neither changes a result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    last = "ids_crc32 long" if digest else "pieces array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(path, alpha, cache_nodes)
        for b in batches:
            for k in range(0, b.num_rows, at_once):
                part = b.slice(k, at_once)
                texts = [t.as_py() or b"" for t in part.column(1)]
                ids = lattices.encode(texts, [xxhash.xxh64_intdigest(str(x).encode(), seed) for x in part.column(0).to_pylist()])
                same = [lattices.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                if digest:
                    own = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                else:
                    own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(same), own], names=["doc_id", "n_pieces", "lossless", last.split()[0]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(run), f"doc_id long, n_pieces long, lossless boolean, {last}")


def decode(rows: DataFrame, path: str | None = None, pieces_col: str = "pieces") -> DataFrame:
    """rows with the column ``decoded``: the text of the pieces. Null pieces decode to null."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def text(lists):
        table = vocabulary(path).table
        return lists.map(lambda x: None if x is None else b"".join(table[i] for i in x)[1:].decode())

    return rows.withColumn("decoded", text(F.col(pieces_col)))
