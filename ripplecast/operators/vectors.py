"""Embeddings and filtered similarity search, for many queries at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import stored


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, where body names it in an inner function."""
    return F.transform(F.array(value), body)[0]


def digest_embedding(text: Column, dims: int = 384) -> Column:
    """V1: bytes b of a chain of SHA-256 digests as b / 255 * 2 - 1, ``dims`` of them, at unit length."""
    start = F.struct(F.sha2(text, 256).alias("last"), F.sha2(text, 256).alias("whole"))

    def longer(s: Column, _: Column) -> Column:
        return _let(F.sha2(F.unhex(s["last"]), 256), lambda h: F.struct(h.alias("last"), F.concat(s["whole"], h).alias("whole")))

    chain = F.aggregate(F.sequence(F.lit(1), F.lit(-(-dims // 32) - 1)), start, longer, lambda s: s["whole"])
    byte = lambda h: F.split(F.decode(F.unhex(F.substring(h, 1, 2 * dims)), "ISO-8859-1"), "")  # noqa: E731  # a character a byte, cut in one pass
    raw = lambda h: F.transform(byte(h), lambda c: F.ascii(c).cast("double") / 255 * 2 - 1)
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return _let(chain, lambda h: _let(raw(h), lambda r: _let(norm(r), lambda n: F.transform(r, lambda x: x / n))))


def code_text(code: Column, language: Column) -> Column:
    """V2: the code with its language in front."""
    return F.concat(F.lit("["), F.coalesce(language, F.lit("unknown")), F.lit("]"), code)


def commit_text(message: Column, author: Column, regression: Column, rollback: Column, diff: Column, most: int = 4000) -> Column:
    """V4: labelled lines and the first ``most`` characters of the diff, where there is one."""
    said = lambda c: F.when(c, "True").otherwise("False")
    head = (F.concat(F.lit("Commit: "), message), F.concat(F.lit("Author: "), author), F.concat(F.lit("Regression: "), said(regression)), F.concat(F.lit("Rollback: "), said(rollback)))
    return F.concat_ws("\n", *head, F.when(diff != "", F.substring(diff, 1, most)))


def issue_text(title: Column, kind: Column, state: Column) -> Column:
    """V5."""
    return F.concat(title, F.lit("\nType: "), kind, F.lit("\nState: "), state)


def upsert(points: DataFrame, batch: DataFrame) -> DataFrame:
    """Points with those of batch (vec_id, place ...) in their stead; of one id the last place wins."""
    last = batch.withColumn("__n", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("place")))).where("__n = 1").drop("__n", "place")
    return points.join(last.select("vec_id"), "vec_id", "left_anti").unionByName(last)


def matches_all(filters: dict[str, object]) -> Column:
    """Every named payload column equals its value; null equals nothing."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(k) == v, F.lit(False)) for k, v in filters.items()), F.lit(True))


def delete_matching(points: DataFrame, filters: dict[str, object]) -> DataFrame:
    """S8."""
    return points.where(~matches_all(filters))


def unindexed(entities: DataFrame, manifest: DataFrame, cap: int = 500, reindex: bool = False) -> DataFrame:
    """V6, V7: the newest ``cap`` entities of a repository (repository_id, entity_id, day_s) that the manifest lacks; with reindex all of these."""
    place = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("day_s"), "entity_id"))
    rows = entities.withColumn("__n", place).where(F.col("__n") <= cap).drop("__n")
    return rows if reindex else rows.join(manifest.select("repository_id", "entity_id"), ["repository_id", "entity_id"], "left_anti")


def _packed(rows: DataFrame, keys: list[str], id_col: str, vector_col: str, block_rows: int) -> DataFrame:
    """(keys, block, ids, vectors): rows of a key in blocks of about block_rows, each one packed row: ids and unit vectors as bytes, ids ascending."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    schema = dealt.select(*keys, "block").schema

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        x = _unit(np.stack(table.column("vector").to_numpy()[by]).astype(float)) if len(ids) else np.zeros((0, 0))
        one = {c.name: table.column(c.name)[:1] for c in schema}
        return pa.table(one | {"ids": pa.array([ids[by].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())})

    kind = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in schema) + ", ids binary, vectors binary"
    return dealt.select(*keys, "block", F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).groupBy(*keys, "block").applyInArrow(pack, kind)


def packed_queries(queries: DataFrame, keys: list[str], query_rows: int = 8192) -> DataFrame:
    """Queries (query_id, embedding and ``keys``) as ``top_k`` takes them: packed and stored once, however many sets of points they are asked of."""
    return stored(_packed(queries.select(*keys, "query_id", "embedding"), keys, "query_id", "embedding", query_rows).withColumnRenamed("block", "query_block"), "search-queries")


def top_k(points: DataFrame, queries: DataFrame, keys: list[str], k: int = 10, query_rows: int = 8192, block_rows: int = 4096, band: int = 64) -> DataFrame:
    """V9: (query_id, vec_id, similarity, rank) of the k most similar points that agree with the query on ``keys``.

    queries: query_id, embedding and the keys, or what ``packed_queries`` made of them.

    The points of a key lie in blocks of about block_rows and its queries in blocks of query_rows, each one packed row. A block of queries
    meets the blocks of points in bands of ``band``: a band's task holds its queries, reads its points a block at a time, compares both by a
    matrix product and keeps the best k so far. So no task holds more than one tile, however many queries or points a key
    has; points travel once a block of queries, and k rows a query and band meet in the final ranking. Ties go to the smaller id.
    """
    own = stored(_packed(points.select(*keys, "vec_id", "embedding"), keys, "vec_id", "embedding", block_rows).withColumn("band", F.floor(F.col("block") / band).cast("int")), "search-points")
    asked = queries if "query_block" in queries.columns else packed_queries(queries, keys, query_rows)
    order = [*keys, "query_block", "band"]
    first = asked.join(own.select(*keys, "band").distinct(), keys).select(*order, F.lit(-1).alias("block"), "ids", "vectors")
    rest = own.join(asked.select(*keys, "query_block"), keys).select(*order, "block", "ids", "vectors")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])

    def better(x: np.ndarray, best: tuple[np.ndarray, np.ndarray] | None, y: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.round(x @ y.T, 9)
        of = np.broadcast_to(ids, near.shape)
        if near.shape[1] > 4 * k:  # the k best, and what ties with the last of them
            floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            most = int((near >= floor[:, None]).sum(axis=1).max())
            keep = np.argpartition(-near, most - 1, axis=1)[:, :most]
            near, of = np.take_along_axis(near, keep, axis=1), np.take_along_axis(of, keep, axis=1)
        if best is not None:
            near, of = np.concatenate([best[0], near], axis=1), np.concatenate([best[1], of], axis=1)
        by = np.lexsort((of, -near), axis=1)[:, :k]
        return np.take_along_axis(near, by, axis=1), np.take_along_axis(of, by, axis=1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(b.schema.names, (c[j].as_py() for c in b.columns), strict=True)) for b in batches for j in range(b.num_rows))
        for _, tiles in itertools.groupby(rows, lambda r: tuple(r[c] for c in order)):
            head = next(tiles)
            ids = np.frombuffer(head["ids"], "<i8")
            x = np.frombuffer(head["vectors"]).reshape(len(ids), -1)
            parts = [slice(j, j + 1024) for j in range(0, len(ids), 1024)]
            best = [None] * len(parts)
            for tile in tiles:
                of = np.frombuffer(tile["ids"], "<i8")
                y = np.frombuffer(tile["vectors"]).reshape(len(of), -1)
                best = [better(x[part], had, y, of) for part, had in zip(parts, best, strict=True)]
            for part, (near, of) in zip(parts, best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], near.shape[1])), pa.array(of.ravel()), pa.array(near.ravel())], schema=schema)

    tiles = first.unionByName(rest).repartition(*order).sortWithinPartitions(*order, "block")
    found = tiles.mapInArrow(compare, "query_id long, vec_id long, similarity double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def approximate_top_k(points: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, sample_rows: int = 8192, recall: float = 0.95) -> DataFrame:
    """As V9 without keys, among the points of the ``probes`` lists nearest to the query.

    Lists are k-means centres of at most sample_rows unit vectors, about the square root of the number of points, and every point is
    in the list of its nearest centre. Without ``probes`` as many lists are looked into as give 256 rows of the sample
    that share of their k nearest in the sample.
    """
    n = points.count()
    lists = lists or max(1, min(1024, int(n**0.5)))
    sample = points.select("embedding").orderBy(F.xxhash64("vec_id")).limit(sample_rows).toArrow()["embedding"].to_pylist()
    sample = _unit(np.array(sample, float))
    centres = _centres(sample, lists)
    probes = min(len(centres), probes or _probes(sample, centres, k, recall))

    def nearest(width: int):
        @F.pandas_udf("array<int>")
        def lists_of(vectors: pd.Series) -> pd.Series:
            return pd.Series(list(np.argsort(-(_unit(np.stack(vectors).astype(float)) @ centres.T), axis=1, kind="stable")[:, :width].astype(np.int32)))

        return lists_of

    placed = points.select("vec_id", "embedding", nearest(1)("embedding")[0].alias("list"))
    asked = queries.select("query_id", "embedding", F.explode(nearest(probes)("embedding")).alias("list"))
    return top_k(placed, asked, ["list"], k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, rows: int = 256) -> int:
    """How many lists, from the nearest on, hold the share ``recall`` of the k nearest of the first rows of x."""
    own, near = x[:rows], x @ centres.T
    s = own @ x.T
    s[np.arange(len(own)), np.arange(len(own))] = -np.inf
    best = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-near[: len(own)], axis=1), axis=1)
    at = np.take_along_axis(place, near.argmax(axis=1)[best], axis=1)
    return int(np.quantile(at, recall, method="higher")) + 1 if at.size else len(centres)


def _centres(x: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit k-means centres of the rows of x by cosine."""
    x = _unit(x)
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def model_embedding(texts: DataFrame, dims: int = 256) -> DataFrame:
    """V3: (doc_id, vector): hashed term weights at unit length, the built-in stand-in for a sentence model."""
    words = Tokenizer(inputCol="text", outputCol="words").transform(texts.fillna({"text": ""}))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=dims).transform(words)
    idf = IDF(inputCol="tf", outputCol="raw").fit(tf).transform(tf)
    return Normalizer(inputCol="raw", outputCol="v").transform(idf).select("doc_id", vector_to_array("v").alias("vector"))


def encode_with(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch_rows: int = 256) -> DataFrame:
    """V3: (doc_id, vector) at unit length by a model of one's own: ``load`` runs once a task and gives a function from texts to rows."""

    @F.pandas_udf("array<double>")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            said = part.fillna("").tolist()
            rows = [_unit(np.asarray(encode(said[k : k + batch_rows]), float)) for k in range(0, len(said), batch_rows)]
            yield pd.Series(list(np.concatenate(rows)) if rows else [])

    return texts.select("doc_id", vector("text").alias("vector"))


def historical_hits(found: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with their payload; those without a sha are dropped, a missing flag is false."""
    payload = points.select("vec_id", "commit_sha", F.coalesce("is_regression", F.lit(False)).alias("is_regression"))
    return found.join(payload.where("commit_sha is not null"), "vec_id").select("query_id", "vec_id", "commit_sha", "similarity", "is_regression", "rank")
