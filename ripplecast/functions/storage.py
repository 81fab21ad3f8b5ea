"""Tables between the steps of iterative queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplecast-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver's garbage is collected."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by their names and lengths alone; 0 if it reads none."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


@contextmanager
def small_tasks(spark: SparkSession, size: str = "16m", reads: DataFrame | None = None, each: int = 1 << 22) -> Iterator[None]:
    """What runs inside is dealt into tasks of about ``size`` of shuffled bytes, which compression can make thirty times as many bytes in memory.

    ``reads``: what is worked on. Its files are read in pieces of ``size`` too, and a shuffle has a partition for ``each`` 4 MB of them at least, so
    that tasks stay small where a fixed number of partitions would grow with the files; less where more is shuffled than read.
    """
    with ExitStack() as held:
        held.enter_context(_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size))
        if reads is not None:
            most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), file_bytes(reads) // each)
            held.enter_context(_setting(spark, "spark.sql.files.maxPartitionBytes", size))
            held.enter_context(_setting(spark, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(most)))
        yield


def stored(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage durably.

    ``replaces``: a stored table that nothing but df was made from; it is deleted once df is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if replaces is not None:
        discard(replaces)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        if getattr(df, "stored_at", None):
            spark = df.sparkSession
            old = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """As ``stored``, in as many buckets of ``keys`` as a shuffle has partitions, so that joins on these keys read it without a shuffle."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(n, *keys).write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 1 in the order of its key, by ranges: no task gets more than a range of a key.

    Rows are dealt into ranges of (keys, order) and stored, so that a range is the same when read again; places inside a range
    are moved on by the rows of the key's ranges before it.
    """
    part, before = "__part", "__before"
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn(before, F.sum("__n").over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(part)) - F.col("__n")).drop("__n")  # a row a range
    local = F.row_number().over(W.partitionBy(*keys, part).orderBy(*order))
    same = [ranged_key.eqNullSafe(sizes_key) for ranged_key, sizes_key in ((F.col(f"a.{k}"), F.col(f"b.{k}")) for k in [*keys, part])]
    on = same[0]
    for c in same[1:]:
        on = on & c
    placed = ranged.withColumn(name, local).alias("a").join(F.broadcast(sizes).alias("b"), on)
    return placed.select(*[F.col(f"a.{c}") for c in df.columns if c != name], (F.col(f"a.{name}") + F.col(f"b.{before}")).alias(name))
