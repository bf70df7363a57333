"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()


def local_session(cores: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session for tests and the local bench; on a cluster the caller passes its own."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("scenemark")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCENEMARK_DRIVER_MEMORY", "12g"))
        # small local inputs still use all cores in CPU-heavy stages
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.  A temporary folder stands in for it only
    where driver and executors are one process; elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="scenemark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/scenemark-{uuid.uuid4().hex}-{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for made in getattr(_local, "made", []):
        made.append(path)
    return path


@contextmanager
def scratch_of() -> Iterator[list[str]]:
    """The list of the scratch paths that this thread makes inside the block."""
    made: list[str] = []
    _local.made = [*getattr(_local, "made", []), made]
    try:
        yield made
    finally:
        _local.made = _local.made[:-1]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables early, for callers that need no result built on them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Parquet for rows of megabytes: a row group each, since a reader holds up to a row group's rows at once.
HEAVY = {"parquet.block.size": "1048576", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, name: str = "table", heavy: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here,
    lost executors cost no recomputation, and the planner knows the table's size."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**(HEAVY if heavy else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside the block: a batch is held by
    the JVM, on the way and by Python at once, and rows of long texts make default ones heavy."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that it is computed once and
    survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_partitions(df: DataFrame) -> int:
    """Partitions for a CPU-heavy stage: never fewer than the cores at hand, and at scale
    the session's shuffle setting.  An explicit number is not coalesced away by AQE."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a table scan that has fewer splits than cores before CPU-heavy
    expressions; scans of large tables are left alone.  Only for plain scans."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
