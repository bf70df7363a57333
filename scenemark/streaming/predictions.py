"""RES-2: predictions that arrive as files are appended once each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from scenemark import schemas

#: State buckets, over which keys are dealt by hash; fixed for the life of a checkpoint.
BUCKETS = 64
KEY, BUCKET, KNOWN = "stream_key__", "stream_bucket__", "stream_known__"
#: State in RocksDB, on disk; a batch writes down what it changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class FirstOfKey(StatefulProcessor):
    """Passes the first row of every key on; a bucket's keys are a map in RocksDB, on disk.  A key
    expires ``ttl`` milliseconds after it was seen (None: never)."""

    def __init__(self, columns: list[str], ttl: int | None):
        self.columns, self.ttl = columns, ttl
        self.given = [*columns, KEY, BUCKET]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "k string", "v boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if part.empty:  # a bucket with an initial state and no rows
                continue
            part.columns = self.given  # names that start with an underscore come changed
            new = []
            for k in part[KEY]:
                new.append(not self.seen.containsKey((k,)))
                if new[-1]:
                    self.seen.updateValue((k,), (True,))
            yield part.loc[new, self.columns]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for k in initialState[KEY] if not initialState.empty else ():
            self.seen.updateValue((k,), (True,))

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """KEY: a digest of the key columns, NULLs told from texts; BUCKET: where it is kept."""
    name = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
    return df.withColumn(KEY, name).withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))


def read_sink(spark: SparkSession, sink: str, schema: str | StructType) -> DataFrame:
    """What streams have appended; filters on the partition column prune folders."""
    kinds = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(sink).select(*kinds.fieldNames())


def _known_keys(spark: SparkSession, sink: str, kinds: StructType, key: tuple[str, ...], checkpoint: str) -> str:
    """Folder with the keys that were in the sink when the checkpoint began: written once, whole."""
    path = f"{checkpoint}/known"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        read_sink(spark, sink, kinds).select(*key).write.mode("overwrite").parquet(path)
    return path


def _new_rows(batch: DataFrame, known: str, kinds: StructType) -> DataFrame:
    """Rows of a first batch, which brings the keys of the sink too: without these keys, and without
    the rows that came before the key's own."""
    keys = batch.sparkSession.read.schema(kinds).parquet(known)
    keys = keys.select(*[F.col(c).alias(f"{KNOWN}{c}") for c in keys.columns])
    same = [F.col(c).eqNullSafe(F.col(f"{KNOWN}{c}")) for c in kinds.fieldNames()]
    return batch.join(keys, reduce(Column.__and__, same), "left_anti")


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that stays with a checkpoint and that no later one gets."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    there = fs.open(path)
    run = there.readUTF()
    there.close()
    return run


def stream_predictions(
    spark: SparkSession,
    path: str,
    sink: str,
    checkpoint: str,
    schema: str = schemas.PREDICTIONS,
    key: tuple[str, ...] = ("model", "perspective", "image_id", "question_id"),
    files_per_batch: int = 100,
    ttl: int | None = None,
) -> StreamingQuery:
    """File-source stream over JSON lines into a parquet sink (see ``read_sink``) partitioned by
    the first key column; stops when all files are in.

    Keys seen so far are the stream's state, so a batch costs what it brings.  A stream without a
    checkpoint, as after its loss, starts from the keys in the sink, which it reads once: they
    come as a second source, all in the first batch.  Each batch has a folder of its own, named
    by checkpoint and number, so a replayed batch writes the same again.  With ``ttl`` a key is
    forgotten so many milliseconds after it came, which bounds the state where files do not
    come again; such keys are kept in a state with expiry, row by row."""
    kinds = spark.createDataFrame([], schema).schema
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", files_per_batch).json(path)
    run = _run_of(spark, checkpoint)
    names = StructType([kinds[c] for c in key])
    if ttl:
        known = _keyed(read_sink(spark, sink, kinds).select(*key), key).select(KEY, BUCKET).distinct().groupBy(BUCKET)
        fresh = _keyed(source, key).groupBy(BUCKET).transformWithStateInPandas(FirstOfKey(kinds.fieldNames(), ttl), kinds, "Append", "ProcessingTime", known)
    else:
        there = _known_keys(spark, sink, kinds, key, checkpoint)
        known = spark.readStream.schema(names).parquet(there).withColumn(KNOWN, F.lit(True))
        fresh = source.withColumn(KNOWN, F.lit(False)).unionByName(known, allowMissingColumns=True).dropDuplicates(list(key))

    def append(batch: DataFrame, number: int) -> None:
        if not ttl:
            batch = batch.filter(~F.col(KNOWN)).drop(KNOWN)
            batch = _new_rows(batch, there, names) if number == 0 else batch
        batch.write.mode("overwrite").partitionBy(key[0]).parquet(f"{sink}/batch={run}-{number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        return fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
