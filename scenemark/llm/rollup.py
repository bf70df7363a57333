"""Token-count rollups maintained by deltas.

A batch of changes is signed rows: an insert counts +1, a delete -1, a revision both.  Each batch
is summed to (source, lang, version) before it is written, to a folder of its own that counts
only once its job has succeeded; a batch that comes again is found there and skipped, and one
that broke off is written anew.  ``compact`` makes a base of all batches there are; the base
lists their numbers, so a batch that comes late, after ones with larger numbers, is neither
lost nor counted twice.  Totals add the batches that the newest base does not list to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows that add ``counts`` (source, lang, version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take ``counts`` away."""
    return inserts(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace the counts ``before`` by ``after``."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """A store of committed batches, numbered upwards by the caller."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((folder, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        """Numbers of the committed folders of a kind, ascending."""
        if not self._fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        found = [n for n in names if n.startswith(f"{kind}-") and self._fs.exists(self._path(n, "_SUCCESS"))]
        return sorted(int(n.rpartition("-")[2]) for n in found)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return total.filter("docs <> 0 OR tokens <> 0")

    def _base(self) -> tuple[int | None, set[int]]:
        """The newest base and the numbers of the batches in it."""
        base = max(self._done("base"), default=None)
        if base is None:
            return None, set()
        return base, {r.batch for r in self.spark.read.schema("batch long").parquet(f"{self.folder}/within-{base}").collect()}

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Write a batch of signed rows; False where it was committed before (also in a base)."""
        if batch in self._done("batch") or batch in self._base()[1]:
            return False
        self._summed(changes).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens); groups that came down to nothing are left out.
        NULL sources, languages and versions are groups of their own; an empty store gives
        no rows."""
        base, within = self._base()
        parts = [f"base-{base}"] if base is not None else []
        parts += [f"batch-{b}" for b in self._done("batch") if b not in within]
        schema = "source string, lang string, version string, docs bigint, tokens bigint"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self._summed(self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in parts]))

    def compact(self) -> None:
        """Make a base of everything committed so far; earlier folders may then be deleted.  Bases
        are numbered one by one; the list of a base is written first, so a base that counts has one."""
        base, within = self._base()
        every = sorted(within.union(self._done("batch")))
        if len(every) > len(within):
            new = 0 if base is None else base + 1
            self.spark.createDataFrame([(b,) for b in every], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/within-{new}")
            self.totals().write.mode("overwrite").parquet(f"{self.folder}/base-{new}")
