"""Intermediate tables of one operator call, removed when the call ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a few numbers up to which a join side is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch between Spark and its Python workers; one larger row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes the shuffle files of each job's query when it ends, instead of when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow it. For narrow tables only."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Folder below ``spark.checkpoint.dir`` for the tables between the jobs of one operator.

    Tables are written and read back, so a lost executor costs a retry of one job and not of the
    whole lineage. ``result`` writes a table that stays after the folder has been removed. As every table is written
    out, shuffle files are of no use once their query has ended, and go then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> "Scratch":
        # Batches of texts are held by the executor and by its Python workers at the same time.
        self._before = {key: self.spark.conf.get(key, None) for key in (_BATCH, _TIDY)}
        self.spark.conf.set(_BATCH, str(BATCH_BYTES))
        self.spark.conf.set(_TIDY, "true")
        return self

    def __exit__(self, *error) -> None:
        for key, value in self._before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
        delete(self.spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = table, path
        return table

    def observed(self, df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, tuple]:
        """``stage`` and the values of aggregates over the rows, taken while they are written."""
        seen = Observation()
        table = self.stage(df.observe(seen, *(f.alias(f"f{i}") for i, f in enumerate(facts))), name)
        return table, tuple(seen.get[f"f{i}"] for i in range(len(facts)))

    def drop(self, *tables: DataFrame) -> None:
        """Remove staged tables from which all that is needed has been staged; others stay as they are."""
        for table in tables:
            if id(table) in self._paths:
                delete(self.spark, self._paths.pop(id(table))[1])

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
