"""Tables that are kept and changed in place: by key, and as a log that a killed job leaves whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.tables import upsert

BUCKET = "__bucket"


class KeyedTable:
    """Rows by key, hash-partitioned into folders, of which a merge rewrites only those that its keys fall into.

    keys may be a part of what tells rows apart, such as the archive of an entry: a merge then replaces all rows of the
    keys that it brings. One writer at a time; readers see each folder as it was or as it is. Take as many buckets as
    a usual merge has keys times a hundred, and rows enough in each for a file.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str, buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        out = rows.repartition(BUCKET).write.mode(mode).partitionBy(BUCKET)
        out.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """A new table; a path that exists is refused."""
        self._write(self._dealt(rows), "errorifexists")

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def merge(self, new: DataFrame) -> int:
        """New rows, and old rows of keys that aren't among theirs. Returns how many folders were rewritten.

        Rows of a key that aren't in any folder yet make one. The numbers of the folders, of which there are `buckets` at
        most, are all that passes through the driver; the other folders are neither read nor written.
        """
        dealt = self._dealt(new)
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]
        if touched:
            old = self._stored()
            old = old.filter(F.col(BUCKET).isin(touched))
            self._write(upsert(old, dealt.select(*old.columns), *self.keys), "overwrite")
        return len(touched)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_logged(todo: DataFrame, work: Callable, schema: str, log: str, state: str, flush: int = 500, files: int | None = None) -> None:
    """Work through todo and log each row's result once, in steps that stay when the job dies.

    work takes and gives pandas frames in batches (as in mapInPandas) and gives the log's rows. todo is written down first,
    once, in files of at most flush rows; then a step takes `files` of them (one a core, if not given), and its log rows appear together
    when it ends. After a crash the same call goes on behind the last whole step. Rows of the step that broke off are
    worked on again, so work must bear that; their log rows appear once all the same. Read the log with
    spark.read.parquet(log). The folders log and state must be shared by the cluster and kept together.
    """
    spark = todo.sparkSession
    staged = f"{state}/todo"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        todo.write.mode("overwrite").option("maxRecordsPerFile", flush).parquet(staged)
    step = files or spark.sparkContext.defaultParallelism
    rows = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", step).parquet(staged)
    out = rows.mapInPandas(work, schema).writeStream.format("parquet").option("path", log).option("checkpointLocation", f"{state}/steps")
    out.trigger(availableNow=True).start().awaitTermination()
