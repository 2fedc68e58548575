"""An append-only table that a streaming query writes one partition per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchLog:
    """Parquet folder partitioned by ``batch_id``, and by ``bucket`` above it where the schema has that column.

    A batch that runs again after a failure overwrites its own partitions, and readers inside a batch look only at
    earlier ones, so every batch counts once. A filter on buckets leaves the folders of all others out.

    ``compact`` puts the batches before a cutoff into one, in a new generation of the folder. A generation counts from the
    moment its mark is written. A writer looks at the generation again after each write and repeats the write where a new
    one has appeared; ``compact`` in turn carries over, after the mark, what was committed to the old one meanwhile. So
    whichever comes first, no batch is lost. The old generation stays for readers until the next compaction.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.root, self.columns = spark, path, schema.fieldNames()
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self.parts = ["bucket", "batch_id"] if "bucket" in self.columns else ["batch_id"]
        if self._current() is None:
            self._save(spark.createDataFrame([], self.schema), self._folder(0), "static")

    @property
    def generation(self) -> int:
        """The newest generation that has its mark; other writers may have made it."""
        return self._current() or 0

    def _current(self) -> int | None:
        return max((g for g in self._generations() if self._exists(f"{self._folder(g)}/_SUCCESS")), default=None)

    def write(self, df: DataFrame, batch_id: int) -> None:
        rows = df.select(*self.columns).withColumn("batch_id", F.lit(batch_id).cast("long"))
        while True:
            generation = self.generation
            self._save(rows, self._folder(generation), "dynamic")
            if self.generation == generation:
                return

    def newest(self) -> int | None:
        """The newest batch, the only one that can run again."""
        return self.all().agg(F.max("batch_id")).first()[0]

    def before(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        rows = self.all().filter(F.col("batch_id") < batch_id)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(self.generation))

    def compact(self, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows, cutoff: int | None = None) -> None:
        """Puts the batches before ``cutoff`` (the newest where it is None) into one.

        ``fold`` may put their rows together, as long as readers cannot tell the difference.
        """
        cutoff = self.newest() if cutoff is None else cutoff
        if cutoff is None:
            return
        before = self.generation
        held = self.spark.read.schema(self.schema).parquet(self._folder(before))
        carried = [r[0] for r in held.filter(F.col("batch_id") >= cutoff).select("batch_id").distinct().collect()]
        old = fold(held.filter(F.col("batch_id") < cutoff)).select(*self.columns).withColumn("batch_id", F.lit(cutoff - 1).cast("long"))
        rows = old.unionByName(held.filter(F.col("batch_id").isin(carried)))
        target = self._folder(before + 1)
        self._save(rows.repartitionByRange(*self.parts, F.xxhash64(*self.columns)), target, "static")
        # what was committed to the old generation before the mark of the new one was there
        fresh = self.spark.read.schema(self.schema).parquet(self._folder(before)).filter((F.col("batch_id") >= cutoff) & ~F.col("batch_id").isin(carried))
        self._save(fresh, target, "dynamic")
        for generation in self._generations():
            if generation < before:
                self._files(self.root).delete(self._path(self._folder(generation)), True)

    def _save(self, df: DataFrame, folder: str, mode: str) -> None:
        """A static write ends with the mark of a whole generation; a dynamic one replaces its own partitions only."""
        df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*self.parts).parquet(folder)

    def _folder(self, generation: int) -> str:
        return f"{self.root}/g{generation:06d}"

    def _generations(self) -> list[int]:
        if not self._exists(self.root):
            return []
        names = [s.getPath().getName() for s in self._files(self.root).listStatus(self._path(self.root))]
        return [int(n[1:]) for n in names if n.startswith("g")]

    def _exists(self, name: str) -> bool:
        return self._files(name).exists(self._path(name))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
