"""Tables kept beside messages that are stored by month, rewritten for the months that a delivery touches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.operators.merge import write_back
from channelgraph.schemas import SLIM_MESSAGES
from channelgraph.session import drop_settled, settle

STORED = T.StructType([*SLIM_MESSAGES.fields, T.StructField("month", T.StringType())])


class SideTable:
    """A table at ``root`` made from the messages stored by month at ``messages``.

    A subclass names its ``schema`` (the month included) and ``order`` and says how ``rows`` come from messages. The first
    column of the schema is never null in them: a row without it stands for a month that has no others.
    """

    schema: str
    order: tuple[str, ...]

    def __init__(self, spark: SparkSession, messages: str, root: str):
        self.spark, self.messages, self.root = spark, messages, root

    def rows(self, messages: DataFrame) -> DataFrame:
        raise NotImplementedError

    def stored(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.messages)

    def table(self) -> DataFrame:
        first = self.schema.split()[0]
        return self.spark.read.schema(self.schema).parquet(self.root).filter(F.col(first).isNotNull())

    def rebuild(self) -> None:
        """All months."""
        self.refresh(r["month"] for r in self.stored().select("month").distinct().collect())

    def refresh(self, months: Iterable[str]) -> None:
        """Write the given months anew; every other folder stays as it is."""
        names = sorted(months)
        rows = self.rows(self.stored().filter(F.col("month").isin(names)))
        marks = self.spark.createDataFrame([(n,) for n in names], "month string")
        fresh = settle(rows.unionByName(marks, allowMissingColumns=True), "side-table")
        # ranges split a key that very many rows have over several files
        laid = fresh.repartitionByRange("month", *self.order).sortWithinPartitions("month", *self.order)
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.root)
        drop_settled(fresh)

    def write_back(self, delta: DataFrame, order: str | None = None, strict_kind: bool = True) -> list[str]:
        """Merge a delivery into the messages and refresh the months it touched. Returns these months."""
        months = write_back(self.spark, self.messages, delta, order, strict_kind)
        names = sorted(r["month"] for r in months.collect())  # one string per month of history
        self.refresh(names)
        return names
