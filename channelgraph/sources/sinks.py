"""Text sinks: CSV and JSON Lines in the forms the exports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true", "nullValue": "", "emptyValue": "", "escape": '"', "lineSep": "\n", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def iso_text(ts: Column) -> Column:
    """ISO 8601 in UTC; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def text_cell(c: Column, kind: T.DataType) -> Column:
    """The text of one CSV cell. Missing values become empty when written."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(c)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as text, in the given order."""
    return df.select(*[text_cell(F.col(c), df.schema[c].dataType).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], partition: str | None = None) -> None:
    """CSV files with minimal quoting. ``partition`` gives one folder per value; the column leaves the rows then."""
    out = as_text(df, columns)
    if partition is not None:
        out = out.withColumn(f"by_{partition}", F.col(partition))
    writer = out.write.mode("overwrite").options(**CSV_OPTIONS)
    (writer.partitionBy(f"by_{partition}") if partition else writer).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text; nested values stay nested."""
    stamps = (T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            iso_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, stamps) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    """JSON Lines that keep fields without value as null."""
    writer = json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_partitioned(df: DataFrame, path: str, by: str = "peer_type") -> None:
    """One Parquet folder per value."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
