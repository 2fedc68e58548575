"""The archive: typed tables read from and written to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelgraph.functions.text import any_has_text, own_excerpt
from channelgraph.schemas import FWD_FROM, MEDIA, TABLES
from channelgraph.session import plain_unions

# Rows that are read together lie together; a hot key still spreads over several files.
CLUSTERING = {
    "messages": ("peer_external_id", "date"),
    "slim_messages": ("peer_external_id", "date"),
    "image_blob_messages": ("phash", "message_date"),
    "forward_edge_messages": ("from_external_id", "message_date"),
}


class Catalog:
    """Archive tables under one root. Attribute access gives the table as a DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        plain_unions(spark)
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def __getattr__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise AttributeError(table)
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))


def load_catalog(spark: SparkSession, root: str) -> Catalog:
    return Catalog(spark, root)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's schema; columns the input lacks become null.

    What messages store about their text always follows from the text they carry.
    """
    if table in ("messages", "slim_messages"):
        df = df.withColumns({"has_text": any_has_text(df.columns), "excerpt": own_excerpt(df.columns)})
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )


def clustered(df: DataFrame, table: str, parts: int | None = None) -> DataFrame:
    """Lay rows out by the table's keys. Ranges split a hot key over several files, which hashing would not.

    ``parts`` is for rows whose bytes say little of the work that follows; else Spark goes by their size.
    """
    keys = CLUSTERING.get(table)
    return df.repartitionByRange(*([parts] if parts else []), *keys) if keys else df


def write_table(df: DataFrame, root: str, table: str, is_clustered: bool = False) -> str:
    """Write one archive table, big ones clustered so that row groups can be skipped.

    ``is_clustered`` says that the rows lie in their ranges already and only need sorting.
    """
    out = conform(df, table)
    keys = CLUSTERING.get(table)
    if keys:
        out = (out if is_clustered else clustered(out, table)).sortWithinPartitions(*keys)
    path = f"{root.rstrip('/')}/{table}"
    out.write.mode("overwrite").parquet(path)
    return path


def parse_messages(raw: DataFrame) -> DataFrame:
    """Parse the two JSON columns once into typed structs; JSON null and absent both become null."""
    return raw.withColumns(
        {"fwd_from": F.from_json("fwd_from", FWD_FROM), "media": F.from_json("media", MEDIA)}
    )
