import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("row", "rank", "key", "run", "sha", "node", "value", "group", "_bucket", "bucket", "words", "_words", "score", "copy", "place", "id", "th", "kept")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, **more):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df

    return make


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit(f"own-{c}").alias(c) for c in CLASHING if c not in df.columns])

    return add


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """A folder of tables written from data frames."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
