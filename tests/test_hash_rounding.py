"""Grey values of drawn vectors are rounded from single precision, as the oracle's are."""

from types import SimpleNamespace

from compare import connect, differences

from channelgraph.plans.queries import QUERIES
from oracles import all_oracles


def test_a_grey_value_between_two_numbers(spark):
    """Component 55 of vector 450 gives 158.5 in single precision and a little less in double precision."""
    folder = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert vectors.filter("vec_id = 450 AND round(CAST(embedding[55] * 255D AS DOUBLE) + 128D) = 158").count() == 1
    found = QUERIES["v11_hash_images"](SimpleNamespace(source=SimpleNamespace(embeddings=vectors)))
    assert differences(found, connect(folder), all_oracles()["v11_hash_images"]) == []
