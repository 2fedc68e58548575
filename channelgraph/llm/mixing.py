"""Mixing sources to target weights: Poisson replication.

A source with weight w of ``rows`` rows to draw and n rows of its own has the mean repetition rate w * rows / n. Each
document inverts the Poisson distribution of that mean at a uniform number hashed from the seed and its id, is repeated
that often, and all copies are ordered by a second hash, which is a global shuffle. Every choice depends on the row
alone, so lost tasks can be run again with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import RANK_BUCKETS, documents, md5_key, ranked, settle

TEMPERATURE = 0.5
#: Past this many sources the rates are joined by a shuffle instead of being sent to every task.
BROADCAST_SOURCES = 10_000
#: A mean above this is split into whole copies and a Poisson rest, so that exp(-mean) never underflows.
LARGEST_MEAN = 64.0


def hashed_uniform(seed: str, *columns: str | Column) -> Column:
    """A number in [0, 1) with 52 random bits."""
    return F.conv(F.substring(md5_key(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, until far in its tail."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))
    first = F.exp(-mean)
    start = F.struct(F.array(first).alias("sums"), first.alias("term"), first.alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        return F.struct(F.concat(acc["sums"], F.array(total)).alias("sums"), term.alias("term"), total.alias("sum"))

    return F.aggregate(steps, start, step)["sums"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, source_col: str = "source") -> DataFrame:
    """source, n, rate, whole (copies that every document gets) and cdf (of the rest).

    Sources that ``weights`` does not name have rate 0, and names that no document has take no share. Without weights a
    source counts by its size to the power TEMPERATURE. ``rows``: expected rows drawn, the number of documents where it
    is None.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, weight double")
        counts = counts.join(named, F.col("source") == F.col("named"), "left").drop("named").fillna(0.0, ["weight"])
    counts = settle(counts, "mixing-counts")
    total = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    drawn = F.lit(float(rows)) if rows is not None else F.col("all_n").cast("double")
    rate = F.when(F.col("all_weight") > 0, F.col("weight") * drawn / F.col("all_weight") / F.col("n")).otherwise(0.0)
    out = counts.crossJoin(F.broadcast(total)).withColumn("rate", rate)  # one row of totals
    whole = F.when(F.col("rate") > LARGEST_MEAN, F.floor(F.col("rate") - LARGEST_MEAN)).otherwise(F.lit(0)).cast("int")
    out = out.withColumn("whole", whole)
    return settle(out.select("source", "n", "rate", "whole", _cdf(F.col("rate") - F.col("whole")).alias("cdf")), "mixing-rates")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: str = "mixture", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), n_copies, copy (from 0) and shuffle_key, one row per copy.

    A null source is a source of its own; documents are read by id and source only, so null and empty texts are mixed
    like others. Rows that share an id get the same number of copies. An empty table gives no rows.
    """
    rates = source_rates(docs, weights, rows, source_col)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("source").alias("_source"), "whole", "cdf")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = held.join(F.broadcast(rates) if few else rates, F.col(f"row.`{source_col}`").eqNullSafe(F.col("_source")))
    uniform = hashed_uniform(f"{seed}-count", F.col(f"row.`{id_col}`"))
    copies = F.col("whole") + F.size(F.filter("cdf", lambda c: c <= F.col("_uniform")))
    counted = joined.withColumn("_uniform", uniform).withColumn("n_copies", copies.cast("int")).filter("n_copies > 0")
    dealt = counted.select("row", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    return dealt.withColumn("shuffle_key", md5_key(f"{seed}-order", F.col(f"row.`{id_col}`"), F.col("copy")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: str = "mixture") -> DataFrame:
    """The mixture itself: the columns of ``docs``, each document as often as drawn, in shuffled order."""
    dealt = replicate(docs, weights, rows, seed)
    return dealt.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*")


def op7_poisson_mixture(spark, sf_dir: str) -> DataFrame:
    """Every copy that is drawn: doc_id, source, copy, n_copies and its position in the shuffled mixture (from 0)."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    dealt = settle(replicate(docs).select("row.doc_id", "row.source", F.col("copy").cast("long").alias("copy"), F.col("n_copies").cast("long").alias("n_copies"), "shuffle_key"), "mixture-rows")
    dealt = dealt.withColumn("everything", F.lit(0))
    bucket = F.floor(F.conv(F.substring("shuffle_key", 1, 3), 16, 10).cast("int") / (4096 // RANK_BUCKETS))
    placed = ranked(dealt, ["everything"], bucket, ["shuffle_key", "doc_id", "copy", "source"], "place", "n_all")
    return placed.select("doc_id", "source", "copy", "n_copies", (F.col("place") - 1).cast("long").alias("position"))


ORACLE_OP7 = """
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (sum(n) OVER ())::DOUBLE / sum(w) OVER () / n AS rate FROM n),
u AS (
  SELECT doc_id, d.source, rate,
    ('0x' || substr(md5('mixture-count:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
),
p AS (
  SELECT source, k, sum(exp(-rate) * rate ** k / factorial(k::INTEGER)::DOUBLE) OVER (PARTITION BY source ORDER BY k) AS below
  FROM r, range(0, 30) t(k)
),
c AS (
  SELECT u.doc_id, u.source, count(*) FILTER (below <= u.u) AS n_copies
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source GROUP BY u.doc_id, u.source, u.u
),
x AS (
  SELECT doc_id, source, n_copies, unnest(range(0, n_copies)) AS copy FROM c
)
SELECT doc_id, source, copy, n_copies,
  row_number() OVER (ORDER BY md5('mixture-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), doc_id, copy) - 1 AS position
FROM x
"""
