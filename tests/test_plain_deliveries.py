"""State of the engine over deliveries made from messages that carry their own texts: the column of references is there, and empty."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_streams import test_state_survives_restarts_and_repeats  # noqa: F401

from channelgraph.operators.texts import with_reference
from channelgraph.streaming import jobs


@pytest.fixture
def parts(archive, tmp_path):
    messages = with_reference(archive.messages).withColumn("seq", F.col("id")).select(*jobs.DELIVERIES.fieldNames())

    def deliver(n):
        part = messages.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == n % 3) if n < 3 else messages
        part.withColumn("seq", F.col("seq") + n).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    return deliver
