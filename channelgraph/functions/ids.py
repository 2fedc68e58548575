"""Signed peer ids: a channel is -(10^12 + raw), a basic chat -raw, a user +raw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNEL_MARK = 10**12


def signed_channel(raw: Column) -> Column:
    return -(F.lit(CHANNEL_MARK) + raw.cast("bigint"))


def raw_channel(signed: Column) -> Column:
    return F.when(signed < -CHANNEL_MARK, -signed - CHANNEL_MARK)


def infer_type(signed: Column) -> Column:
    return (
        F.when(signed < -CHANNEL_MARK, "channel")
        .when(signed < 0, "chat")
        .when(signed >= 0, "user")
    )


def is_target(signed: Column) -> Column:
    """Communities can be nodes that forwards lead to; users cannot."""
    return signed < 0


def positive_channel(raw: Column) -> Column:
    """Signed id of a linked channel; absent for ids that are not positive."""
    return F.when(raw > 0, signed_channel(raw))


def nonzero_chat(raw: Column) -> Column:
    return F.when(raw != 0, -F.abs(raw.cast("bigint")))
