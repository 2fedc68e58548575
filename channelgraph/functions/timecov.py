"""Coverage of a timeline and date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def coverage_ratio(origin: Column, now: Column, after: Column) -> Column:
    """Share of [origin, now] already walked back from now; 0 without dates, 1 for an empty span."""
    total = micros(now) - micros(origin)
    walked = (micros(now) - micros(after)).cast("double")
    share = F.try_divide(walked, total.cast("double"))
    return (
        F.when(origin.isNull() | now.isNull() | after.isNull(), 0.0)
        .when(total <= 0, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    )


def layer_fill(origin: Column, now: Column, after: Column) -> Column:
    return F.bround(coverage_ratio(origin, now, after), 4)


def timeline_segment(origin: Column, end: Column, after: Column, before: Column, fill: Column) -> Column:
    """Left edge and width, in percent, of a scraped window on [origin, end]."""
    # Browsers keep milliseconds.
    def ms(ts: Column) -> Column:
        return F.floor(micros(ts) / 1000)

    start, stop = ms(origin), ms(end)
    lo = F.least(stop, F.greatest(start, ms(after)))
    hi = F.when(before.isNotNull(), F.least(stop, F.greatest(lo, ms(before)))).otherwise(stop)
    span = (stop - start).cast("double")
    walked = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(fill.cast("double"), F.lit(0.0)))) * 100
    placed = F.coalesce((stop > start) & after.isNotNull(), F.lit(False))

    def percent(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))

    left = F.try_divide((lo - start).cast("double"), span) * 100
    right = F.try_divide((hi - start).cast("double"), span) * 100
    return F.struct(
        F.when(placed, percent(left)).when(walked <= 0, 0.0).otherwise(percent(100 - walked)).alias("left"),
        F.when(placed, percent(right - left)).when(walked <= 0, 0.0).otherwise(percent(walked)).alias("width"),
    )


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def end_of_day(ts: Column) -> Column:
    """The last millisecond of the day."""
    return start_of_day(ts) + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")


def in_range(ts: Column, start=None, end=None) -> Column:
    """Inclusive test; without bounds everything passes, with one a missing date does not."""
    test = F.lit(True)
    if start is not None:
        test = test & (ts >= bound(start))
    if end is not None:
        test = test & (ts <= bound(end))
    return F.coalesce(test, F.lit(False))


def bound(value) -> Column:
    """A timestamp literal without zone, so that the comparison reaches the Parquet scan as it is."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")
