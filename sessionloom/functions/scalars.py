"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded (not floored) from microseconds."""
    return F.round(F.unix_micros(ts.cast("timestamp")) / 1000.0).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for a zero vector, so that it can be divided by."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, n).otherwise(F.lit(1.0))


def unit(a: Column) -> Column:
    """``a`` over its length, which is taken once a row, not once a number."""
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x.cast("double") / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def is_finite_vector(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def pcm_duration_ms(n_bytes: Column, rate: Column, channels: Column) -> Column:
    """Milliseconds of 16-bit PCM, half to even."""
    return F.bround(n_bytes * 1000 / (rate * channels * 2)).cast("long")


def rotation_instant(now: Column, hhmm: str, zone: str) -> Column:
    """The last instant not after ``now`` at which clocks in ``zone`` showed ``hhmm``."""
    local = F.from_utc_timestamp(now, zone)
    today = F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(f" {hhmm}:00")))
    return F.to_utc_timestamp(F.when(today <= local, today).otherwise(today - F.expr("interval 1 day")), zone)


def md5_order(*parts: Column) -> Column:
    """A fixed but blind order: the md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *parts))
