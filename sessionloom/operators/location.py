"""Location batches and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import epoch_ms


def session_points(batches: DataFrame) -> DataFrame:
    """One row per fix with its wall clock (ms), place on the session's timeline and, where batches have them, alt_m and accuracy_m.

    A fix's ``t`` is epoch milliseconds, so its place is t less the session's start: before
    it for a fix older than the session.  idx counts from 1 in its batch.
    """
    p = batches.select("segment_id", "session_id", "user_id", "started_at", F.posexplode("points").alias("pos", "p"))
    more = [F.col(f"p.{c}").alias(c) for c in ("alt_m", "accuracy_m") if c in batches.schema["points"].dataType.elementType.fieldNames()]
    wall = F.col("p.t")
    return p.select("segment_id", "session_id", "user_id", (F.col("pos") + 1).cast("long").alias("idx"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), wall.alias("wall_ms"), (wall - epoch_ms(F.col("started_at"))).alias("at_ms"), *more)


def points_between(batches: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Fixes by wall clock in [from_ms, to_ms): whole batches are ruled out by their span before they are unnested."""
    first = epoch_ms(F.col("captured_at"))
    near = batches.filter((first < to_ms) & (first + F.coalesce("duration_ms", F.lit(0)) >= from_ms))
    return session_points(near).filter((F.col("wall_ms") >= from_ms) & (F.col("wall_ms") < to_ms))


def decimated(points: DataFrame, max_points: int = 500) -> DataFrame:
    """Every ceil(n / max_points)-th fix of a session and its last; n_points and the bounds are those of all fixes."""
    w = Window.partitionBy("session_id")
    order = Window.partitionBy("session_id").orderBy("wall_ms", "segment_id", "idx")
    p = points.withColumn("rn", F.row_number().over(order)).withColumn("n_points", F.count("*").over(w)).withColumn("first_ms", F.min("wall_ms").over(w)).withColumn("last_ms", F.max("wall_ms").over(w))
    stride = F.greatest(F.lit(1), F.expr(f"(n_points + {max_points} - 1) div {max_points}"))
    return p.filter((F.pmod(F.col("rn") - 1, stride) == 0) | (F.col("rn") == F.col("n_points")))


def tracks(points: DataFrame, max_points: int = 500) -> DataFrame:
    """One row per session: exact bounds and counts, and the decimated fixes in order, coordinates at 5 decimals."""
    fix = F.struct("rn", F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"), "wall_ms")
    return decimated(points, max_points).groupBy("session_id", "user_id", "n_points", "first_ms", "last_ms").agg(F.array_sort(F.collect_list(fix)).alias("points"))


def split_at_gaps(points: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """Adds ``piece``: a new one after every gap over ``gap_ms``."""
    w = Window.partitionBy("session_id").orderBy("at_ms", "segment_id", "idx")
    new = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(w) > gap_ms).cast("int"), F.lit(0))
    return points.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def position_at(points: DataFrame, probes: DataFrame, *, gap_ms: int = 300_000) -> DataFrame:
    """Where each probe (session_id, probe_id, at_ms) was: between neighbours, at the nearer of two over ``gap_ms`` apart, or at an end.

    One sort of probes and fixes together; ``exact`` is false for a guess.  Probes of a
    session without fixes have no row.
    """
    fix = F.struct("at_ms", "lat", "lon")
    p = points.select("session_id", "at_ms", F.lit(0).alias("is_probe"), F.col("segment_id").alias("o1"), F.col("idx").alias("o2"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), fix.alias("fix"))
    q = probes.select("session_id", "at_ms", F.lit(1).alias("is_probe"), F.lit(None).cast("string").alias("o1"), F.lit(None).cast("long").alias("o2"), "probe_id", F.lit(None).cast(p.schema["fix"].dataType).alias("fix"))
    w = Window.partitionBy("session_id").orderBy("at_ms", "is_probe", "o1", "o2")
    a, b = F.last("fix", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("fix", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    first = F.first("fix", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = p.unionByName(q).withColumn("a", a).withColumn("b", b).withColumn("first", first).filter("is_probe = 1")
    s = s.filter(F.col("first").isNotNull())
    t = F.col("at_ms")
    at_first = F.col("a").isNull() | (t <= F.col("first.at_ms"))
    far = F.col("b.at_ms") - F.col("a.at_ms") > gap_ms
    part = F.when(F.col("b.at_ms") == F.col("a.at_ms"), 0.0).otherwise((t - F.col("a.at_ms")) / (F.col("b.at_ms") - F.col("a.at_ms")))
    nearer_a = t - F.col("a.at_ms") <= F.col("b.at_ms") - t

    def coordinate(c: str) -> Column:
        between = F.when(far, F.when(nearer_a, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * part)
        return F.when(at_first, F.col(f"first.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(between)

    exact = F.when(at_first, t == F.col("first.at_ms")).when(F.col("b").isNull(), t == F.col("a.at_ms")).otherwise(~far)
    return s.select("session_id", "probe_id", "at_ms", coordinate("lat").alias("lat"), coordinate("lon").alias("lon"), exact.alias("exact"))


def batch_errors(batches: DataFrame, content_type: str = "application/json") -> DataFrame:
    """Adds ``error``: why a batch is refused, or null.  captured_at and duration_ms of a good one follow from its first and last t.

    Points are 1 to 10 000, each with a place on the globe, a time of at least 0 and
    an accuracy of at least 0 or none, in order of time; columns content_type and
    attrs (a map; location declares none) are checked where batches have them.
    """
    bad = lambda cond, why: F.when(cond, F.lit(why))
    p = F.col("points")
    fields = batches.schema["points"].dataType.elementType.fieldNames()
    checks = [
        bad(p.isNull() | (F.size(p) < 1), "no points"),
        bad(F.size(p) > 10_000, "too many points"),
        bad(F.exists(p, lambda x: F.coalesce(~x["lat"].between(-90, 90), F.lit(True))), "latitude"),
        bad(F.exists(p, lambda x: F.coalesce(~x["lon"].between(-180, 180), F.lit(True))), "longitude"),
        bad(F.exists(p, lambda x: F.coalesce(x["t"] < 0, F.lit(True))), "time"),
        bad(F.transform(p, lambda x: x["t"]) != F.array_sort(F.transform(p, lambda x: x["t"])), "order"),
    ]
    if "accuracy_m" in fields:
        checks.insert(5, bad(F.exists(p, lambda x: F.coalesce((x["accuracy_m"] < 0) | F.isnan(x["accuracy_m"]), F.lit(False))), "accuracy"))
    if "content_type" in batches.columns:
        checks.insert(0, bad(F.col("content_type").isNotNull() & (F.col("content_type") != content_type), "content type"))
    if "attrs" in batches.columns:
        checks.insert(0, bad(F.coalesce(F.size("attrs") > 0, F.lit(False)), "attributes"))
    return batches.withColumn("error", F.coalesce(*checks))
