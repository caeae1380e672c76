"""Location from JSON batches to points, tracks and events; times are epoch milliseconds throughout."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sessionloom.operators import location as loc
from sessionloom.operators import timeline as tl
from sessionloom.sources import artifacts as ar
from sessionloom.streaming import sessions as st

START = 1767225600000  # 2026-01-01 00:00 UTC


def raw(spark, *payloads):
    rows = [(f"g{i}", "s", "u", dt.datetime(2026, 1, 1), p if isinstance(p, str) else json.dumps({"points": p}), "application/json", {}) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "segment_id string, session_id string, user_id string, started_at timestamp, payload string, content_type string, attrs map<string,string>")


def point(t, lat=1.0, **more):
    return {"lat": lat, "lon": 2.0, "t": START + t, **more}


def test_from_json_to_points_and_events(spark):
    good, refused = ar.location_batches(raw(spark, [point(-500), point(0), point(10_000, accuracy_m=3.5)], [point(10_000, 7.0)]))
    assert refused.count() == 0
    pts = loc.session_points(good).orderBy("at_ms", "segment_id", "idx").collect()
    assert [(p["segment_id"], p["idx"], p["at_ms"], p["wall_ms"] - START, p["accuracy_m"]) for p in pts] == [("g0", 1, -500, -500, None), ("g0", 2, 0, 0, None), ("g0", 3, 10_000, 10_000, 3.5), ("g1", 1, 10_000, 10_000, None)]
    spans = {r["segment_id"]: (r["captured_at"], r["duration_ms"]) for r in good.collect()}
    assert spans["g0"] == (dt.datetime(2025, 12, 31, 23, 59, 59, 500_000), 10_500) and spans["g1"][1] == 0
    live = st.location_events(good, 0, 10_001).orderBy("at_ms", "lat").collect()
    assert [(r["at_ms"], r["lat"]) for r in live] == [(0, 1.0), (10_000, 1.0), (10_000, 7.0)]
    parts = [st.location_events(good, a, b).count() for a, b in ((None, 0), (0, 10_000), (10_000, None))]
    assert parts == [1, 1, 2]
    events = tl.expanded_segments(good.withColumn("resource", F.lit("location")).withColumn("source", F.col("segment_id"))).collect()
    assert sorted((e["at_ms"], e["type"], e["rank"], e["lat"], e["captured_ms"] - START) for e in events) == [(-500, "location-point", 6, 1.0, -500), (0, "location-point", 6, 1.0, 0), (10_000, "location-point", 6, 1.0, 10_000), (10_000, "location-point", 6, 7.0, 10_000)]
    assert loc.points_between(good, START, START + 1).count() == 1


def test_refused_batches_say_why(spark):
    cases = {"no points": [], "latitude": [point(0, 90.5)], "longitude": [{"lat": 0, "lon": -181, "t": 0}], "time": [{"lat": 0, "lon": 0, "t": -1}], "order": [point(5), point(4)], "accuracy": [point(0, accuracy_m=-0.1)]}
    batches = raw(spark, *cases.values(), "not json", [{"lat": 0, "lon": 0}], [point(0)])
    batches = batches.withColumn("content_type", F.when(F.col("segment_id") == "g8", "text/plain").otherwise(F.col("content_type")))
    odd = raw(spark, [point(0)]).withColumn("attrs", F.create_map(F.lit("rate"), F.lit("1"))).withColumn("segment_id", F.lit("g9"))
    good, refused = ar.location_batches(batches.unionByName(odd))
    assert good.count() == 0
    assert {r["segment_id"]: r["error"] for r in refused.collect()} == dict(zip([f"g{i}" for i in range(10)], [*cases, "no points", "time", "content type", "attributes"], strict=True))
