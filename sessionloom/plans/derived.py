"""Session tables derived from the given ones, each as a DataFrame and as SQL for the oracle.

Events have no session timeline of their own, so their order within a user stands
for time: window i starts at 5 s times i, turn i at 2 s times i, frame i is frame i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), (F.row_number().over(w) - 1).cast("long").alias("i"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events until a gap of over 12 hours; the last session of a user is still open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("interval 12 hours")).cast("int"), F.lit(1)))
    e = e.withColumn("n", F.sum("new").over(w))
    s = e.groupBy("user_id", "n").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("n_events"), F.min(F.struct("ts", "event_id"))["event_id"].alias("session_id"))
    last = F.max("n").over(Window.partitionBy("user_id"))
    return s.select("session_id", "user_id", "started_at", F.when(F.col("n") < last, F.col("last_at")).alias("ended_at"), "last_at", "n_events")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their session and the milliseconds since it started."""
    s = sessions(spark, sf_dir).select("session_id", F.col("user_id").alias("u"), "started_at", "last_at", "ended_at")
    e = table(spark, sf_dir, "events")
    j = e.join(s, (e["user_id"] == s["u"]) & (e["ts"] >= s["started_at"]) & (e["ts"] <= s["last_at"])).drop("u")
    return j.withColumn("at_ms", epoch_ms(F.col("ts")) - epoch_ms(F.col("started_at")))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordered_events(spark, sf_dir)
    score = F.col("k") / 99.0
    labels = F.array(F.struct(F.col("event_type").alias("label"), score.alias("score")), F.struct(F.lit("any").alias("label"), (1 - score).alias("score")))
    return e.select(F.col("user_id").alias("session_id"), (F.col("i") * 5000).alias("start_ms"), (F.col("i") * 5000 + 10000).alias("end_ms"), labels.alias("labels"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordered_events(spark, sf_dir)
    start = F.col("i") * 2000
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_id"), start.alias("start_ms"), (start + 1 + F.floor(F.col("value") * 40)).alias("end_ms"), F.concat(F.lit("S"), (F.col("k") % 3).cast("string")).alias("speaker"), "k")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordered_events(spark, sf_dir)
    return e.select(F.col("user_id").alias("session_id"), F.col("i").alias("frame"), (F.col("k") / 99.0).alias("p"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location batches: a session's events as fixes, their times in epoch milliseconds."""
    e = session_events(spark, sf_dir)
    fix = F.struct(F.col("ts"), F.col("event_id"), ((F.col("event_id") % 180) - 90 + F.col("value") / 1000).alias("lat"), ((F.col("event_id") * 7 % 360) - 180 + F.col("value") / 1000).alias("lon"))
    b = e.groupBy("session_id", "user_id", "started_at", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(fix)).alias("p"))
    first = epoch_ms(F.col("p")[0]["ts"])
    rel = F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), epoch_ms(x["ts"]).alias("t")))
    return b.select(F.concat_ws(":", "session_id", "day").alias("segment_id"), "session_id", "user_id", "started_at", F.col("p")[0]["ts"].alias("captured_at"), (epoch_ms(F.element_at("p", -1)["ts"]) - first).alias("duration_ms"), rel.alias("points"))


ORD = "ord AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
SESSIONS = """se0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
se1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM se0),
se2 AS (SELECT user_id, n, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n_events, arg_min(event_id, (ts, event_id)) AS session_id FROM se1 GROUP BY user_id, n),
sessions AS (SELECT session_id, user_id, started_at, CASE WHEN n < max(n) OVER (PARTITION BY user_id) THEN last_at END AS ended_at, last_at, n_events FROM se2)"""
SESSION_EVENTS = SESSIONS + """,
session_events AS (SELECT e.*, s.session_id, s.started_at, s.last_at, s.ended_at, CAST(round(epoch_us(e.ts) / 1000.0) AS BIGINT) - CAST(round(epoch_us(s.started_at) / 1000.0) AS BIGINT) AS at_ms FROM events e JOIN sessions s ON e.user_id = s.user_id AND e.ts BETWEEN s.started_at AND s.last_at)"""
WINDOWS = ORD + """,
win AS (SELECT user_id AS session_id, i * 5000 AS start_ms, i * 5000 + 10000 AS end_ms, unnest([event_type, 'any']) AS label, unnest([k / 99.0, 1 - k / 99.0]) AS score FROM ord)"""
TURNS = ORD + """,
turns AS (SELECT user_id AS session_id, event_id AS turn_id, i * 2000 AS start_ms, i * 2000 + 1 + CAST(floor(value * 40) AS BIGINT) AS end_ms, 'S' || (k % 3) AS speaker, k FROM ord)"""
FRAMES = ORD + ", frames AS (SELECT user_id AS session_id, i AS frame, k / 99.0 AS p FROM ord)"
POINTS = SESSION_EVENTS + """,
fixes AS (SELECT session_id, user_id, started_at, ts, event_id, CAST(ts AS DATE) AS day, at_ms, (event_id % 180) - 90 + value / 1000 AS lat, (event_id * 7 % 360) - 180 + value / 1000 AS lon,
          row_number() OVER (PARTITION BY session_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS idx, min(ts) OVER (PARTITION BY session_id, CAST(ts AS DATE)) AS captured_at, max(ts) OVER (PARTITION BY session_id, CAST(ts AS DATE)) AS captured_to FROM session_events)"""
