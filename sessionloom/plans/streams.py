"""Queries over streams of events, each drained from the given table, and over PCM made from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.scalars import epoch_ms
from sessionloom.functions.storage import written
from sessionloom.operators import pcm
from sessionloom.plans import derived as d
from sessionloom.plans.catalog import query
from sessionloom.streaming import sessions as st


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = d.table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def frames(events: DataFrame) -> DataFrame:
    """Events as frames: the number is k, the bytes its text repeated."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("user_id").alias("session_id"), k.alias("sequence"), F.col("ts").cast("timestamp").alias("captured_at"), F.encode(F.repeat(F.lit("ab"), (k % 7 + 1).cast("int")), "UTF-8").alias("pcm"))


K = "k0 AS (SELECT user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, event_id FROM events)"


@query("stream_progress", f"WITH {K}, s AS (SELECT session_id, k, count(*) AS c FROM k0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k) - 1 AS i FROM s) SELECT session_id, coalesce(max(CASE WHEN k = i THEN k END), -1) AS through, count(*) AS stored, CAST(sum(2 * (k % 7 + 1)) AS BIGINT) AS bytes, CAST(sum(c) - count(*) AS BIGINT) AS duplicates FROM r GROUP BY session_id")
def stream_progress(spark, sf_dir):
    return st.drained(st.progress(frames(event_stream(spark, sf_dir))), f"progress_{uuid.uuid4().hex}", "update").groupBy("session_id").agg(*[F.max_by(c, "stored").alias(c) for c in ("through",)], *[F.max(c).alias(c) for c in ("stored", "bytes", "duplicates")])


@query("batch_progress", f"WITH {K}, s AS (SELECT session_id, k, count(*) AS c FROM k0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k) - 1 AS i FROM s) SELECT session_id, coalesce(max(CASE WHEN k = i THEN k END), -1) AS through, count(*) AS stored, CAST(sum(2 * (k % 7 + 1)) AS BIGINT) AS bytes, CAST(sum(c) - count(*) AS BIGINT) AS duplicates FROM r GROUP BY session_id")
def batch_progress(spark, sf_dir):
    return st.progress(frames(d.table(spark, sf_dir, "events")))


@query("stream_dedup", f"WITH {K} SELECT session_id, k AS sequence, count(DISTINCT k) AS n FROM k0 GROUP BY session_id, k")
def stream_dedup(spark, sf_dir):
    out = st.drained(st.deduplicated(frames(event_stream(spark, sf_dir)), "400 days"), f"dedup_{uuid.uuid4().hex}")
    return out.groupBy("session_id", "sequence").agg(F.count("*").alias("n"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.ordered_events(spark, sf_dir)
    return e.select(F.col("user_id").alias("session_id"), F.col("i").alias("sequence"), F.col("ts").cast("timestamp").alias("captured_at"), F.encode(F.repeat(F.lit("ab"), (F.col("k") % 7 + 1).cast("int")), "UTF-8").alias("pcm"), (F.col("k") == 7).alias("trigger"))


AUDIO = f"{d.ORD}, f AS (SELECT user_id AS session_id, i, epoch_us(ts) AS us, 2 * (k % 7 + 1) AS size, k = 7 AS hit FROM ord)"
POOLED = f"""WITH RECURSIVE {AUDIO},
p AS (SELECT session_id, i, us AS since, i AS first, size AS held FROM f WHERE i = 0
 UNION ALL SELECT f.session_id, f.i, CASE WHEN held >= 64 OR us - since >= 90000000000 THEN us ELSE since END, CASE WHEN held >= 64 OR us - since >= 90000000000 THEN f.i ELSE first END, CASE WHEN held >= 64 OR us - since >= 90000000000 THEN size ELSE held + size END FROM p JOIN f ON f.session_id = p.session_id AND f.i = p.i + 1)
SELECT session_id, max(i) AS sequence, first AS first_frame, max(i) AS last_frame, count(*) AS frames, CAST(max(held) AS BIGINT) AS bytes FROM p GROUP BY session_id, first"""
#: The frames of a window: those that make 16 bytes up to the trigger, then 240 bytes more.
GATED = f"""WITH RECURSIVE {AUDIO}, c AS (SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY i) AS upto FROM f),
g AS (SELECT session_id, i, CAST(hit AS BIGINT) AS n, CASE WHEN hit THEN 240 ELSE 0 END AS left_, hit AS opened, FALSE AS inside FROM f WHERE i = 0
 UNION ALL SELECT f.session_id, f.i, n + CASE WHEN left_ <= 0 AND hit THEN 1 ELSE 0 END, CASE WHEN left_ > 0 THEN left_ - size WHEN hit THEN 240 ELSE left_ END, left_ <= 0 AND hit, left_ > 0 FROM g JOIN f ON f.session_id = g.session_id AND f.i = g.i + 1),
w AS (SELECT session_id, n AS window_no, i, size FROM g JOIN c USING (session_id, i) WHERE inside
 UNION ALL SELECT g.session_id, g.n, b.i, b.size FROM g JOIN c ON c.session_id = g.session_id AND c.i = g.i JOIN c b ON b.session_id = g.session_id AND b.i <= g.i AND (c.upto - b.upto < 16 OR b.i = g.i) WHERE opened)
SELECT session_id, window_no, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY ALL"""
WINDOW = {"before_ms": 2_000, "window_ms": 30_000, "bytes_per_ms": 0.008}


@query("pooled_chunks", POOLED)
def pooled_chunks(spark, sf_dir):
    return st.pooled(numbered(spark, sf_dir).drop("trigger"), max_bytes=64, max_ms=90_000_000).select("session_id", "sequence", "first_frame", "last_frame", "frames", F.length("pcm").cast("long").alias("bytes"))


@query("gated_windows", GATED)
def gated_windows(spark, sf_dir):
    return st.window_effects(st.gated(numbered(spark, sf_dir), **WINDOW))


@query("stream_gated_windows", GATED)
def stream_gated_windows(spark, sf_dir):
    """The same from a stream of the frames."""
    path = written(numbered(spark, sf_dir), "frames").written_path
    frames = spark.readStream.schema("session_id long, sequence long, captured_at timestamp, pcm binary, trigger boolean").parquet(path)
    out = st.drained(st.gated(frames, **WINDOW), f"gated_{uuid.uuid4().hex}")
    return st.window_effects(out.filter("refused is null"))


@query("pattern_triggers", f"WITH {d.ORD}, f AS (SELECT user_id AS session_id, i, repeat('ab', CAST(k % 7 + 1 AS INT)) || CASE WHEN k % 3 = 0 THEN 'c' ELSE '' END AS x FROM ord), j AS (SELECT *, coalesce(lag(x, 1) OVER w, '') AS x1, coalesce(lag(x, 2) OVER w, '') AS x2 FROM f WINDOW w AS (PARTITION BY session_id ORDER BY i)) SELECT session_id, i AS sequence, right(x2 || x1, 5) || x LIKE '%bcabca%' AS trigger FROM j")
def pattern_triggers(spark, sf_dir):
    """Frames in which a pattern ends that goes over three of them at most here."""
    k = F.col("k")
    pcm = F.encode(F.concat(F.repeat(F.lit("ab"), (k % 7 + 1).cast("int")), F.when(k % 3 == 0, "c").otherwise("")), "UTF-8")
    f = d.ordered_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("i").alias("sequence"), pcm.alias("pcm"))
    return st.triggered(f, b"bcabca").select("session_id", "sequence", "trigger")


@query("idle_sessions", "WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 300 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM o) SELECT user_id, epoch_ms(min(ts)) AS started_ms, epoch_ms(max(ts) + INTERVAL 300 MINUTE) AS ended_ms, count(*) AS events FROM g GROUP BY user_id, n")
def idle_sessions(spark, sf_dir):
    s = st.idle_sessions(d.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), idle="300 minutes")
    return s.select("user_id", epoch_ms(F.col("started_at")).alias("started_ms"), epoch_ms(F.col("ended_at")).alias("ended_ms"), "events")


@query("heartbeats", "WITH RECURSIVE b AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT b.user_id, min(e.ts) FROM b JOIN events e ON e.user_id = b.user_id AND e.ts > b.ts + INTERVAL 1 MINUTE GROUP BY b.user_id, b.ts) SELECT user_id, epoch_ms(ts) AS last_ms FROM b")
def heartbeats(spark, sf_dir):
    h = st.heartbeats(d.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return h.select("user_id", epoch_ms(F.col("last_at")).alias("last_ms"))


@query("live_location_events", "SELECT user_id, epoch_ms(ts) + t - epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS at_ms, event_id * 10 + t // 20000 AS point, value + t / 20000.0 AS lat FROM events, (SELECT unnest([0, 20000, 40000]) AS t) WHERE value IS NOT NULL AND epoch_ms(ts) + t - epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) BETWEEN 3600000 AND 79999999")
def live_location_events(spark, sf_dir):
    """Each streamed location batch, three fixes in epoch milliseconds, as location-point events of a session of that day, within a window."""
    at = epoch_ms(F.col("ts"))
    point = lambda t: F.struct((F.col("value") + t / 20000.0).alias("lat"), F.lit(float(t)).alias("lon"), (at + t).alias("t"))
    batches = event_stream(spark, sf_dir).filter("value is not null").select("user_id", "event_id", at.alias("first_ms"), F.date_trunc("day", "ts").alias("started_at"), F.array(point(0), point(20_000), point(40_000)).alias("points"))
    live = st.location_events(batches, 3_600_000, 80_000_000)
    return st.drained(live, f"live_{uuid.uuid4().hex}").select("user_id", "at_ms", (F.col("event_id") * 10 + (F.col("t") - F.col("first_ms")) / 20000).cast("long").alias("point"), "lat")


@query("energy_frames", "WITH d AS (SELECT doc_id % 20 AS session_id, strlen(coalesce(text, '')) // 2 * 2 AS n FROM documents), t AS (SELECT session_id, sum(n) AS n FROM d GROUP BY ALL) SELECT session_id, CAST(n // 1024 AS BIGINT) AS frames FROM t WHERE n >= 1024")
def energy_frames(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents")
    seg = docs.select((F.col("doc_id") % 20).alias("session_id"), F.col("doc_id").alias("sequence"), F.concat(F.encode(F.repeat(F.lit("."), F.lit(44)), "UTF-8"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    return pcm.energy_frames(seg).groupBy("session_id").agg(F.count("*").alias("frames"))
