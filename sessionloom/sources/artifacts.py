"""Readers and writers of sessions, artifacts, segments and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "session_id string, user_id string, started_at timestamp, ended_at timestamp, metadata map<string,string>"
ARTIFACT = "artifact_id string, session_id string, pipeline string, kind string, start_ms long, end_ms long, links map<string,string>, metadata string, created_at timestamp"
SEGMENT = "segment_id string, session_id string, resource string, sequence long, content_type string, byte_size long, sha256 string, captured_at timestamp, duration_ms long, attrs map<string,string>, path string"
LOCATION = "array<struct<lat: double, lon: double, t: long, alt_m: double, accuracy_m: double>>"
WINDOW = "struct<start_ms: long, end_ms: long, labels: array<struct<label: string, score: double>>, embedding: array<double>>"
#: Magic, version, session, sequence, capture time (ms) before a frame's PCM.
FRAME_HEADER = 29


def artifacts(spark: SparkSession, path: str, *, pipeline: str | None = None, kind: str | None = None) -> DataFrame:
    """Artifacts laid out by pipeline and kind; the filters prune partitions."""
    df = spark.read.schema(ARTIFACT).parquet(path)
    df = df if pipeline is None else df.filter(F.col("pipeline") == pipeline)
    return df if kind is None else df.filter(F.col("kind") == kind)


def of_session(df: DataFrame, session_id, *, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """A session's artifacts, those of the whole session first; a window keeps them and the spans it meets."""
    df = df.filter(F.col("session_id") == session_id)
    whole = F.col("start_ms").isNull()
    df = df if from_ms is None else df.filter(whole | (F.col("end_ms") > from_ms))
    df = df if to_ms is None else df.filter(whole | (F.col("start_ms") < to_ms))
    return df.orderBy(F.col("start_ms").asc_nulls_first(), "artifact_id")


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(path under ``root``, length, content) of every file in it, read as they are asked for."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace(F.col("path").substr(F.lit(len(whole) + 1), F.length("path")), "^/+", "").alias("path"), "length", "content")


def relative(path: str = "path") -> Column:
    return F.regexp_replace(path, "^/+", "")


def segment_bytes(spark: SparkSession, segments: DataFrame, root: str) -> DataFrame:
    """Segments (path under ``root``) with the bytes of their files, and whether the declared sha256 holds; null without a file."""
    files = stored_files(spark, root).select(F.col("path").alias("_path"), "content")
    j = segments.withColumn("_path", relative()).join(files, "_path", "left").drop("_path")
    return j.withColumn("valid", F.sha2("content", 256) == F.col("sha256"))


def orphans(spark: SparkSession, segments: DataFrame, root: str) -> DataFrame:
    """(path, length) of stored files that no row points to."""
    return stored_files(spark, root).select("path", "length").join(segments.select(relative().alias("path")), "path", "left_anti")


def session_summaries(stats: DataFrame, path: str) -> None:
    """One JSON summary per session, foldered by session."""
    stats.write.mode("overwrite").partitionBy("session_id").json(path)


def location_batches(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good batches with points, captured_at and duration_ms, refused ones with their error) of JSON payloads ``{"points": [...]}``.

    A capture time or duration that ``raw`` declares stays; else they follow from the first and last point.
    """
    from sessionloom.operators.location import batch_errors

    b = batch_errors(raw.withColumn("points", F.from_json(column, f"points {LOCATION}", {"mode": "PERMISSIVE"})["points"]))
    t = F.transform("points", lambda p: p["t"])
    given = lambda name, kind: F.col(name) if name in raw.columns else F.lit(None).cast(kind)
    good = b.filter("error is null").drop("error").withColumn("captured_at", F.coalesce(given("captured_at", "timestamp"), F.timestamp_millis(t[0]))).withColumn("duration_ms", F.coalesce(given("duration_ms", "long"), F.element_at(t, -1) - t[0]))
    return good, b.filter("error is not null")


def audio_errors(attrs: str = "attrs") -> Column:
    """Why audio attributes are refused, or null; both are optional."""
    n = lambda k: F.try_element_at(attrs, F.lit(k))
    bad = lambda k: n(k).isNotNull() & F.coalesce(n(k).try_cast("int") <= 0, F.lit(True))
    return F.when(bad("rate"), "rate").when(bad("channels"), "channels")


def model_windows(raw: DataFrame, column: str = "response") -> DataFrame:
    """Scored windows of a tagger's JSON answers, those with unusable values left out."""
    w = raw.withColumn("w", F.explode(F.from_json(column, f"array<{WINDOW}>"))).select("*", "w.*").drop("w")
    ok = F.forall("labels", lambda l: l["label"].isNotNull() & l["score"].isNotNull() & ~F.isnan(l["score"]))
    return w.filter("start_ms is not null and end_ms > start_ms").filter(ok)


def frame_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """(session_id, sequence, captured_at, pcm) of binary messages: 5 bytes of magic and version, three big-endian 64-bit numbers, PCM."""
    number = lambda at: F.conv(F.hex(F.substring(column, at, 8)), 16, 10).cast("decimal(20,0)").cast("long")
    m = raw.filter(F.length(column) > FRAME_HEADER)
    return m.select(number(6).alias("session_id"), number(14).alias("sequence"), F.timestamp_millis(number(22)).alias("captured_at"), F.expr(f"substring({column}, {FRAME_HEADER} + 1)").alias("pcm"))


def frame_errors(*, channels: int = 1, max_bytes: int = 1 << 20) -> Column:
    """Why a frame is refused, or null: empty, not whole samples, too large."""
    n = F.length("pcm")
    return F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n % (2 * channels) != 0, "partial sample").when(n > max_bytes, "too large")
