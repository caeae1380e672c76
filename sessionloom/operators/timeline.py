"""A session's timeline: typed events of many sources, unioned, windowed and ordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalars import epoch_ms

#: Order of events at one instant.  A span that ends comes before one that starts.
RANKS = {"session-start": 0, "speech-end": 1, "speech-start": 2, "transcript": 3, "audio-tag": 4, "sound-span": 5, "location-point": 6, "session-end": 100}
UNKNOWN_RANK = 50


def rank_of(kind: str) -> int:
    return RANKS.get(kind, UNKNOWN_RANK)


def session_frame(sessions: DataFrame) -> DataFrame:
    """Start of every session, and end of those that have ended."""
    start = sessions.select("session_id", F.lit(0).cast("long").alias("at_ms"), F.lit("session-start").alias("type"), F.lit(rank_of("session-start")).alias("rank"), F.col("session_id").cast("string").alias("source"))
    elapsed = F.greatest(epoch_ms(F.col("ended_at")) - epoch_ms(F.col("started_at")), F.lit(0))
    end = sessions.filter(F.col("ended_at").isNotNull()).select("session_id", elapsed.alias("at_ms"), F.lit("session-end").alias("type"), F.lit(rank_of("session-end")).alias("rank"), F.col("session_id").cast("string").alias("source"))
    return start.unionByName(end)


def speech_events(spans: DataFrame) -> DataFrame:
    """A start and an end event of each speech span (session_id, start_ms, end_ms, source)."""
    both = F.array(F.struct(F.col("start_ms").alias("at_ms"), F.lit("speech-start").alias("type"), F.lit(rank_of("speech-start")).alias("rank")), F.struct(F.col("end_ms").alias("at_ms"), F.lit("speech-end").alias("type"), F.lit(rank_of("speech-end")).alias("rank")))
    return spans.select("session_id", "source", F.explode(both).alias("e")).select("session_id", "e.*", "source")


def assembled(sessions: DataFrame, sources: dict[str, DataFrame], from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """All events (session_id, at_ms, type, rank, source, more by type) with at_ms in [from_ms, to_ms).

    ``sources``: DataFrames with those columns and any of their own; unknown kinds are
    not given.  Windows side by side part the events.
    """
    out = session_frame(sessions)
    for events in sources.values():
        out = out.unionByName(events, allowMissingColumns=True)
    if from_ms is not None:
        out = out.filter(F.col("at_ms") >= from_ms)
    return out if to_ms is None else out.filter(F.col("at_ms") < to_ms)


def stamped(events: DataFrame, speakers: DataFrame) -> DataFrame:
    """Events with the identity that their session's label resolves to; others keep none."""
    return events.join(speakers.select("session_id", "label", "speaker_id", "speaker_name"), ["session_id", "label"], "left")


#: Fields of an expanded event; each kind of event fills its own.
EVENT = "at_ms long, type string, rank int, start_ms long, end_ms long, confidence double, text string, chars long, speaker string, model string, labels string, label string, peak double, mean double, windows long, lat double, lon double, alt_m double, accuracy_m double, captured_ms long"
FIELDS = {x.split()[0]: x.split()[1] for x in EVENT.split(", ")}
POINT = {"lat": "double", "lon": "double", "t": "long", "alt_m": "double", "accuracy_m": "double"}
#: What makes the events of an artifact, by (pipeline, kind), and of a raw segment, by resource: functions without arguments to an array of events.
EXPANDERS: dict[tuple[str, str], Callable[[], Column]] = {}
SEGMENT_EXPANDERS: dict[str, Callable[[], Column]] = {}


def expander(pipeline: str, kind: str):
    """Register a column of an artifact's events; it sees start_ms, end_ms and metadata (JSON)."""

    def put(f):
        EXPANDERS[pipeline, kind] = f
        return f

    return put


def segment_expander(resource: str):
    """Register a column of a segment's events; it sees started_at and points."""

    def put(f):
        SEGMENT_EXPANDERS[resource] = f
        return f

    return put


def event(kind: str, at_ms: Column, **fields: Column) -> Column:
    """An event of ``kind`` with the given fields and nulls for the others."""
    own = {"at_ms": at_ms, "type": F.lit(kind), "rank": F.lit(rank_of(kind)), **fields}
    return F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def noted(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def spanned(kind: str, **fields: Column) -> Column:
    return event(kind, F.col("start_ms"), start_ms=F.col("start_ms"), end_ms=F.col("end_ms"), **fields)


@expander("speech-detect", "speech-span")
def speech_span_events() -> Column:
    return F.array(event("speech-start", F.col("start_ms"), confidence=noted("confidence")), event("speech-end", F.col("end_ms"), confidence=noted("confidence")))


@expander("transcribe", "transcript")
def transcript_events() -> Column:
    text = F.coalesce(noted("text"), F.lit(""))
    return F.array(spanned("transcript", text=text, chars=F.coalesce(noted("chars").cast("long"), F.length(text).cast("long")), speaker=noted("speaker"), model=noted("model")))


@expander("audio-tag", "audio-tag")
def audio_tag_events() -> Column:
    return F.array(spanned("audio-tag", labels=F.coalesce(noted("labels"), F.lit("[]")), model=noted("model")))


@expander("sound-span", "sound-span")
def sound_span_events() -> Column:
    """A span without a label gives none."""
    one = F.array(spanned("sound-span", label=noted("label"), peak=noted("peak"), mean=noted("mean"), windows=noted("windows"), model=noted("model")))
    return F.when(F.coalesce(noted("label"), F.lit("")) != "", one)


@segment_expander("location")
def location_point_events() -> Column:
    """Every fix where it lies on the session's timeline, with its coordinates."""
    return F.transform("points", lambda p: event("location-point", p["t"] - epoch_ms(F.col("started_at")), captured_ms=p["t"], **{n: p[n] for n in ("lat", "lon", "alt_m", "accuracy_m")}))


def by_case(cases: list[tuple[Column, Column]]) -> Column:
    """The events of the first case that holds, none if none does."""
    return F.coalesce(*[F.when(when, events) for when, events in cases], F.array().cast(f"array<struct<{EVENT}>>"))


def expanded(artifacts: DataFrame) -> DataFrame:
    """The events of artifacts (session_id, pipeline, kind, start_ms, end_ms, source, metadata) by the registered expanders.

    One pass over the artifacts.  Kinds without an expander and rows without a span give none.
    """
    rows = artifacts if "metadata" in artifacts.columns else artifacts.withColumn("metadata", F.lit(None).cast("string"))
    rows = rows.filter("start_ms is not null and end_ms is not null")
    cases = [((F.col("pipeline") == p) & (F.col("kind") == k), f()) for (p, k), f in EXPANDERS.items()]
    return rows.select("session_id", "source", F.explode(by_case(cases)).alias("e")).select("session_id", "e.*", "source")


def expanded_segments(segments: DataFrame) -> DataFrame:
    """The events of raw segments (session_id, resource, started_at, points, source); resources without an expander give none."""
    cases = [(F.col("resource") == r, f()) for r, f in SEGMENT_EXPANDERS.items()]
    there = segments.schema["points"].dataType.elementType.fieldNames()
    whole = F.transform("points", lambda p: F.struct(*[(p[n] if n in there else F.lit(None)).cast(t).alias(n) for n, t in POINT.items()]))
    return segments.withColumn("points", whole).select("session_id", "source", F.explode(by_case(cases)).alias("e")).select("session_id", "e.*", "source")
