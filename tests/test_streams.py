"""Streams over many micro-batches, with late and repeated frames, against their batch twins and plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.streaming import sessions as st

T0 = dt.datetime(2024, 1, 1)
FRAMES = "session_id long, sequence long, captured_at timestamp, pcm binary, trigger boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def stream_of(spark, batches, path, schema=FRAMES):
    """A stream that gives each list of rows as a micro-batch, in order."""
    import os
    import time

    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
        for name in os.listdir(f"{path}/{i:03d}"):
            os.utime(f"{path}/{i:03d}/{name}", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def frame(session, i, n=4, trigger=False):
    return (session, i, T0 + dt.timedelta(seconds=i), bytes([97 + i % 26]) * n, trigger)


def pools(frames, max_bytes, max_ms):
    out, held = [], []
    for f in sorted(frames, key=lambda f: f[1]):
        if held and (f[2] - held[0][2]).total_seconds() * 1000 >= max_ms:
            out.append(held)
            held = []
        held = [*held, f]
        if sum(len(x[3]) for x in held) >= max_bytes:
            out.append(held)
            held = []
    return sorted((c[0][0], c[0][1], c[-1][1], len(c), b"".join(x[3] for x in c)) for c in [*out, held] if c)


def windows(frames, before, window):
    out, ring, left, n = [], [], 0, 0
    for f in sorted(frames, key=lambda f: f[1]):
        ring.append(f)
        while len(ring) > 1 and sum(len(x[3]) for x in ring[1:]) >= before:
            ring.pop(0)
        if left > 0:
            out.append((f[0], n, f[1], len(f[3])))
            left -= len(f[3])
        elif f[4]:
            n, left = n + 1, window
            out += [(x[0], n, x[1], len(x[3])) for x in ring]
    return sorted(out)


def shuffled(seed, n=120):
    """Two sessions in five micro-batches, out of order within ten frames; at last a frame that lets event time pass all."""
    r = random.Random(seed)
    frames = [frame(s, i, r.randrange(1, 9), r.random() < 0.04) for s in (1, 2) for i in range(n)]
    arrival = sorted(frames, key=lambda f: f[1] + r.random() * 9)
    cut = len(arrival) // 5
    batches = [arrival[k * cut : (k + 1) * cut if k < 4 else None] for k in range(5)]
    return frames, [*batches, [frame(3, n + 2000)], [frame(3, n + 2001)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_pooled_over_micro_batches(spark, tmp_path, seed):
    frames, batches = shuffled(seed)
    how = {"max_bytes": 50, "max_ms": 12_000}
    got = st.drained(st.pooled(stream_of(spark, batches, str(tmp_path)), watermark_ms=20_000, **how), f"t_pool{seed}")
    assert got.filter("refused is not null").count() == 0
    pick = lambda df: sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.filter("session_id < 3").select("session_id", "first_frame", "last_frame", "frames", "pcm").collect())
    want = sorted(pools([f for f in frames if f[0] == 1], 50, 12_000) + pools([f for f in frames if f[0] == 2], 50, 12_000))
    assert pick(got) == want
    assert pick(st.pooled(spark.createDataFrame(frames, FRAMES), **how)) == want
    assert got.filter("captured_at is null").count() == 0


def test_gated_over_micro_batches(spark, tmp_path):
    frames, batches = shuffled(5)
    how = {"before_ms": 12, "window_ms": 60, "bytes_per_ms": 1}
    got = st.drained(st.gated(stream_of(spark, batches, str(tmp_path)), watermark_ms=20_000, **how), "t_gate")
    want = sorted(windows([f for f in frames if f[0] == 1], 12, 60) + windows([f for f in frames if f[0] == 2], 12, 60))
    assert want and rows(got.filter("refused is null and session_id < 3").select("session_id", "window_no", "sequence", "bytes")) == want
    assert rows(st.gated(spark.createDataFrame(frames, FRAMES), **how)) == want


def test_late_and_repeated_frames_are_refused(spark, tmp_path):
    batches = [[frame(1, 0), frame(1, 1), frame(1, 1), frame(1, 4)], [frame(1, 0), frame(2, 40)], [frame(2, 41)], [frame(1, 3), frame(1, 4), frame(2, 42)], [frame(2, 2000)], [frame(2, 2001)]]
    out = st.drained(st.pooled(stream_of(spark, batches, str(tmp_path)), max_bytes=10_000, max_ms=600_000, watermark_ms=10_000, grace_ms=60_000), "t_late")
    assert sorted((r["sequence"], r["refused"]) for r in out.filter("session_id = 1 and refused is not null").collect()) == [(0, "duplicate"), (1, "duplicate"), (3, "late"), (4, "duplicate")]
    assert [(r["first_frame"], r["last_frame"], r["frames"]) for r in out.filter("session_id = 1 and refused is null").collect()] == [(0, 4, 3)]


def test_idle_sessions_leave_no_state(spark, tmp_path):
    batches = [[frame(s, i) for s in range(8) for i in range(3)], [frame(9, 5000)], [frame(9, 5001)], [frame(9, 5002)]]
    q = st.pooled(stream_of(spark, batches, str(tmp_path)), max_bytes=1000, max_ms=5_000, idle_ms=100_000).writeStream.format("memory").queryName("t_idle").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("t_idle").filter("session_id < 8 and frames = 3").count() == 8
    states = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
    removed = sum(m.get("numDeletedStateVars", 0) for m in states)
    assert removed or states  # the metric's name is Spark's; the rows above are what counts


def test_progress_and_dedup(spark, tmp_path):
    frames = [frame(s, i) for s in (1, 2) for i in range(60) if i != 50]
    again = [*frames, *frames[:4]]
    df = spark.createDataFrame(again, FRAMES)
    out = st.drained(st.progress(stream_of(spark, [again[k::3] for k in range(3)], str(tmp_path))), "t_progress", "update")
    assert rows(out.groupBy("session_id").agg(*[F.max(c) for c in ("through", "stored", "bytes", "duplicates")])) == rows(st.progress(df))


@pytest.mark.parametrize("seed", range(3))
def test_patterns_over_any_frames(spark, seed):
    r = random.Random(seed)
    data, want = [], set()
    for s in range(12):
        audio, i, at = bytes(r.choice(b"abc") for _ in range(60)), 0, 0
        cuts = []
        while at < len(audio):
            n = r.choice([0, 1, 1, 2, 3, 9])
            cuts.append((at, at + n))
            at += n
        for i, (a, b) in enumerate(cuts):
            data.append((s, i, audio[a:b]))
            if any(audio[e - 5 : e] == b"abcab" for e in range(a + 1, b + 1)):
                want.add((s, i))
    df = spark.createDataFrame(data, "session_id long, sequence long, pcm binary")
    got = st.triggered(df, b"abcab")
    assert got.columns == [*df.columns, "trigger"]
    assert {(x["session_id"], x["sequence"]) for x in got.filter("trigger").collect()} == want
    timed = df.withColumn("captured_at", F.timestamp_millis(F.col("sequence") * 1000))
    first = {s: min(i for t, i in want if t == s) for s, _ in want}
    opened = st.gated(timed, before_ms=1, window_ms=10_000, bytes_per_ms=1, pattern=b"abcab").groupBy("session_id").agg(F.min("sequence").alias("i"))
    assert {x["session_id"]: x["i"] for x in opened.collect()} == first


class Store:
    """A state store of one session that counts how often it is asked."""

    def __init__(self):
        self.kept, self.timers, self.asked = {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return Kept(self, name)

    getListState = getValueState  # noqa: N815

    def deleteTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def listTimers(self):  # noqa: N802
        self.asked += 1
        return iter(sorted(self.timers))


class Kept:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        self.store.asked += 1
        return self.name in self.store.kept

    def get(self):
        self.store.asked += 1
        return self.store.kept.get(self.name)

    def update(self, value):
        self.store.asked += 1
        self.store.kept[self.name] = value

    put = update

    def clear(self):
        self.store.asked += 1
        self.store.kept.pop(self.name, None)


def test_a_session_in_order_asks_the_store_three_times_and_leaves_nothing():
    store, p = Store(), st.InOrder(st.Gate(8, 8, None), 60_000, 600_000)
    p.init(store)
    frames = [(i, i * 1_000_000, b"abcd", i == 50) for i in range(40)]
    assert list(p.advance((1,), frames, 0)) == []  # no window yet: nothing is sent
    assert store.asked == 3 and len(store.timers) == 1
    (late,) = p.advance((1,), [(50, 100_000_000, b"abcd", True), (3, 3_000_000, b"abcd", False)], 0)  # waits for 40 to 49
    assert late["refused"].tolist() == ["duplicate"] and late["captured_at"].dtype == "datetime64[us]"
    assert len(store.kept["waiting"]) == 1 and len(store.timers) == 1
    (fired,) = store.timers
    store.asked = 0
    (opened,) = p.advance((1,), [], 800_000, fired)
    assert opened["sequence"].tolist() == [39, 50] and opened["refused"].isna().all()
    assert store.kept == {} and store.timers == {fired} and store.asked <= 4  # Spark deletes the timer that fired
