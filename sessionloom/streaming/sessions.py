"""Structured Streaming over session frames, each operator with a batch twin that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sessionloom.functions.scalars import epoch_ms
from sessionloom.functions.storage import committed, shared_dir

#: A frame: its session, its number there, when it was taken, its bytes.
FRAME = "session_id long, sequence long, captured_at timestamp, pcm binary"
ROCKS_DB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PROGRESS = "session_id long, through long, stored long, bytes long, duplicates long"


def deduplicated(frames: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The first frame of each (session, sequence); a stream remembers keys within the watermark."""
    if frames.isStreaming:
        frames.sparkSession.conf.set(*ROCKS_DB)  # keys on disk, not in the heap
        return frames.withWatermark("captured_at", watermark).dropDuplicatesWithinWatermark(["session_id", "sequence"])
    return frames.dropDuplicates(["session_id", "sequence"])


class Pool:
    """A fold of a session's frames, in order, into chunks; its state is the open chunk.

    A chunk ends when it has ``max_bytes``, before a frame ``max_ms`` after its first, or
    when it is closed.
    """

    columns = "sequence long, captured_at timestamp, first_frame long, last_frame long, frames long, pcm binary"
    state = "since long, first long, last long, n long, pcm binary"
    empty = (None, None, None, None, None)

    def __init__(self, max_bytes: int, max_ms: int):
        self.max_bytes, self.max_ms = max_bytes, max_ms

    def step(self, state: tuple, frame: tuple) -> tuple[list[tuple], tuple]:
        """frame: (sequence, captured_at in microseconds, pcm, trigger)."""
        out, (sequence, at, pcm, _) = [], frame
        if state[0] is not None and at - state[0] >= self.max_ms * 1000:
            out, state = self.close(state)
        state = (at, sequence, sequence, 1, pcm) if state[0] is None else (state[0], state[1], sequence, state[3] + 1, state[4] + pcm)
        if len(state[4]) >= self.max_bytes:
            more, state = self.close(state)
            out = out + more
        return out, state

    def close(self, state: tuple) -> tuple[list[tuple], tuple]:
        if state[0] is None:
            return [], state
        since, first, last, n, pcm = state
        return [(last, since, first, last, n, bytes(pcm))], self.empty

    def due(self, state: tuple) -> int | None:
        """When (ms) an open chunk is closed whatever comes."""
        return None if state[0] is None else -(-state[0] // 1000) + self.max_ms


class Gate:
    """A fold of a session's frames, in order, into windows that a trigger opens.

    Audio is measured in bytes.  A window takes the fewest last frames that make
    ``before`` bytes, the triggering one included, then frames until ``window`` bytes have
    come after that; then the gate is armed again.  The trigger is the frame's own or,
    with ``pattern``, that these bytes end in it, over any number of frames since the
    gate was armed.  Its state: windows so far, bytes left, the last frames, and the last
    bytes that a match could go on from.
    """

    columns = "window_no long, sequence long, bytes long"
    state = "n long, rest long, seqs array<bigint>, sizes array<bigint>, tail binary"
    empty = (0, 0, [], [], b"")

    def __init__(self, before: int, window: int, pattern: bytes | None):
        self.before, self.window, self.pattern = before, window, pattern

    def step(self, state: tuple, frame: tuple) -> tuple[list[tuple], tuple]:
        n, left, seqs, sizes, tail = state
        sequence, size, hit = frame[0], len(frame[2]), frame[3]
        seqs, sizes = [*seqs, sequence], [*sizes, size]
        while len(seqs) > 1 and sum(sizes) - sizes[0] >= self.before:
            seqs, sizes = seqs[1:], sizes[1:]
        if left > 0:
            return [(n, sequence, size)], (n, left - size, seqs, sizes, b"")
        if self.pattern:
            heard = bytes(tail) + frame[2]
            hit, tail = self.pattern in heard, heard[max(0, len(heard) - len(self.pattern) + 1) :]
        if hit:
            return [(n + 1, *x) for x in zip(seqs, sizes, strict=True)], (n + 1, self.window, seqs, sizes, b"")
        return [], (n, left, seqs, sizes, tail)

    def close(self, state: tuple) -> tuple[list[tuple], tuple]:
        return [], state

    def due(self, state: tuple) -> int | None:
        return None


def framed(frames: DataFrame) -> DataFrame:
    """The columns that folds read, in their order."""
    trigger = F.col("trigger") if "trigger" in frames.columns else F.lit(False)
    return frames.select("session_id", "sequence", "captured_at", "pcm", trigger.cast("boolean").alias("trigger"))


def folded(frames: DataFrame, fold) -> DataFrame:
    """A fold over each session's frames in order of sequence (batch); of equal sequences the first captured counts.

    A task reads its sessions' frames from a sort, one after another, and holds the
    fold's state alone.
    """
    kinds = {"long": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}
    names = ["session_id", *(x.split()[0] for x in fold.columns.split(", "))]
    types = [pa.int64(), *(kinds[x.split()[1]] for x in fold.columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last, state, out, size = None, None, None, [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for batch in batches:
            columns = [batch.column(k).cast(pa.int64()) if k == 2 else batch.column(k) for k in range(5)]
            for key, sequence, at, pcm, trigger in zip(*(c.to_pylist() for c in columns), strict=True):
                if state is None or key != session:
                    if state is not None:
                        out += [(session, *r) for r in fold.close(state)[0]]
                    session, last, state = key, None, fold.empty
                if sequence == last:
                    continue
                last = sequence
                rows, state = fold.step(state, (sequence, at, pcm or b"", bool(trigger)))
                out += [(session, *r) for r in rows]
                size += len(pcm or b"")
                if out and size > 4 << 20:
                    yield batch_of()
                    out, size = [], 0
        if state is not None:
            out += [(session, *r) for r in fold.close(state)[0]]
        if out:
            yield batch_of()

    ordered = framed(frames).filter("sequence is not null").repartition("session_id").sortWithinPartitions("session_id", "sequence", "captured_at")
    return ordered.mapInArrow(run, f"session_id long, {fold.columns}")


class InOrder(StatefulProcessor):
    """A fold over each session's frames in order of sequence, whichever micro-batch brings them.

    A frame is folded at once when all before it have been (from sequence 0 on);
    others wait in a list until the gap fills or event time, ``grace_ms`` ahead of the
    watermark, has passed their capture.  A frame at or below what has been folded is
    refused: ``late`` if its gap was given up, else ``duplicate``.  Timers close what is
    due, and drop all state of a session whose last frame is ``idle_ms`` old.
    """

    def __init__(self, fold, grace_ms: int, idle_ms: int):
        self.fold, self.grace_ms, self.idle_ms = fold, grace_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "sequence long, at long, pcm binary, trigger boolean")
        self.gaps = handle.getListState("gaps", "first long, last long")
        self.at = handle.getValueState("at", f"through long, seen long, timer long, n_waiting int, n_gaps int, {self.fold.state}")

    def load(self) -> tuple[int, int, int | None, tuple, list, list]:
        """What is kept of the session; ``at`` says what else there is, as each look at the store is a round trip."""
        held = self.at.get()
        if held is None:
            return -1, 0, None, self.fold.empty, [], []
        through, seen, timer, n_waiting, n_gaps, *state = held
        waiting = sorted(tuple(r) for r in self.waiting.get()) if n_waiting else []
        gaps = [tuple(r) for r in self.gaps.get()] if n_gaps else []
        return through, seen, timer, tuple(state), waiting, gaps

    def advance(self, key: tuple, new: list[tuple], now_ms: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Fold what is in order or given up, close what is due, and keep the rest; ``now_ms``: the watermark, ``fired``: the timer, which Spark deletes."""
        through, seen, timer, state, waiting, gaps = self.load()
        known, had_waiting, had_gaps = timer is not None, bool(waiting), len(gaps)
        out, refused, there = [], [], {w[0] for w in waiting}
        for frame in sorted(new):
            seen = max(seen, frame[1] // 1000)
            if frame[0] <= through:
                refused.append((frame[0], frame[1], "late" if any(a <= frame[0] <= b for a, b in gaps) else "duplicate"))
            elif frame[0] in there:
                refused.append((frame[0], frame[1], "duplicate"))
            else:
                there.add(frame[0])
                waiting.append(frame)
        waiting.sort()
        passed = (now_ms + self.grace_ms) * 1000
        given_up = max((k for k, w in enumerate(waiting) if w[1] <= passed), default=-1)
        k = 0
        while k < len(waiting) and (waiting[k][0] == through + 1 or k <= given_up):
            if waiting[k][0] > through + 1:
                gaps.append((through + 1, waiting[k][0] - 1))
            rows, state = self.fold.step(state, waiting[k])
            out += rows
            through = waiting[k][0]
            k += 1
        waiting = waiting[k:]
        due = self.fold.due(state)
        if due is not None and due <= now_ms + self.grace_ms:
            rows, state = self.fold.close(state)
            out, due = out + rows, None
        then = None  # the session's one timer from now on
        if waiting or due is not None or now_ms < seen + self.idle_ms:
            at = [seen + self.idle_ms, *([due - self.grace_ms] if due is not None else []), *(w[1] // 1000 + 1 - self.grace_ms for w in waiting)]
            then = max(min(at), now_ms + 1)
            more_gaps, gaps = len(gaps) > had_gaps, gaps[-1000:]
            self.at.update((through, seen, then, len(waiting), len(gaps), *state))
            if waiting:
                self.waiting.put(waiting)
            if more_gaps:
                self.gaps.put(gaps)
        elif known:
            self.at.clear()
        if had_waiting and not waiting:
            self.waiting.clear()
        if had_gaps and then is None:
            self.gaps.clear()
        if timer != then:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if then is not None:
                self.handle.registerTimer(then)
        if out or refused:
            yield self.frame(key, out, refused)

    def frame(self, key: tuple, out: list[tuple], refused: list[tuple]) -> pd.DataFrame:
        """Rows of the fold, and of refused frames, as the columns of the output."""
        kinds = {x.split()[0]: x.split()[1] for x in self.fold.columns.split(", ")}
        columns = dict(zip(kinds, map(list, zip(*out, strict=True)), strict=True)) if out else {}
        kinds.setdefault("captured_at", "timestamp")
        kinds["refused"] = "string"
        columns = {name: columns.get(name) or [None] * len(out) for name in kinds}
        for name, values in columns.items():
            values += [{"sequence": q, "captured_at": at, "refused": why}.get(name) for q, at, why in refused]
        pdf = {"session_id": np.full(len(out) + len(refused), key[0], "int64")}
        for name, kind in kinds.items():
            if kind == "timestamp":
                pdf[name] = np.array(columns[name], "datetime64[us]")
            else:
                pdf[name] = pd.array(columns[name], "Int64") if kind == "long" else np.fromiter(columns[name], object, len(columns[name]))
        return pd.DataFrame(pdf)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for pdf in rows:
            at = pdf["captured_at"].to_numpy().astype("datetime64[us]").view("int64")
            new += [(int(q), int(t), bytes(p) if p is not None else b"", bool(g)) for q, t, p, g in zip(pdf["sequence"].to_numpy(), at, pdf["pcm"].to_numpy(), pdf["trigger"].to_numpy(), strict=True)]
        yield from self.advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def in_order(frames: DataFrame, fold, *, watermark_ms: int, grace_ms: int, idle_ms: int) -> DataFrame:
    """The fold's rows of a stream of frames, and a row with ``refused`` for each frame that came too late or twice.

    Frames captured up to ``watermark_ms`` before the latest are waited for; those up to
    ``grace_ms`` older still come out as refused, Spark drops what is older.  The state
    store must be RocksDB's; it is set for the session.
    """
    frames.sparkSession.conf.set(*ROCKS_DB)
    more = "" if "captured_at" in fold.columns else "captured_at timestamp, "
    timed = framed(frames).filter("sequence is not null and captured_at is not null").withWatermark("captured_at", f"{watermark_ms + grace_ms} milliseconds")
    return timed.groupBy("session_id").transformWithStateInPandas(InOrder(fold, grace_ms, idle_ms), f"session_id long, {fold.columns}, {more}refused string", "append", "eventTime")


def pooled(frames: DataFrame, *, max_bytes: int = 262_144, max_ms: int = 10_000, watermark_ms: int = 10_000, grace_ms: int = 60_000, idle_ms: int = 600_000) -> DataFrame:
    """Frames of a session joined in order into chunks: flushed at ``max_bytes``, before a frame ``max_ms`` after the first, or at the end.

    A stream gives the same chunks however its frames lie in micro-batches, the open one
    once event time is ``max_ms`` past its first frame, and refused frames (see ``in_order``).
    """
    fold = Pool(max_bytes, max_ms)
    return in_order(frames, fold, watermark_ms=watermark_ms, grace_ms=grace_ms, idle_ms=idle_ms) if frames.isStreaming else folded(frames, fold)


def progress(frames: DataFrame, *, watermark_ms: int = 86_400_000, idle_ms: int = 86_400_000) -> DataFrame:
    """Per session: the last sequence with no gap before it (from 0; -1 if 0 is missing), frames stored, bytes, duplicates.

    A stream holds the sequences beyond the gap and gives a row per session and batch;
    ``idle_ms`` of event time after a session's last frame its state goes.
    """
    if not frames.isStreaming:
        n = frames.groupBy("session_id", "sequence").agg(F.count("*").alias("k"), F.first(F.length("pcm")).alias("b"))
        n = n.withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy("sequence")) - 1)
        return n.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("sequence") == F.col("i"), F.col("sequence"))), F.lit(-1)).cast("long").alias("through"), F.count("*").alias("stored"), F.sum("b").cast("long").alias("bytes"), (F.sum("k") - F.count("*")).alias("duplicates"))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        through, stored, size, duplicates, beyond, seen = state.get if state.exists else (-1, 0, 0, 0, [], 0)
        beyond = set(beyond)
        for pdf in pdfs:
            seen = max(seen, int(pd.Timestamp(pdf["captured_at"].max()).timestamp() * 1000))
            for sequence, pcm in pdf.sort_values("sequence")[["sequence", "pcm"]].itertuples(index=False, name=None):
                if sequence <= through or sequence in beyond:
                    duplicates += 1
                    continue
                beyond.add(int(sequence))
                stored, size = stored + 1, size + len(pcm)
                while through + 1 in beyond:
                    through += 1
                    beyond.discard(through)
        state.update((through, stored, size, duplicates, sorted(beyond), seen))
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], through, stored, size, duplicates)], columns=["session_id", "through", "stored", "bytes", "duplicates"])

    timed = frames.withWatermark("captured_at", f"{watermark_ms} milliseconds")
    return timed.groupBy("session_id").applyInPandasWithState(step, PROGRESS, "through long, stored long, bytes long, duplicates long, beyond array<long>, seen long", "update", GroupStateTimeout.EventTimeTimeout)


def gated(frames: DataFrame, *, before_ms: int = 2_000, window_ms: int = 30_000, bytes_per_ms: float = 32, pattern: bytes | None = None, watermark_ms: int = 10_000, grace_ms: int = 60_000, idle_ms: int = 600_000) -> DataFrame:
    """Frames in windows that a trigger opens: the ``before_ms`` up to it, then on until ``window_ms`` more of audio; then armed again (see ``Gate``).

    frames: session_id, sequence, captured_at, pcm, trigger (boolean: what a detector says
    of the frame; not needed with ``pattern``).  A stream gives the same windows however
    its frames lie in micro-batches, and refused frames (see ``in_order``).
    """
    fold = Gate(round(before_ms * bytes_per_ms), round(window_ms * bytes_per_ms), pattern)
    return in_order(frames, fold, watermark_ms=watermark_ms, grace_ms=grace_ms, idle_ms=idle_ms) if frames.isStreaming else folded(frames, fold)


def window_effects(gated_frames: DataFrame) -> DataFrame:
    """Frames and bytes of each gated window."""
    return gated_frames.groupBy("session_id", "window_no").agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"))


def triggered(frames: DataFrame, pattern: bytes) -> DataFrame:
    """Adds ``trigger``: the pattern ends in this frame, begun in it or in any frame before (batch).

    A match can go back over as many frames that aren't empty as the pattern has bytes,
    of each no more bytes than that: a window of so many short tails.
    """
    keep = len(pattern) - 1
    if keep < 0:
        raise ValueError("the pattern is empty")
    some = F.length(F.coalesce("pcm", F.lit(b""))) > 0
    w = Window.partitionBy("session_id", "_some").orderBy("sequence").rowsBetween(-keep, -1)
    t = frames.withColumn("_some", some).withColumn("_end", F.expr(f"substring(pcm, greatest(length(pcm) - {keep} + 1, 1), {keep})"))
    # binary pieces joined as hexadecimal text, two digits a byte
    before = F.array_join(F.transform(F.collect_list("_end").over(w), lambda x: F.hex(x)), "") if keep else F.lit("")
    t = t.withColumn("_all", F.concat(F.substring(before, -2 * keep, 2 * keep) if keep else F.lit(""), F.hex("pcm")))
    found = F.unhex("_all").contains(F.lit(pattern))
    return t.withColumn("trigger", F.coalesce(F.col("_some") & found, F.lit(False))).drop("_some", "_end", "_all")


def idle_sessions(activity: DataFrame, *, idle: str = "300 seconds", watermark: str = "10 minutes") -> DataFrame:
    """(user_id, started_at, ended_at, events): activity cut where it rests for ``idle``; an end is the last event plus that."""
    a = activity.withWatermark("ts", watermark) if activity.isStreaming else activity
    g = a.groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def heartbeats(activity: DataFrame, *, every_ms: int = 60_000) -> DataFrame:
    """(user_id, last_at): the activity times that are written when one is only once the last written is older than ``every_ms`` (batch).

    After a rest longer than that the next one is written whatever came before, so
    rests cut the data into islands; each is folded on its own.
    """
    w = Window.partitionBy("user_id").orderBy("ts")
    t = F.unix_micros("ts")
    a = activity.filter("ts is not null").select("user_id", "ts", t.alias("t"), F.coalesce((t - F.lag(t).over(w) > every_ms * 1000).cast("int"), F.lit(1)).alias("new"))
    a = a.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    times = a.groupBy("user_id", "island").agg(F.array_sort(F.collect_list("t")).alias("times"))
    last = lambda out: F.element_at(out, -1)
    kept = F.aggregate(F.slice("times", 2, F.size("times")), F.slice("times", 1, 1), lambda out, x: F.when(x - last(out) > every_ms * 1000, F.concat(out, F.array(x))).otherwise(out))
    return times.select("user_id", F.explode(kept).alias("t")).select("user_id", F.timestamp_micros("t").alias("last_at"))


def location_events(batches: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Location-point events of location batches (started_at, points), batch or stream, before the session has ended.

    Adds at_ms (the point's epoch ``t`` less the session's start), lat, lon and t.  A
    window keeps events with from_ms <= at_ms < to_ms, whatever batch brought them, so
    that windows side by side part the points.
    """
    points = batches.select(*[c for c in batches.columns if c != "points"], F.explode("points").alias("point"))
    out = points.select("*", (F.col("point.t") - epoch_ms(F.col("started_at"))).alias("at_ms"), "point.lat", "point.lon", "point.t").drop("point")
    out = out if from_ms is None else out.filter(F.col("at_ms") >= from_ms)
    return out if to_ms is None else out.filter(F.col("at_ms") < to_ms)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives, as a batch table in the shared folder; no row passes the driver.

    Spark's file sink takes rows that are appended only; those of other modes are
    written batch by batch, each into a folder of its own.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{path}/rows")
    else:
        q = w.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/rows/micro_batch={number}")).start()
    q.awaitTermination()
    if mode != "append" and not committed(spark, f"{path}/rows", "micro_batch"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
