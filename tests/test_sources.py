"""Readers over files: artifacts by partition, segments and their bytes, ranges, clips, answers with bad values."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import pcm
from sessionloom.operators import spans as sp
from sessionloom.sources import artifacts as ar
from sessionloom.sources import ranges as rg


@pytest.fixture
def store(tmp_path):
    """Four segments in two folders, two of one name; a file that no row knows."""
    rows, audio = [], (np.arange(4000) % 911).astype("<i2").tobytes()
    cuts = [0, 1500, 1501 * 2, 5000, 8000]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        path, body = f"{'ab'[i % 2]}/seg{i // 2}.wav", b"h" * 44 + audio[a:b]
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(body)
        rows.append(("s", i, path, len(body), hashlib.sha256(body).hexdigest() if i != 2 else "0" * 64))
    (tmp_path / "a" / "lost.wav").write_bytes(b"lost")
    return str(tmp_path), rows, audio


SEGMENT = "session_id string, sequence long, path string, byte_size long, sha256 string"


def test_segment_bytes_and_orphans(spark, store):
    root, rows, _ = store
    segments = spark.createDataFrame([*rows, ("t", 9, "a/none.wav", 5, "0")], SEGMENT)
    got = {r["path"]: r for r in ar.segment_bytes(spark, segments, root).collect()}
    for _, i, path, size, _ in rows:
        assert len(got[path]["content"]) == size and got[path]["valid"] == (i != 2)
        with open(f"{root}/{path}", "rb") as f:
            assert bytes(got[path]["content"]) == f.read()
    assert got["a/none.wav"]["content"] is None and got["a/none.wav"]["valid"] is None
    assert [tuple(r) for r in ar.orphans(spark, segments, f"file://{root}").collect()] == [("a/lost.wav", 4)]


def test_ranges_read_what_is_asked(spark, store):
    root, rows, audio = store
    asked = [(p, o, n) for _, _, p, size, _ in rows for o, n in ((0, 4), (44, 10), (size - 3, 10), (size + 5, 2), (100, 0))] + [("a/none.wav", 0, 3), (None, 0, 3), ("a/seg0.wav", None, 3)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "id long, path string, offset long, length long").repartition(3)
    got = {r["id"]: r["content"] for r in rg.read_ranges(df, root).collect()}
    for i, (p, o, n) in enumerate(asked):
        if p is None or o is None or not os.path.exists(f"{root}/{p}"):
            assert got[i] is None
        else:
            with open(f"{root}/{p}", "rb") as f:
                assert bytes(got[i]) == f.read()[o : o + n]


def test_clips_over_seams(spark, store):
    root, rows, audio = store
    segments = spark.createDataFrame(rows, SEGMENT)
    wanted = [("s", f"c{a}", a, b) for a, b in ((0, 10), (40, 60), (5, 249), (100, 100), (240, 999))]
    w = spark.createDataFrame(wanted, "session_id string, clip_id string, start_ms long, end_ms long")
    got = {r["clip_id"]: bytes(r["pcm"]) for r in rg.clips_of_files(segments, w, root).collect()}
    assert got == {c: audio[a * 32 : b * 32] for _, c, a, b in wanted}
    asked = rg.clip_ranges(segments, w).agg(F.sum("length")).first()[0]
    assert asked == sum(len(x) for x in got.values())
    whole = ar.segment_bytes(spark, segments, root).select("session_id", "sequence", "content")
    assert {r["clip_id"]: bytes(r["pcm"]) for r in pcm.clips(whole, w).collect()} == got


def test_artifacts_by_partition(spark, tmp_path):
    rows = [(f"a{i}", f"s{i % 3}", p, k, i * 10, i * 10 + 5, None, "{}", None) for i, (p, k) in enumerate([("asr", "transcript"), ("tags", "window"), ("asr", "other")] * 4)]
    spark.createDataFrame(rows, ar.ARTIFACT).write.partitionBy("pipeline", "kind").parquet(f"{tmp_path}/x")
    got = ar.artifacts(spark, f"{tmp_path}/x", pipeline="asr", kind="transcript")
    assert {r["artifact_id"] for r in got.collect()} == {f"a{i}" for i in range(0, 12, 3)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pipeline" in plan and "kind" in plan.split("PartitionFilters")[1][:200]
    assert [r["artifact_id"] for r in ar.of_session(got, "s0", from_ms=50).collect()] == ["a6", "a9"]


def test_summaries_by_session(spark, tmp_path):
    ar.session_summaries(spark.createDataFrame([("s1", 3), ("s2", 4)], "session_id string, n int"), f"{tmp_path}/x")
    assert sorted(os.listdir(f"{tmp_path}/x"))[-2:] == ["session_id=s1", "session_id=s2"]
    assert {(r["session_id"], r["n"]) for r in spark.read.json(f"{tmp_path}/x").collect()} == {("s1", 3), ("s2", 4)}


def test_bad_windows_and_labels(spark):
    label = lambda name, score: {"label": name, "score": score}
    answer = [{"start_ms": 0, "end_ms": 10, "labels": [label("a", 0.5)]}, {"start_ms": 5, "end_ms": 5, "labels": [label("a", 0.5)]}, {"start_ms": None, "end_ms": 9, "labels": [label("a", 0.5)]}, {"start_ms": 1, "end_ms": 9, "labels": [label(None, 0.5)]}, {"start_ms": 2, "end_ms": 9, "labels": [label("b", None)]}]
    raw = spark.createDataFrame([("s", json.dumps(answer)), ("t", "no json")], "session_id string, response string")
    assert [(r["session_id"], r["start_ms"]) for r in ar.model_windows(raw).collect()] == [("s", 0)]
    nan = float("nan")
    w = spark.createDataFrame([("s", 0, 10, [("a", 0.5), ("", 0.9), (None, 0.9), ("b", None), ("c", nan), ("d", float("inf"))]), ("s", 7, 7, [("a", 1.0)]), ("s", None, 9, [("a", 1.0)]), ("s", 9, 3, [("a", 1.0)]), ("s", 20, 30, None)], "session_id string, start_ms long, end_ms long, labels array<struct<label: string, score: double>>")
    assert [(r["start_ms"], r["label"], r["score"]) for r in sp.exploded(w, ["session_id"]).collect()] == [(0, "a", 0.5)]


def test_first_of_equal_windows(spark):
    rows = [("s", 0, 10, 2, [("a", 0.9)]), ("s", 0, 10, 1, [("a", 0.35)]), ("s", 0, 12, 3, [("a", 0.8)])]
    w = spark.createDataFrame(rows, "session_id string, start_ms long, end_ms long, came long, labels array<struct<label: string, score: double>>")
    kept = sp.first_of_equal(w, ["session_id"], ["came"])
    assert sorted((r["end_ms"], r["came"]) for r in kept.collect()) == [(10, 1), (12, 3)]
    spans = lambda x: [(r["start_ms"], r["end_ms"], r["peak"]) for r in sp.hysteresis_spans(sp.exploded(x, ["session_id"]), ["session_id"], min_windows=2).collect()]
    assert spans(kept) == []  # the window that came first doesn't open a span
    assert spans(w) == [(0, 12, 0.9)]
