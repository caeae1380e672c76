"""A drained stream is stored by the tasks and not held by the driver."""

import datetime as dt

import pytest

from sessionloom.streaming import sessions as st

FRAMES = "session_id long, sequence long, captured_at timestamp, pcm binary"


@pytest.mark.parametrize("mode", ["append", "update"])
@pytest.mark.parametrize("n", [0, 7])
def test_drained_rows_lie_in_files(spark, tmp_path, mode, n):
    if n:
        rows = [(1, i % 5, dt.datetime(2024, 1, 1), b"ab") for i in range(n)]
        spark.createDataFrame(rows, FRAMES).write.parquet(f"{tmp_path}/in")
    else:
        (tmp_path / "in").mkdir()
    frames = spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in")
    out = st.drained(st.deduplicated(frames) if mode == "append" else st.progress(frames), f"t_files_{mode}{n}", mode)
    assert out.count() == (0 if not n else 5 if mode == "append" else 1)
    assert out.columns == (frames.columns if mode == "append" else ["session_id", "through", "stored", "bytes", "duplicates"])
    assert bool(out.inputFiles()) == bool(n)  # a memory sink's table has no files
    if n and mode == "update":
        assert [(r["through"], r["stored"], r["duplicates"]) for r in out.collect()] == [(4, 5, 2)]
