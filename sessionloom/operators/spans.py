"""Class scores over time: suppression of ancestors, tags of a session, hysteresis spans, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.storage import discard, written
from sessionloom.operators.intervals import with_island


def exploded(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window and usable label (a name and a finite score); windows without sound bounds go."""
    w = windows.filter("start_ms is not null and end_ms is not null and end_ms > start_ms").select(*keys, "start_ms", "end_ms", F.explode("labels").alias("l"))
    out = w.select(*keys, "start_ms", "end_ms", F.col("l.label").alias("label"), F.col("l.score").alias("score"))
    return out.filter((F.col("label") != "") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))


def first_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Of windows with one start, the one that ends first."""
    w = Window.partitionBy(*keys, "start_ms").orderBy("end_ms")
    return windows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_of_equal(windows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Of windows with one start and end, the one that came first by the columns ``arrival``."""
    w = Window.partitionBy(*keys, "start_ms", "end_ms").orderBy(*arrival)
    return windows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def closure(edges: DataFrame, *, max_depth: int = 64) -> DataFrame:
    """(label, ancestor) pairs of a parent table (label, parent), with cycles broken; edges grow by doubling, each round written out."""
    found = written(edges.select("label", F.col("parent").alias("ancestor")).filter("label is not null and ancestor is not null and label != ancestor").distinct(), "closure")
    n, depth = found.count(), 1
    while depth <= max_depth:
        step = found.alias("a").join(found.alias("b"), F.col("a.ancestor") == F.col("b.label")).select("a.label", "b.ancestor").filter("label != ancestor")
        more = written(found.union(step).distinct(), "closure")
        discard(found)
        found, before, n = more, n, more.count()
        if n == before:
            break
        depth *= 2
    return found


def without_ancestors(labels: DataFrame, ancestry: DataFrame, keys: list[str]) -> DataFrame:
    """Drops a label of a window if a descendant in the same window scores at least as much.

    labels: keys, label, score.
    """
    l, d = labels, labels.select(*keys, F.col("label").alias("child"), F.col("score").alias("child_score"))
    beaten = d.join(ancestry, d["child"] == ancestry["label"]).select(*keys, F.col("ancestor").alias("label"), "child_score")
    beaten = beaten.groupBy(*keys, "label").agg(F.max("child_score").alias("_best"))
    return l.join(beaten, [*keys, "label"], "left").filter(F.col("_best").isNull() | (F.col("_best") < F.col("score"))).drop("_best")


def session_tags(windows: DataFrame, keys: list[str], *, threshold: float = 0.3, min_run: int = 2, top_k: int = 15) -> DataFrame:
    """(keys, label, score, rank): labels at or over ``threshold`` in ``min_run`` windows in a row (or in all, if fewer), best first."""
    w = first_windows(windows, keys)
    w = w.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms"))).withColumn("_total", F.count("*").over(Window.partitionBy(*keys)))
    l = w.select(*keys, "_i", "_total", F.explode("labels").alias("l")).select(*keys, "_i", "_total", F.col("l.label").alias("label"), F.col("l.score").alias("score")).filter(F.col("score") >= threshold)
    l = l.groupBy(*keys, "_i", "_total", "label").agg(F.max("score").alias("score"))
    by = Window.partitionBy(*keys, "label").orderBy("_i")
    runs = l.withColumn("_run", F.col("_i") - F.row_number().over(by)).groupBy(*keys, "label", "_run", "_total").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    tags = runs.groupBy(*keys, "label", "_total").agg(F.max("n").alias("n"), F.max("score").alias("score")).filter(F.col("n") >= F.least(F.lit(min_run), "_total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "label"))
    return tags.withColumn("rank", rank).filter(F.col("rank") <= top_k).select(*keys, "label", "score", "rank")


def hysteresis_spans(scored: DataFrame, keys: list[str], *, enter: float = 0.40, sustain: float = 0.30, bridge_ms: int = 5_000, min_windows: int = 3, monotone: bool = True) -> DataFrame:
    """(keys, label, start_ms, end_ms, windows, peak, mean) of class scores (keys, label, start_ms, end_ms, score).

    A span opens at ``enter``, goes on with windows at ``sustain`` or more, bridges up
    to ``bridge_ms`` and needs ``min_windows`` windows.  On a regular grid (``monotone``:
    ends grow with starts) this is window SQL; otherwise a fold per session and label.
    Of equal windows the one that came first counts: choose it before (``first_of_equal``);
    of scores still equal in window and label the highest is taken.
    """
    by = [*keys, "label"]
    first = Window.partitionBy(*by, "start_ms", "end_ms").orderBy(F.col("score").desc())
    members = scored.filter(F.col("score") >= sustain).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    if not monotone:
        return _hysteresis_fold(members, by, enter, bridge_ms, min_windows)
    isl = with_island(members, by, bridge_ms)
    w = Window.partitionBy(*by, "island").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, 0)
    opened = isl.withColumn("_open", F.max((F.col("score") >= enter).cast("int")).over(w)).filter("_open = 1")
    spans = opened.groupBy(*by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("windows"), F.max("score").alias("peak"), F.avg("score").alias("mean"))
    return spans.filter(F.col("windows") >= min_windows).drop("island")


def _hysteresis_fold(members: DataFrame, by: list[str], enter: float, bridge_ms: int, min_windows: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in by), "start_ms long, end_ms long, windows long, peak double, mean double"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        spans, now = [], None
        for s, e, v in pdf.sort_values(["start_ms", "end_ms"])[["start_ms", "end_ms", "score"]].itertuples(index=False):
            if now and s - now[1] > bridge_ms:
                spans.append(now)
                now = None
            if now:
                now = [now[0], max(now[1], e), [*now[2], v]]
            elif v >= enter:
                now = [s, e, [v]]
        spans += [now] if now else []
        head = [pdf.iloc[0][k] for k in by]
        return pd.DataFrame([[*head, s, e, len(v), max(v), sum(v) / len(v)] for s, e, v in spans if len(v) >= min_windows], columns=[*by, "start_ms", "end_ms", "windows", "peak", "mean"])

    return members.groupBy(*by).applyInPandas(fold, schema)


def selected_spans(spans: DataFrame, keys: list[str], *, top_k: int = 8, max_spans: int = 2_000) -> DataFrame:
    """The spans of a session's ``top_k`` classes by covered time (then peak, then name), whole classes while their spans stay within ``max_spans``.

    If even the first class has more, its longest spans fill the budget.
    """
    classes = spans.groupBy(*keys, "label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").alias("n"), F.max("peak").alias("class_peak"))
    rank = Window.partitionBy(*keys).orderBy(F.col("total_ms").desc(), F.col("class_peak").desc(), "label")
    ranked = classes.withColumn("class_rank", F.row_number().over(rank)).filter(F.col("class_rank") <= top_k)
    running = F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("_sum", running).filter((F.col("_sum") <= max_spans) | (F.col("class_rank") == 1)).drop("_sum")
    out = spans.join(kept.select(*keys, "label", "class_rank", "n"), [*keys, "label"])
    longest = F.row_number().over(Window.partitionBy(*keys, "label").orderBy((F.col("end_ms") - F.col("start_ms")).desc(), "start_ms"))
    return out.withColumn("_i", longest).filter((F.col("n") <= max_spans) | (F.col("_i") <= max_spans)).drop("_i", "n")


def class_lanes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage per class: spans, total_ms, peak, ranked by time covered."""
    s = spans.groupBy(*keys, "label").agg(F.count("*").alias("spans"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.max("peak").alias("peak"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total_ms").desc(), F.col("peak").desc(), "label")))


def tag_search(windows: DataFrame, keys: list[str], needle: str, *, min_score: float, limit: int) -> DataFrame:
    """Windows with a class whose name holds ``needle`` (case folded), one row per window, best first."""
    hit = exploded(windows, keys).filter(F.col("label").ilike(f"%{needle}%") & (F.col("score") >= min_score))
    best = F.row_number().over(Window.partitionBy(*keys, "start_ms").orderBy(F.col("score").desc(), "label"))
    return hit.withColumn("_n", best).filter("_n = 1").drop("_n").orderBy(F.col("score").desc(), *keys, "start_ms").limit(limit)


def tag_vocabulary(windows: DataFrame, keys: list[str]) -> DataFrame:
    return exploded(windows, keys).groupBy("label").agg(F.count("*").alias("windows"), F.max("score").alias("max_score"))
