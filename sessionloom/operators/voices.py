"""Who spoke: talk time, labels and what was said by a speaker, rebuilds and merges of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.clustering import clustered, merged_speakers
from sessionloom.operators.vectors import centroids


def talk_time(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """(session_id, voice, talk_ms, turns): a session's talk by speaker, labels without one each for themselves."""
    j = turns.join(speakers.select("session_id", "speaker", "speaker_id"), ["session_id", "speaker"], "left")
    voice = F.coalesce(F.col("speaker_id").cast("string"), F.concat(F.lit("local:"), "speaker"))
    return j.groupBy("session_id", voice.alias("voice")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"), F.count("*").alias("turns"))


def session_labels(labels: DataFrame, members: DataFrame, speakers: DataFrame) -> DataFrame:
    """Every label of a session with the speaker and name it resolves to; labels without one stay, with nulls."""
    known = members.join(speakers.select("speaker_id", "name"), "speaker_id", "left")
    return labels.join(known.select("session_id", "speaker", "speaker_id", "name"), ["session_id", "speaker"], "left")


def said_by(transcripts: DataFrame, labels: DataFrame, chosen: Column) -> DataFrame:
    """Transcripts of the labels whose speaker is ``chosen``: by id, or by name for all speakers of that name."""
    mine = labels.filter(chosen).select("session_id", "speaker").distinct()
    return transcripts.join(mine, ["session_id", "speaker"], "left_semi")


def rebuild_counts(prints: DataFrame, keys: list[str], *, min_talk_ms: int) -> DataFrame:
    """(keys, clusters, assigned, skipped, pinned) of clustered prints (talk_ms, pin, cluster).

    A print with less talk than ``min_talk_ms`` is skipped unless it is pinned or its
    talk is not known.
    """
    in_ = F.col("pin").isNotNull() | F.col("talk_ms").isNull() | (F.col("talk_ms") >= min_talk_ms)
    n = lambda c: F.count(F.when(c, 1))
    return prints.groupBy(*keys).agg(F.countDistinct(F.when(in_, F.coalesce("pin", "cluster"))).alias("clusters"), n(in_ & F.col("pin").isNull()).alias("assigned"), n(~in_).alias("skipped"), n(F.col("pin").isNotNull()).alias("pinned"))


def merged_clusters(edges: DataFrame, members: DataFrame, speakers: DataFrame, vector_col: str, *, same: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with their survivor and pinned to it where it changed, survivors with name and new centroid).

    The survivor is the target named last along a chain; merges between speakers that
    differ in ``same`` (say, the model) don't count.  A survivor keeps its own name; without one it takes that of the least merged speaker that has one.
    """
    moved = merged_speakers(edges, members.select("id", "speaker_id"), speakers, same=same).withColumnRenamed("speaker_id", "survivor")
    touched = edges.select(F.col("from_id").alias("speaker_id")).union(edges.select("to_id")).distinct().withColumn("pinned", F.lit(True))
    out = members.join(moved, "id").join(touched, "speaker_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    root = merged_speakers(edges, speakers.select(F.col("speaker_id").alias("id"), "speaker_id"), speakers, same=same).withColumnRenamed("speaker_id", "survivor")
    named = speakers.join(root, speakers["speaker_id"] == root["id"]).filter("name is not null").groupBy("survivor").agg(F.min_by("name", F.struct((F.col("speaker_id") != F.col("survivor")).alias("other"), "speaker_id")).alias("name"))
    survivors = root.select("survivor").distinct().join(named, "survivor", "left").join(centroids(out, ["survivor"], vector_col), "survivor", "left")
    return out, survivors


def rebuilt(prints: DataFrame, keys: list[str], parameters: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", pin_col: str = "pin") -> tuple[DataFrame, DataFrame]:
    """(keys, id, cluster of every print used; keys, clusters, assigned, skipped, pinned): speakers made anew.

    prints: keys, id, talk_ms, pin, vector.  ``parameters`` has a row for each key: its
    min_talk_ms and threshold, after all layers; a print with less talk is skipped
    unless it is pinned or its talk isn't known.  Keys with one threshold are clustered
    together, so there is a pass for each value of it.
    """
    p = prints.join(parameters.select(*keys, "min_talk_ms", "threshold"), keys).withColumnRenamed(id_col, "id").withColumnRenamed(pin_col, "pin")
    used = F.col("pin").isNotNull() | F.col("talk_ms").isNull() | (F.col("talk_ms") >= F.col("min_talk_ms"))
    found = None
    for (threshold,) in parameters.select("threshold").distinct().orderBy("threshold").collect():
        part = clustered(p.filter(used & (F.col("threshold") == threshold)), keys, vector_col=vector_col, pin_col="pin", threshold=threshold)
        found = part if found is None else found.unionByName(part)
    n = lambda c: F.count(F.when(c, 1))
    is_in, pinned = F.col("cluster").isNotNull(), F.col("pin").isNotNull()
    counts = p.join(found, [*keys, "id"], "left").groupBy(*keys).agg(F.countDistinct("cluster").alias("clusters"), n(is_in & ~pinned).alias("assigned"), n(~is_in).alias("skipped"), n(pinned).alias("pinned"))
    return found, counts


def projection_view(coordinates: DataFrame, shown: Column, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(points, markers) of a projection fitted on all prints: filtered only afterwards; a marker is the mean of its points."""
    points = coordinates.filter(shown)
    return points, points.groupBy(*key).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("points"))


def farthest_members(distances: DataFrame, key: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of each group's members (id, distance), farthest first."""
    w = Window.partitionBy(*key).orderBy(F.col("distance").desc(), "id")
    return distances.withColumn("place", F.row_number().over(w).cast("long")).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def stride_sample(df: DataFrame, key: list[str], order: list[str], limit: int) -> DataFrame:
    """Of each group every ceil(n / limit)-th row in order, from the first on."""
    w = Window.partitionBy(*key)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("_i", i).filter(F.col("_i") % F.ceil(F.col("_n") / limit) == 0).drop("_n", "_i")
