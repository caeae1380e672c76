"""Keyed tables: what is pending, latest or first rows, patches, invalidation, publication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.storage import committed, written


def pending(upstream: DataFrame, done: DataFrame, key: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Upstream rows with no row in ``done``; with a limit the oldest by ``order``, else all, in no order."""
    out = upstream.join(done.select(*key), key, "left_anti")
    return out if limit is None else out.orderBy(*order).limit(limit)


def latest(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row per key; the last write wins."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_write(new: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows whose key is not there yet, the first of each."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = new.join(existing.select(*key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserted(table: DataFrame, feed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``table`` with the feed's last row per key in place of its own."""
    last = latest(feed, key, order)
    return table.join(last.select(*key), key, "left_anti").unionByName(last.select(*table.columns))


def republished(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of a key's old output replaced by its new ones."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def live_only(children: DataFrame, parents: DataFrame, on: str, parent_id: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_id).alias(on)), on, "left_semi")


def patched(df: DataFrame, column: str, patch: dict[str, Column], drop: list[str]) -> DataFrame:
    """A map column without the keys ``drop`` and with those of ``patch``."""
    keep = F.map_filter(column, lambda k, _: ~k.isin([*drop, *patch]))
    return df.withColumn(column, F.map_concat(keep, F.create_map(*[x for k, v in patch.items() for x in (F.lit(k), v)])))


def publish(df: DataFrame, path: str, *, key: tuple[str, ...] = ("pipeline", "session_id"), whole: DataFrame | None = None, downstream: DataFrame | None = None, version: int | None = None) -> int:
    """Publish all rows of the keys in ``df`` in place of what they had; returns the version.

    The rows go into a folder of this version, then one table of marks: the keys
    published, those in ``whole`` whose output is now empty, and, as withdrawn, the keys
    in ``downstream``: what was made from the old rows, which discovery then finds
    pending.  Readers go by the marks, so they see the old output whole until the marks
    are there, and old and withdrawn output go in one step.  A write that ends between
    the two leaves nothing to see.  One writer at a time; a version already whole is
    left as it is, so that a repeated step does nothing.
    """
    spark = df.sparkSession
    if "publication" in df.columns:
        raise ValueError("publication is the name of a column of the folders")
    there = committed(spark, f"{path}/marks", "publication")
    version = max(there, default=-1) + 1 if version is None else version
    if version in there:
        return version
    df.write.mode("overwrite").partitionBy(key[0]).parquet(f"{path}/rows/publication={version}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows/publication={version}")
    marks = rows.select(*key) if whole is None else rows.select(*key).unionByName(whole.select(*key))
    marks = marks.distinct().withColumn("live", F.lit(True))
    if downstream is not None:
        gone = downstream.select(*key).distinct().join(marks.select(*key), list(key), "left_anti")
        marks = marks.unionByName(gone.withColumn("live", F.lit(False)))
    marks.write.mode("overwrite").parquet(f"{path}/marks/publication={version}")
    return version


def marked(spark: SparkSession, path: str, *, key: tuple[str, ...] = ("pipeline", "session_id")) -> DataFrame:
    """(key, publication: the version) of what is published: each key's last mark, unless that withdraws it."""
    marks = spark.read.option("basePath", f"{path}/marks").parquet(*[f"{path}/marks/publication={v}" for v in committed(spark, f"{path}/marks", "publication")])
    last = marks.groupBy(*key).agg(F.max(F.struct("publication", "live")).alias("m"))
    return last.filter("m.live").select(*key, "m.publication")


def published(spark: SparkSession, path: str, *, key: tuple[str, ...] = ("pipeline", "session_id")) -> DataFrame:
    """The rows of each published key's last version."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/publication={v}" for v in committed(spark, f"{path}/marks", "publication")])
    return rows.join(marked(spark, path, key=key), [*key, "publication"], "left_semi").drop("publication")


def tier_stream(source: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], *, key: tuple[str, ...], order: str, downstream: Callable[[DataFrame], DataFrame] | None = None):
    """Run a tier over what is new in a stream of its upstream rows, and stop; returns the query.

    Of each batch every key's last row by ``order`` is processed and published under
    the batch's number.  The checkpoint says what has been read; a batch that failed
    halfway is done again under its number, one already published is not.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = latest(batch, list(key), [order])
        publish(process(rows), path, key=key, whole=rows, downstream=None if downstream is None else downstream(rows), version=number)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page, with a row more than ``limit`` if there are more."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def redone(outputs: DataFrame, chosen: DataFrame, tiers: list[str], first: str, *, key: str = "session_id") -> DataFrame:
    """``outputs`` (key, pipeline) without what ``first`` and the tiers after it made for the chosen keys: discovery then finds them pending."""
    gone = F.col("pipeline").isin(tiers[tiers.index(first) :])
    return outputs.filter(~gone).unionByName(outputs.filter(gone).join(chosen.select(key), key, "left_anti"))


def newly_ready(upstream: DataFrame, done: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upstream rows never processed, or changed since: their version is later than the one that was."""
    last = done.groupBy(*key).agg(F.max(version).alias("_done"))
    return upstream.join(last, key, "left").filter(F.col("_done").isNull() | (F.col(version) > F.col("_done"))).drop("_done")


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in the whole order, from 0 on.

    Rows are sorted over all partitions, each partition's rows counted, and a row's
    place is the count of all before its partition and its own place in it: no
    partition holds more than its share.  Rows equal in ``order`` are in any order.
    """
    placed = written(df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    first = F.min("_at")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def strided(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """Every ceil(n / limit)-th row of the whole order, from the first on: ``limit`` rows at most."""
    step = max(1, -(-df.count() // limit))
    return numbered(df, order, "_number").filter(F.col("_number") % step == 0).drop("_number")
