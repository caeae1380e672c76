"""Vectors: distances, nearest neighbours, centroids, projections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import cosine_distance, is_finite_vector, unit


def matrix(column: pa.Array, normed: bool = True) -> np.ndarray:
    """Rows of an Arrow list column; unit length, zero rows stay."""
    flat = np.asarray(column.flatten(), np.float64)
    m = flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
    if normed and m.size:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(n > 0, n, 1.0)
    return m


def nearest(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector_col: str, group: str | None = None, block_rows: int = 4_096) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest of the whole corpus by cosine distance, ties by id.

    Exact.  Rows and queries are dealt into blocks of about ``block_rows`` by a hash of
    their id; each block of queries meets each block of rows in one task, which
    multiplies them and keeps the best ``k`` of each query, and the best of those
    count.  The corpus is read once, however many queries there are, and nothing
    passes the driver.  With ``group`` (say, the model) only rows of the query's group
    count.  Rows without a finite vector take no part.
    """
    g = (F.col(group) if group else F.lit("")).cast("string").alias("g")
    side = lambda df: df.filter(is_finite_vector(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), g)
    rows, asked = side(corpus), side(queries)
    blocks = lambda df, name: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    sizes = blocks(rows, "n_rows").join(blocks(asked, "n_asked"), "g")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = rows.join(sizes, "g").select("g", "id", "v", F.lit(False).alias("asks"), own("n_rows").alias("rb"), every("n_asked").alias("qb"))
    q = asked.join(sizes, "g").select("g", "id", "v", F.lit(True).alias("asks"), every("n_rows").alias("rb"), own("n_asked").alias("qb"))
    kind = corpus.schema[id_col].dataType.simpleString()

    def best(t: pa.Table) -> pa.Table:
        asks = np.asarray(t.column("asks"))
        ids, x = t.column("id"), matrix(t.column("v").combine_chunks())
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        names = np.array(ids.to_pylist(), object)
        out: list[tuple] = []
        for at in range(0, len(one) if len(two) else 0, 512):
            part = one[at : at + 512]
            d = 1 - x[part] @ x[two].T
            cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(two) > k else np.full((len(part), 1), np.inf)
            for i, p in enumerate(part.tolist()):
                near = np.flatnonzero(d[i] <= cut[i])
                out += [(p, two[j], dist) for dist, _, j in sorted((float(d[i, j]), names[two[j]], j) for j in near.tolist())[:k]]
        take = lambda n: ids.take(pa.array([o[n] for o in out], pa.int64()))
        return pa.table({"query_id": take(0), "id": take(1), "distance": pa.array([o[2] for o in out], pa.float64())})

    found = r.unionByName(q).repartition("g", "rb", "qb").groupBy("g", "rb", "qb").applyInArrow(best, f"query_id {kind}, id {kind}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(members: DataFrame, key: list[str], vector_col: str, *, unit_members: bool = False, weight: str | None = None) -> DataFrame:
    """(key, centroid, members): mean vector per key; of unit vectors and itself a unit vector with ``unit_members``, weighted with ``weight``."""
    v = unit(F.col(vector_col)) if unit_members else F.col(vector_col)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    good = members.filter(is_finite_vector(F.col(vector_col)))
    parts = good.select(*key, w.alias("w"), F.posexplode(v).alias("i", "x")).groupBy(*key, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    c = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(*key, F.transform("c", lambda s: s["x"]).alias("centroid"))
    c = c.withColumn("centroid", unit(F.col("centroid"))) if unit_members else c
    return c.join(good.groupBy(*key).agg(F.count("*").alias("members")), key)


def kept_centroids(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """The new centroid of a key, or its old one where no member is left."""
    return old.select(*key, F.col("centroid").alias("_old")).join(new, key, "full").withColumn("centroid", F.coalesce("centroid", "_old")).drop("_old")


def member_distances(members: DataFrame, centers: DataFrame, key: list[str], vector_col: str) -> DataFrame:
    """Every member's cosine distance to its centroid, farthest first within a key."""
    j = members.join(centers.select(*key, "centroid"), key).withColumn("distance", cosine_distance(F.col(vector_col), F.col("centroid")))
    return j.drop("centroid").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("distance").desc(), *[c for c in members.columns if c not in key and c != vector_col])))


@dataclass
class Basis:
    mean: np.ndarray
    components: np.ndarray  # rows; zero where there is none
    ratio: np.ndarray

    @property
    def id(self) -> str:
        text = ",".join(f"{x + 0.0:.9f}" for x in np.round(np.concatenate([self.mean, self.components.ravel()]), 9))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def fit_projection(df: DataFrame, vector_col: str, n: int = 3) -> Basis:
    """Principal axes of the unit vectors.

    Each partition sums x and x xT, so one d x d matrix a partition travels; the
    eigenvectors of their covariance are taken on the driver.  Signs make the sum of
    v |v| positive.  Fewer than two rows have no axes.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, outer = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                count += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                outer = x.T @ x if outer is None else outer + x.T @ x
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tolist()]), pa.array([outer.ravel().tolist()])], names=["n", "total", "outer"])

    good = df.filter(is_finite_vector(F.col(vector_col))).select(vector_col)
    parts = good.mapInArrow(gram, "n long, total array<double>, outer array<double>")
    each = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "total", "outer")).alias("i", "x"))
    sums = np.array([r["x"] for r in each.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    if not len(sums):
        return Basis(np.zeros(0), np.zeros((n, 0)), np.zeros(n))
    count, d = int(sums[0]), int(np.sqrt(len(sums)))  # 1 + d + d * d numbers
    mean = sums[1 : d + 1] / count
    components, ratio = np.zeros((n, d)), np.zeros(n)
    if count > 1:
        outer = sums[d + 1 :].reshape(d, d)
        cov = (outer - count * np.outer(mean, mean)) / (count - 1)
        values, vectors = np.linalg.eigh(cov)
        k = min(n, d, count - 1)
        top = vectors[:, ::-1][:, :k].T
        top = top * np.where((top * np.abs(top)).sum(1, keepdims=True) < 0, -1.0, 1.0)
        trace = float(np.trace(cov))
        components[:k] = top
        ratio[:k] = np.clip(values[::-1][:k], 0, None) / trace if trace > 1e-12 else 0
    return Basis(mean, components, ratio)


def projected(df: DataFrame, basis: Basis, vector_col: str, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Adds a coordinate per axis; rows fitted on or not."""
    v = unit(F.col(vector_col))
    mean = F.array(*[F.lit(float(m)) for m in basis.mean])
    for name, axis in zip(names, basis.components, strict=True):
        a = F.array(*[F.lit(float(x)) for x in axis])
        df = df.withColumn(name, F.aggregate(F.zip_with(F.zip_with(v, mean, lambda p, q: p - q), a, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p))
    return df


