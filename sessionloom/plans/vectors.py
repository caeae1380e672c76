"""Queries over voice-prints: neighbours, centroids, clusters, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import cosine_distance, dot, is_finite_vector
from sessionloom.operators import clustering as cl
from sessionloom.operators import vectors as ve
from sessionloom.plans import derived as d
from sessionloom.plans.catalog import query


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as voice-prints of five users, with the label as the speaker they had."""
    return d.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("user_id"), (F.col("vec_id") % 50).alias("session_id"), F.col("label").cast("long").alias("label"), "embedding", (F.col("vec_id") * 37 % 9000).alias("talk_ms"))


E = "e AS (SELECT vec_id, vec_id % 5 AS user_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v, vec_id * 37 % 9000 AS talk_ms FROM embeddings)"
CENT = E + ", x AS (SELECT user_id, label, talk_ms, generate_subscripts(v, 1) AS i, unnest(v) AS x, sqrt(list_dot_product(v, v)) AS n FROM e)"


@query("nearest_prints", f"WITH {E}, p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS distance FROM e q JOIN e ON q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) SELECT query_id, id, abs(round(distance, 5)) AS distance FROM r WHERE rank <= 10")
def nearest_prints(spark, sf_dir):
    e = prints(spark, sf_dir)
    return ve.nearest(e, e.filter("vec_id % 100 = 0"), 10, id_col="vec_id", vector_col="embedding").select("query_id", "id", F.abs(F.round("distance", 5)).alias("distance"))


@query("nearest_within_user", f"WITH {E}, p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS distance FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.user_id = e.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) SELECT query_id, id, abs(round(distance, 5)) AS distance FROM r WHERE rank <= 5")
def nearest_within_user(spark, sf_dir):
    e = prints(spark, sf_dir)
    return ve.nearest(e, e.filter("vec_id % 100 = 0"), 5, id_col="vec_id", vector_col="embedding", group="user_id").select("query_id", "id", F.abs(F.round("distance", 5)).alias("distance"))


@query("speaker_centroids", f"WITH {CENT} SELECT user_id, label, i, round(avg(x), 6) AS x FROM x GROUP BY ALL")
def speaker_centroids(spark, sf_dir):
    c = ve.centroids(prints(spark, sf_dir), ["user_id", "label"], "embedding")
    return c.select("user_id", "label", F.posexplode("centroid").alias("i", "x")).select("user_id", "label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("unit_centroids", f"WITH {CENT}, c AS (SELECT user_id, label, i, avg(x / n) AS x FROM x GROUP BY ALL) SELECT user_id, label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id, label)), 6) AS x FROM c")
def unit_centroids(spark, sf_dir):
    c = ve.centroids(prints(spark, sf_dir), ["user_id", "label"], "embedding", unit_members=True)
    return c.select("user_id", "label", F.posexplode("centroid").alias("i", "x")).select("user_id", "label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("weighted_voice_prints", f"WITH {CENT}, c AS (SELECT user_id, label, i, sum(x / n * greatest(talk_ms, 1)) AS x FROM x GROUP BY ALL) SELECT user_id, label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id, label)), 6) AS x FROM c")
def weighted_voice_prints(spark, sf_dir):
    p = prints(spark, sf_dir).withColumn("w", F.greatest("talk_ms", F.lit(1)))
    c = ve.centroids(p, ["user_id", "label"], "embedding", unit_members=True, weight="w")
    return c.select("user_id", "label", F.posexplode("centroid").alias("i", "x")).select("user_id", "label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


CV = CENT + ", cc AS (SELECT user_id, label, i, avg(x) AS x FROM x GROUP BY ALL), cv AS (SELECT user_id, label, list(x ORDER BY i) AS c FROM cc GROUP BY ALL)"


@query("member_distances", f"WITH {CV} SELECT e.user_id, e.label, vec_id, round(1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 5) AS distance FROM e JOIN cv ON e.user_id = cv.user_id AND e.label = cv.label")
def member_distances(spark, sf_dir):
    p = prints(spark, sf_dir)
    c = ve.centroids(p, ["user_id", "label"], "embedding")
    return ve.member_distances(p.select("user_id", "label", "vec_id", "embedding"), c, ["user_id", "label"], "embedding").select("user_id", "label", "vec_id", F.round("distance", 5).alias("distance"))


@query("similar_clusters", f"WITH {CV}, s AS (SELECT a.user_id, a.label, b.label AS other, 1 - list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))) AS distance FROM cv a JOIN cv b ON a.user_id = b.user_id AND a.label <> b.label), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY distance, other) AS rank FROM s) SELECT user_id, label, other, round(distance, 5) AS distance, rank FROM r WHERE rank <= 3")
def similar_clusters(spark, sf_dir):
    c = ve.centroids(prints(spark, sf_dir), ["user_id", "label"], "embedding")
    other = c.select("user_id", F.col("label").alias("other"), F.col("centroid").alias("c2"))
    s = c.join(other, "user_id").filter("label <> other").withColumn("distance", cosine_distance(F.col("centroid"), F.col("c2")))
    w = Window.partitionBy("user_id", "label").orderBy("distance", "other")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("user_id", "label", "other", F.round("distance", 5).alias("distance"), "rank")


@query("models_by_size", "SELECT label AS model, count(*) AS prints FROM embeddings GROUP BY label")
def models_by_size(spark, sf_dir):
    return d.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("model")).agg(F.count("*").alias("prints")).orderBy(F.col("prints").desc(), "model")


@query("vector_check", "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS length, true AS usable FROM embeddings")
def vector_check(spark, sf_dir):
    v = F.col("embedding")
    return d.table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("dim"), F.round(F.sqrt(dot(v, v)), 5).alias("length"), is_finite_vector(v).alias("usable"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prints(spark, sf_dir).withColumn("pin", F.when(F.col("vec_id") % 97 == 0, F.concat(F.lit("p"), (F.col("vec_id") % 2).cast("string"))))
    return cl.clustered(p, ["user_id"], id_col="vec_id", pin_col="pin", threshold=0.65)


@query("voice_clusters")
def voice_clusters(spark, sf_dir):
    return clusters(spark, sf_dir)


@query("voice_identities")
def voice_identities(spark, sf_dir):
    p = prints(spark, sf_dir)
    c = clusters(spark, sf_dir).withColumnRenamed("id", "vec_id").join(p.select("vec_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("speaker_id")), "vec_id")
    c = c.withColumn("pinned_to", F.when(F.col("vec_id") % 97 == 0, F.concat(F.lit("p"), (F.col("vec_id") % 2).cast("string")))).withColumnRenamed("vec_id", "id")
    speakers = p.select("user_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("speaker_id"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("Name "), F.col("label").cast("string"))).alias("name")).distinct()
    return cl.reconciled(c, ["user_id"], speakers)


@query("voice_projection")
def voice_projection(spark, sf_dir):
    p = prints(spark, sf_dir)
    out = ve.projected(p, ve.fit_projection(p, "embedding"), "embedding")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("purity_split")
def purity_split(spark, sf_dir):
    t = prints(spark, sf_dir).select("user_id", F.col("vec_id").alias("turn_id"), F.concat(F.lit("S"), (F.col("vec_id") % 3).cast("string")).alias("speaker"), (F.col("vec_id") * 2000).alias("start_ms"), (F.col("vec_id") * 2000 + 1500).alias("end_ms"), F.col("talk_ms").alias("clean_ms"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("embedding"))
    return cl.purity_split(t, ["user_id"]).select("user_id", "turn_id", "label")


@query("merged_speakers", "WITH RECURSIVE ed AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 4 <> 0), up AS (SELECT s_suppkey AS id, s_suppkey AS r FROM supplier UNION SELECT up.id, ed.b FROM up JOIN ed ON up.r = ed.a), top AS (SELECT id, max(r) AS r FROM up GROUP BY id) SELECT l_orderkey * 10 + l_linenumber AS id, r AS speaker_id FROM lineitem JOIN top ON l_suppkey = top.id")
def merged_speakers(spark, sf_dir):
    edges = d.table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("from_id"), (F.col("s_suppkey") + 1).alias("to_id"))
    members = d.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("speaker_id"))
    return cl.merged_speakers(edges, members)
