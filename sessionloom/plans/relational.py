"""Queries over keyed tables: scans, discovery, aggregates, windows, tracks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import epoch_ms, md5_order
from sessionloom.functions.storage import shared_dir
from sessionloom.operators import location as loc
from sessionloom.operators import tables as tb
from sessionloom.plans import derived as d
from sessionloom.plans.catalog import query

T = d.table


def segments(spark: SparkSession, sf_dir: str, part_rows: int = 500_000) -> DataFrame:
    """Orders as sessions, their lines as stored segments.

    Dealt by session into parts of about ``part_rows`` lines, so that a task's sorts don't grow
    with the table; what follows by session needs no other shuffle.
    """
    o = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    li = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("sequence"), F.col("l_returnflag").alias("resource"), F.col("l_quantity").cast("long").alias("bytes"), F.col("l_partkey").alias("blob"), (F.col("l_quantity") * 20).cast("long").alias("duration_ms"), F.col("l_shipdate").alias("captured_at"))
    parts = max(spark.sparkContext.defaultParallelism, -(-T(spark, sf_dir, "lineitem").count() // part_rows))
    return li.repartition(parts, "session_id").join(o.repartition(parts, "session_id"), "session_id")


SEG = "seg AS (SELECT l_orderkey AS session_id, o_custkey AS user_id, o_orderstatus AS status, CAST(l_linenumber AS BIGINT) AS sequence, l_returnflag AS resource, CAST(l_quantity AS BIGINT) AS bytes, l_partkey AS blob, CAST(l_quantity * 20 AS BIGINT) AS duration_ms, l_shipdate AS captured_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("sessions", f"WITH {d.SESSIONS} SELECT session_id, user_id, epoch_ms(started_at) AS started_ms, epoch_ms(ended_at) AS ended_ms, n_events, ended_at IS NULL AS is_open FROM sessions")
def sessions(spark, sf_dir):
    return d.sessions(spark, sf_dir).select("session_id", "user_id", epoch_ms(F.col("started_at")).alias("started_ms"), epoch_ms(F.col("ended_at")).alias("ended_ms"), "n_events", F.col("ended_at").isNull().alias("is_open"))


@query("segments_of_session", f"WITH {SEG} SELECT session_id, sequence, resource, bytes FROM seg WHERE resource = 'N' AND session_id = (SELECT min(session_id) FROM seg WHERE resource = 'N') ORDER BY sequence")
def segments_of_session(spark, sf_dir):
    """One resource of one session: of the first that has it."""
    s = segments(spark, sf_dir).filter("resource = 'N'")
    first = s.agg(F.min("session_id").alias("session_id"))
    return s.join(F.broadcast(first), "session_id").select("session_id", "sequence", "resource", "bytes").orderBy("sequence")


@query("artifact_page", "SELECT event_id, user_id, start_ms FROM (SELECT event_id, user_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 10 THEN event_id * 10 END AS start_ms FROM events WHERE event_type = 'view' OR event_type = 'click') ORDER BY start_ms ASC NULLS FIRST, event_id LIMIT 51 OFFSET 20")
def artifact_page(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    a = T(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select("event_id", "user_id", F.when(k >= 10, F.col("event_id") * 10).alias("start_ms"))
    return tb.page(a, [F.col("start_ms").asc_nulls_first(), "event_id"], 50, 20)


@query("session_resource_stats", f"WITH {SEG} SELECT session_id, resource, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY sequence) AS ids FROM seg GROUP BY session_id, resource")
def session_resource_stats(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("sequence")), lambda x: x.cast("string")), ",")
    return segments(spark, sf_dir).groupBy("session_id", "resource").agg(F.count("*").alias("segments"), F.sum("bytes").alias("total_bytes"), F.sum("duration_ms").alias("duration_ms"), ids.alias("ids"))


@query("session_stats", f"WITH {SEG}, r AS (SELECT session_id, resource, count(*) AS n, sum(bytes) AS b, sum(duration_ms) AS d FROM seg GROUP BY ALL) SELECT session_id, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(d) AS BIGINT) AS duration_ms, string_agg(resource || ':' || n || ':' || CAST(b AS BIGINT), ';' ORDER BY resource) AS resources FROM r GROUP BY session_id")
def session_stats(spark, sf_dir):
    r = segments(spark, sf_dir).groupBy("session_id", "resource").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.sum("duration_ms").alias("d"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resource", "n", "b"))), lambda x: F.concat_ws(":", x["resource"], x["n"].cast("string"), x["b"].cast("string"))), ";")
    return r.groupBy("session_id").agg(F.sum("n").alias("segments"), F.sum("b").alias("total_bytes"), F.sum("d").alias("duration_ms"), parts.alias("resources"))


@query("usage_by_user", f"WITH {SEG} SELECT user_id, resource, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(min(captured_at) AS VARCHAR) AS first_at, CAST(max(captured_at) AS VARCHAR) AS last_at FROM seg GROUP BY user_id, resource")
def usage_by_user(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("user_id", "resource").agg(F.count("*").alias("segments"), F.sum("bytes").alias("total_bytes"), F.min("captured_at").cast("string").alias("first_at"), F.max("captured_at").cast("string").alias("last_at"))


@query("stitch_fingerprint", f"WITH {SEG} SELECT session_id, count(*) AS segments, max(sequence) AS last_sequence, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM seg GROUP BY session_id")
def stitch_fingerprint(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("segments"), F.max("sequence").alias("last_sequence"), F.sum("bytes").alias("total_bytes"))


@query("session_digest", f"WITH {SEG} SELECT session_id, sha256(string_agg(sequence || '-' || blob, ',' ORDER BY sequence, blob)) AS digest FROM seg GROUP BY session_id")
def session_digest(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("sequence", "blob")))
    return segments(spark, sf_dir).groupBy("session_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: F.concat_ws("-", x["sequence"].cast("string"), x["blob"].cast("string"))), ",").cast("binary"), 256).alias("digest"))


@query("byte_layout", f"WITH {SEG} SELECT session_id, sequence, bytes, 44 + CAST(coalesce(sum(greatest(bytes - 4, 0)) OVER (PARTITION BY session_id ORDER BY sequence, blob, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM seg")
def byte_layout(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("sequence", "blob", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    return segments(spark, sf_dir).select("session_id", "sequence", "bytes", (F.coalesce(F.sum(F.greatest(F.col("bytes") - 4, F.lit(0))).over(w), F.lit(0)) + 44).alias("byte_offset"))


@query("byte_slices", f"WITH {SEG}, l AS (SELECT session_id, sequence, bytes, coalesce(sum(bytes) OVER (PARTITION BY session_id ORDER BY sequence, blob, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM seg) SELECT session_id, sequence, CAST(greatest(20 - o, 0) AS BIGINT) AS slice_from, CAST(least(70 - o, bytes) AS BIGINT) AS slice_to FROM l WHERE o < 70 AND o + bytes > 20")
def byte_slices(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("sequence", "blob", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    at = segments(spark, sf_dir).withColumn("o", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    return at.filter("o < 70 and o + bytes > 20").select("session_id", "sequence", F.greatest(20 - F.col("o"), F.lit(0)).alias("slice_from"), F.least(70 - F.col("o"), "bytes").alias("slice_to"))


@query("format_check", f"WITH {SEG} SELECT session_id, CASE WHEN count(DISTINCT resource) > 1 THEN 'mixed resources' WHEN count(DISTINCT status) > 1 THEN 'mixed status' END AS skipped FROM seg GROUP BY session_id")
def format_check(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("session_id").agg(F.countDistinct("resource").alias("r"), F.countDistinct("status").alias("s")).select("session_id", F.when(F.col("r") > 1, "mixed resources").when(F.col("s") > 1, "mixed status").alias("skipped"))


@query("sessions_not_processed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sessions_not_processed(spark, sf_dir):
    done = T(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tb.pending(T(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"], ["c_custkey"])


@query("pending_with_resource", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def pending_with_resource(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    ended = T(spark, sf_dir, "orders").select("o_orderkey").join(li.filter("l_returnflag = 'R'"), "o_orderkey", "left_semi")
    return tb.pending(ended, li.filter("l_returnflag = 'A'"), ["o_orderkey"], ["o_orderkey"])


@query("unlabelled_documents", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return tb.pending(T(spark, sf_dir, "documents").select("doc_id", "lang"), T(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"])


@query("newest_job_per_user", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest_job_per_user(spark, sf_dir):
    return tb.latest(T(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("superseded_jobs", "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey))")
def superseded_jobs(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    newest = F.max(F.struct("o_orderdate", "o_orderkey")).over(Window.partitionBy("o_custkey"))
    return o.withColumn("newest", newest).filter(F.col("newest") > F.struct("o_orderdate", "o_orderkey")).select("o_orderkey")


@query("pin_upsert", "WITH p AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), f AS (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) SELECT k, CAST(v AS BIGINT) AS v FROM p WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, CAST(v AS BIGINT) FROM f")
def pin_upsert(spark, sf_dir):
    pins = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    feed = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("long").alias("v"), "o_orderdate")
    return tb.upserted(pins, feed, ["k"], ["o_orderdate", "v"])


@query("dedup_insert", "SELECT o_custkey AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey")
def dedup_insert(spark, sf_dir):
    new = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderdate")
    there = T(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return tb.first_write(new, there, ["k"], ["o_orderdate", "v"]).select("k", "v")


@query("republished_sessions", f"WITH {SEG}, new AS (SELECT session_id, sequence, resource, bytes * 2 AS bytes FROM seg WHERE status = 'O' AND sequence <= 2) SELECT session_id, sequence, resource, bytes FROM seg WHERE session_id NOT IN (SELECT session_id FROM new) UNION ALL SELECT session_id, sequence, resource, bytes FROM new")
def republished_sessions(spark, sf_dir):
    s = segments(spark, sf_dir).select("session_id", "sequence", "resource", "bytes", "status")
    new = s.filter("status = 'O' and sequence <= 2").withColumn("bytes", F.col("bytes") * 2).drop("status")
    return tb.republished(s.drop("status"), new, ["session_id"])


@query("published_sessions", f"WITH {SEG}, new AS (SELECT session_id, sequence, resource, bytes * 2 AS bytes FROM seg WHERE status = 'O' AND sequence <= 2) SELECT session_id, sequence, resource, bytes FROM seg WHERE session_id NOT IN (SELECT session_id FROM new) AND session_id % 5 <> 0 UNION ALL SELECT session_id, sequence, resource, bytes FROM new")
def published_sessions(spark, sf_dir):
    """What readers see after two publications, the second in place of some sessions' rows and withdrawing others."""
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    s = segments(spark, sf_dir).select(F.lit("segments").alias("pipeline"), "session_id", "sequence", "resource", "bytes", "status")
    new = s.filter("status = 'O' and sequence <= 2").withColumn("bytes", F.col("bytes") * 2).drop("status")
    tb.publish(s.drop("status"), path)
    tb.publish(new, path, downstream=s.filter("session_id % 5 = 0"))
    return tb.published(spark, path).drop("pipeline")


@query("streamed_tier", "SELECT o_orderkey AS session_id, o_custkey AS user_id, o_totalprice > 100000 AS large FROM orders")
def streamed_tier(spark, sf_dir):
    """A tier over a stream of its upstream rows, published; a second run finds nothing new."""
    path = f"{shared_dir(spark)}/tier-{uuid.uuid4().hex}"
    schema = T(spark, sf_dir, "orders").schema

    def process(rows):
        return rows.select("pipeline", "session_id", "user_id", (F.col("price") > 100_000).alias("large"))

    for _ in range(2):
        orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders*.parquet").parquet(sf_dir)
        rows = orders.select(F.lit("price").alias("pipeline"), F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("price"), "o_orderdate")
        tb.tier_stream(rows, path, f"{path}/checkpoint", process, key=("pipeline", "session_id"), order="o_orderdate").awaitTermination()
    return tb.published(spark, path).drop("pipeline")


@query("strided_events", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id FROM r WHERE i % greatest(1, (n + 499) // 500) = 0")
def strided_events(spark, sf_dir):
    """Every so many-th event of all, 500 at most."""
    return tb.strided(T(spark, sf_dir, "events"), ["ts", "event_id"], 500).select("event_id")


@query("live_children", f"WITH {SEG} SELECT session_id, sequence FROM seg WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def live_children(spark, sf_dir):
    parents = T(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return tb.live_only(segments(spark, sf_dir), parents, "user_id", "c_custkey").select("session_id", "sequence")


@query("sessions_deleted", f"WITH {SEG} SELECT session_id, count(*) AS segments FROM seg WHERE session_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY session_id")
def sessions_deleted(spark, sf_dir):
    gone = T(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("session_id"))
    return segments(spark, sf_dir).join(gone, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("segments"))


@query("metadata_patch", "SELECT doc_id, upper(lang) AS lang, source, CAST(NULL AS VARCHAR) AS words, 'true' AS edited FROM documents")
def metadata_patch(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").select("doc_id", "lang", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("words"), F.col("n_chars").cast("string")).alias("meta"))
    p = tb.patched(docs, "meta", {"lang": F.upper("lang"), "edited": F.lit("true")}, ["words"])
    return p.select("doc_id", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in ("lang", "source", "words", "edited")])


@query("tenant_scope", "SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def tenant_scope(spark, sf_dir):
    mine = T(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey")
    o = T(spark, sf_dir, "orders").join(mine, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    return T(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber")


@query("layered_parameters", "SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 10 = 0 THEN 0.5 END, CASE WHEN c_custkey % 3 = 0 THEN 0.0 END, 0.65) AS DOUBLE) AS distance FROM customer")
def layered_parameters(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey")
    own = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(0.0).alias("own"))
    once = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit(0.5).alias("once"))
    return c.join(own, "c_custkey", "left").join(once, "c_custkey", "left").select("c_custkey", F.coalesce("once", "own", F.lit(0.65)).alias("distance"))


@query("talk_gate", f"WITH {d.TURNS} SELECT session_id, turn_id FROM turns WHERE k % 10 = 0 OR (CASE WHEN k % 7 <> 0 THEN end_ms - start_ms END) IS NULL OR end_ms - start_ms >= 3000")
def talk_gate(spark, sf_dir):
    talk = F.when(F.col("k") % 7 != 0, F.col("end_ms") - F.col("start_ms"))
    return d.turns(spark, sf_dir).filter((F.col("k") % 10 == 0) | talk.isNull() | (talk >= 3000)).select("session_id", "turn_id")


FRAME_CHECK_SQL = """
WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS seq FROM events),
a AS (SELECT x.event_id, x.user_id, x.seq, coalesce(max(y.seq), -1) AS highest FROM e x LEFT JOIN e y ON y.user_id = x.user_id AND y.event_id < x.event_id GROUP BY ALL),
stored AS (SELECT *, (SELECT count(*) FROM a b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.seq > b.highest) AS before FROM a WHERE seq > highest),
through AS (SELECT user_id, event_id, seq FROM stored WHERE seq = before)
SELECT event_id, CASE WHEN seq > highest THEN 'ok' WHEN seq <= coalesce((SELECT max(t.seq) FROM through t WHERE t.user_id = a.user_id AND t.event_id < a.event_id), -1) THEN 'duplicate' ELSE 'bad_sequence' END AS verdict FROM a
"""


@query("frame_sequence_check", FRAME_CHECK_SQL)
def frame_sequence_check(spark, sf_dir):
    """A frame over the highest so far is stored; one at or below the gap-free part is a duplicate, any other is refused."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = T(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("seq"))
    e = e.withColumn("stored", F.col("seq") > F.coalesce(F.max("seq").over(before), F.lit(-1)))
    e = e.withColumn("place", F.when(F.col("stored"), F.coalesce(F.sum(F.col("stored").cast("long")).over(before), F.lit(0))))
    through = F.coalesce(F.max(F.when(F.col("seq") == F.col("place"), F.col("seq"))).over(before), F.lit(-1))
    return e.select("event_id", F.when(F.col("stored"), "ok").when(F.col("seq") <= through, "duplicate").otherwise("bad_sequence").alias("verdict"))


@query("acked_through", "WITH s AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS seq FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS i FROM s) SELECT user_id, max(seq) AS through, count(*) AS stored FROM r WHERE seq = i GROUP BY user_id")
def acked_through(spark, sf_dir):
    s = T(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("seq")).distinct()
    s = s.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) - 1)
    return s.filter("seq = i").groupBy("user_id").agg(F.max("seq").alias("through"), F.count("*").alias("stored"))


@query("best_per_group", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
def best_per_group(spark, sf_dir):
    return T(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"))


@query("latest_linked", f"WITH {SEG} SELECT blob, arg_max(session_id, (captured_at, session_id, sequence)) AS session_id FROM seg GROUP BY blob")
def latest_linked(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("blob").agg(F.max_by("session_id", F.struct("captured_at", "session_id", "sequence")).alias("session_id"))


@query("speakers_with_counts", "SELECT c_custkey, c_name, count(o_orderkey) AS members, count(DISTINCT o_orderdate) AS days FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def speakers_with_counts(spark, sf_dir):
    c = T(spark, sf_dir, "customer").join(T(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("members"), F.countDistinct("o_orderdate").alias("days"))


@query("vote_tally", "SELECT l_returnflag AS model, l_linestatus AS strategy, count(*) AS votes FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def vote_tally(spark, sf_dir):
    return T(spark, sf_dir, "lineitem").cube(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("strategy")).agg(F.count("*").alias("votes"))


@query("status_counts", "SELECT o_orderpriority AS pipeline, o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return T(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("pipeline"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"))


@query("candidate_grid", "WITH g AS (SELECT m, s FROM (VALUES ('A'), ('N'), ('R')) AS a(m), (VALUES ('F'), ('O')) AS b(s)), have AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) SELECT o_orderkey, m AS model, s AS strategy, have.l_orderkey IS NOT NULL AS produced FROM orders, g LEFT JOIN have ON have.l_orderkey = o_orderkey AND l_returnflag = m AND l_linestatus = s")
def candidate_grid(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("strategy")) for m in "ANR" for s in "FO"])
    grid = T(spark, sf_dir, "orders").select("o_orderkey", F.explode(pairs).alias("g")).select("o_orderkey", "g.*")
    have = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("strategy"), F.lit(True).alias("have")).distinct()
    return grid.join(have, ["o_orderkey", "model", "strategy"], "left").select("o_orderkey", "model", "strategy", F.coalesce("have", F.lit(False)).alias("produced"))


@query("blind_vote_rollup", "SELECT o_custkey, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS voted, count(DISTINCT o_orderpriority) AS candidates, 4 * count(*) AS expected, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey")
def blind_vote_rollup(spark, sf_dir):
    return T(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("voted"), F.countDistinct("o_orderpriority").alias("candidates"), (4 * F.count("*")).alias("expected"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("blind_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey || ':' || l_linenumber)) AS place FROM lineitem")
def blind_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(md5_order(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("vote_promotion", "WITH v AS (SELECT l_orderkey AS u, arg_min(l_partkey, (l_linenumber, l_partkey)) AS won FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(o_orderkey, u) AS utterance, coalesce(won, o_custkey) AS text_id, won IS NOT NULL AS promoted FROM orders FULL JOIN v ON o_orderkey = u")
def vote_promotion(spark, sf_dir):
    v = T(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("u")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("won"))
    o = T(spark, sf_dir, "orders")
    return o.join(v, o["o_orderkey"] == v["u"], "full").select(F.coalesce("o_orderkey", "u").alias("utterance"), F.coalesce("won", "o_custkey").alias("text_id"), F.col("won").isNotNull().alias("promoted"))


@query("named_first", "SELECT s_suppkey, row_number() OVER (ORDER BY (s_suppkey % 3 = 0) DESC, s_acctbal, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 40")
def named_first(spark, sf_dir):
    top = T(spark, sf_dir, "supplier").orderBy((F.col("s_suppkey") % 3 == 0).desc(), "s_acctbal", "s_suppkey").limit(40)
    w = Window.orderBy((F.col("s_suppkey") % 3 == 0).desc(), "s_acctbal", "s_suppkey")
    return top.select("s_suppkey", F.row_number().over(w).cast("long").alias("place"))


@query("session_points", f"WITH {d.POINTS} SELECT session_id, idx, round(lat, 6) AS lat, round(lon, 6) AS lon, at_ms FROM fixes WHERE at_ms >= 0 AND at_ms < 40000000")
def session_points(spark, sf_dir):
    p = loc.session_points(d.points(spark, sf_dir)).filter("at_ms >= 0 and at_ms < 40000000")
    return p.select("session_id", "idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "at_ms")


@query("user_points_by_clock", f"WITH {d.POINTS} SELECT user_id, session_id, idx, epoch_ms(ts) AS wall_ms FROM fixes WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00'")
def user_points_by_clock(spark, sf_dir):
    import calendar

    at = lambda *x: calendar.timegm((*x, 0, 0)) * 1000
    return loc.points_between(d.points(spark, sf_dir), at(2024, 1, 10, 6), at(2024, 1, 20, 18)).select("user_id", "session_id", "idx", "wall_ms")


TRACK = d.POINTS + """,
tk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM fixes)"""


@query("track_points", f"WITH {TRACK} SELECT session_id, rn, n AS n_points, round(lat, 5) AS lat FROM tk WHERE (rn - 1) % greatest(1, (n + 4) // 5) = 0 OR rn = n")
def track_points(spark, sf_dir):
    return loc.decimated(loc.session_points(d.points(spark, sf_dir)), 5).select("session_id", F.col("rn").cast("long").alias("rn"), "n_points", F.round("lat", 5).alias("lat"))


@query("location_tracks", f"WITH {TRACK} SELECT session_id, count(*) AS kept, max(n) AS n_points, min(epoch_ms(ts)) AS first_ms, max(epoch_ms(ts)) AS last_ms FROM tk WHERE (rn - 1) % greatest(1, (n + 4) // 5) = 0 OR rn = n GROUP BY session_id")
def location_tracks(spark, sf_dir):
    return loc.tracks(loc.session_points(d.points(spark, sf_dir)), 5).select("session_id", F.size("points").cast("long").alias("kept"), "n_points", "first_ms", "last_ms")


@query("track_pieces", f"WITH {d.POINTS}, g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY session_id ORDER BY ts, event_id) > 7200000 THEN 1 ELSE 0 END AS new FROM fixes) SELECT session_id, CAST(sum(new) + 1 AS BIGINT) AS pieces, count(*) AS points FROM g GROUP BY session_id")
def track_pieces(spark, sf_dir):
    p = loc.split_at_gaps(loc.session_points(d.points(spark, sf_dir)), 7_200_000)
    return p.groupBy("session_id").agg((F.max("piece") + 1).alias("pieces"), F.count("*").alias("points"))


@query("position_at", f"""WITH {d.POINTS}, f AS (SELECT *, lead(at_ms) OVER w AS b_ms, lead(lat) OVER w AS b_lat, row_number() OVER w AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY at_ms, ts, event_id)),
pr AS (SELECT DISTINCT session_id, x.m AS at_ms FROM session_events, (VALUES (0), (3600000), (9000000), (100000000)) AS x(m)),
fx AS (SELECT session_id, min(at_ms) AS lo, arg_min(lat, (at_ms, ts, event_id)) AS lo_lat, max(at_ms) AS hi, arg_max(lat, (at_ms, ts, event_id)) AS hi_lat FROM fixes GROUP BY session_id)
SELECT pr.session_id, pr.at_ms, round(CASE WHEN pr.at_ms <= lo THEN lo_lat WHEN pr.at_ms >= hi THEN hi_lat WHEN b_ms - f.at_ms > 10800000 THEN CASE WHEN pr.at_ms - f.at_ms <= b_ms - pr.at_ms THEN lat ELSE b_lat END WHEN b_ms = f.at_ms THEN lat ELSE lat + (b_lat - lat) * (pr.at_ms - f.at_ms) / (b_ms - f.at_ms) END, 6) AS lat,
 CASE WHEN pr.at_ms <= lo THEN pr.at_ms = lo WHEN pr.at_ms >= hi THEN pr.at_ms = hi ELSE b_ms - f.at_ms <= 10800000 END AS exact
FROM pr JOIN fx ON pr.session_id = fx.session_id LEFT JOIN f ON f.session_id = pr.session_id AND f.at_ms <= pr.at_ms AND (f.b_ms > pr.at_ms) AND pr.at_ms > lo AND pr.at_ms < hi""")
def position_at(spark, sf_dir):
    pts = loc.session_points(d.points(spark, sf_dir))
    probes = pts.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 3600000, 9000000, 100000000)])).alias("at_ms")).withColumn("probe_id", F.col("at_ms"))
    return loc.position_at(pts, probes, gap_ms=10_800_000).select("session_id", "at_ms", F.round("lat", 6).alias("lat"), "exact")


@query("location_batch_check", f"WITH {d.POINTS} SELECT session_id, CAST(day AS VARCHAR) AS day, CASE WHEN max(abs(lat)) > 90 THEN 'latitude' WHEN max(abs(lon)) > 180 THEN 'longitude' END AS error FROM fixes GROUP BY session_id, day")
def location_batch_check(spark, sf_dir):
    return loc.batch_errors(d.points(spark, sf_dir)).select("session_id", F.to_date("captured_at").cast("string").alias("day"), "error")


EVENTS_SQL = d.SESSION_EVENTS + """,
spoken AS (SELECT session_id, at_ms AS start_ms, at_ms + 1 + CAST(floor(value * 40) AS BIGINT) AS end_ms, CAST(event_id AS VARCHAR) AS source FROM session_events),
tl AS (SELECT session_id, 0 AS at_ms, 'session-start' AS type, 0 AS rank, CAST(session_id AS VARCHAR) AS source FROM sessions
 UNION ALL SELECT session_id, epoch_ms(ended_at) - epoch_ms(started_at), 'session-end', 100, CAST(session_id AS VARCHAR) FROM sessions WHERE ended_at IS NOT NULL
 UNION ALL SELECT session_id, end_ms, 'speech-end', 1, source FROM spoken
 UNION ALL SELECT session_id, start_ms, 'speech-start', 2, source FROM spoken
 UNION ALL SELECT session_id, at_ms, event_type, 50, CAST(event_id AS VARCHAR) FROM session_events)"""


@query("session_timeline", f"WITH {EVENTS_SQL} SELECT session_id, at_ms, type, source, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, rank, source, type) AS place FROM tl WHERE at_ms >= 0 AND at_ms < 90000000")
def session_timeline(spark, sf_dir):
    from sessionloom.operators.timeline import UNKNOWN_RANK, assembled, speech_events

    s, e = d.sessions(spark, sf_dir), d.session_events(spark, sf_dir)
    source = F.col("event_id").cast("string").alias("source")
    spoken = e.select("session_id", F.col("at_ms").alias("start_ms"), (F.col("at_ms") + 1 + F.floor(F.col("value") * 40)).alias("end_ms"), source)
    other = e.select("session_id", "at_ms", F.col("event_type").alias("type"), F.lit(UNKNOWN_RANK).alias("rank"), source)
    out = assembled(s, {"speech": speech_events(spoken), "event": other}, 0, 90_000_000)
    w = Window.partitionBy("session_id").orderBy("at_ms", "rank", "source", "type")
    return out.select("session_id", "at_ms", "type", "source", F.row_number().over(w).cast("long").alias("place"))


@query("session_activity", "SELECT user_id, epoch_ms(date_trunc('hour', ts)) AS hour_ms, epoch_ms(max(ts)) AS last_ms, count(*) AS events FROM events GROUP BY user_id, date_trunc('hour', ts)")
def session_activity(spark, sf_dir):
    g = T(spark, sf_dir, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("events"))
    return g.select("user_id", F.unix_millis("w.start").alias("hour_ms"), epoch_ms(F.col("last")).alias("last_ms"), "events")


@query("rotation_split", f"WITH {d.SESSIONS} SELECT session_id, epoch_ms(least(coalesce(ended_at, TIMESTAMP '2024-02-01 03:00:00'), TIMESTAMP '2024-02-01 03:00:00')) AS ended_ms, ended_at IS NULL AS rotated FROM sessions WHERE started_at < TIMESTAMP '2024-02-01 03:00:00'")
def rotation_split(spark, sf_dir):
    cut = F.lit("2024-02-01 03:00:00").cast("timestamp")
    s = d.sessions(spark, sf_dir).filter(F.col("started_at").cast("timestamp") < cut)
    return s.select("session_id", epoch_ms(F.least(F.coalesce(F.col("ended_at").cast("timestamp"), cut), cut)).alias("ended_ms"), F.col("ended_at").isNull().alias("rotated"))


@query("checksum_check", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, sha256(coalesce(text, '')) = CASE WHEN doc_id % 50 = 0 THEN 'bad' ELSE sha256(coalesce(text, '')) END AS valid FROM documents")
def checksum_check(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    return T(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), (digest == F.when(F.col("doc_id") % 50 == 0, "bad").otherwise(digest)).alias("valid"))


@query("elapsed_ms", f"WITH {d.SESSION_EVENTS} SELECT event_id, session_id, at_ms FROM session_events")
def elapsed_ms(spark, sf_dir):
    return d.session_events(spark, sf_dir).select("event_id", "session_id", "at_ms")


@query("pcm_durations", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * 1000 / (8000 * (1 + l_linenumber % 2) * 2), 0) AS BIGINT) AS duration_ms FROM lineitem")
def pcm_durations(spark, sf_dir):
    from sessionloom.functions.scalars import pcm_duration_ms

    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pcm_duration_ms(F.col("l_extendedprice"), F.lit(8000), 1 + F.col("l_linenumber") % 2).alias("duration_ms"))

