"""Queries over speakers and artifacts: labels, talk time, redo and incremental work, model answers, frames."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.scalars import epoch_ms, rotation_instant
from sessionloom.operators import clustering as cl
from sessionloom.operators import intervals as iv
from sessionloom.operators import pcm
from sessionloom.operators import tables as tb
from sessionloom.operators import timeline as tl
from sessionloom.operators import vectors as ve
from sessionloom.operators import voices as vo
from sessionloom.plans import derived as d
from sessionloom.plans.catalog import query
from sessionloom.plans.vectors import CENT, CV, E, prints
from sessionloom.sources import artifacts as ar

LABELS = d.TURNS + """,
lab AS (SELECT DISTINCT session_id, speaker FROM turns),
mem AS (SELECT session_id, speaker, session_id % 4 * 10 + CAST(substr(speaker, 2) AS BIGINT) AS speaker_id FROM lab WHERE speaker <> 'S2' AND session_id % 3 <> 0),
spk AS (SELECT DISTINCT speaker_id, CASE WHEN speaker_id % 10 = 0 THEN 'Name ' || (speaker_id // 20) END AS name FROM mem)"""


def labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(turns, labels, labels with a speaker, speakers): two speakers share each name, some have none."""
    t = d.turns(spark, sf_dir)
    lab = t.select("session_id", "speaker").distinct()
    mem = lab.filter("speaker <> 'S2' and session_id % 3 <> 0").withColumn("speaker_id", F.col("session_id") % 4 * 10 + F.substring("speaker", 2, 9).cast("long"))
    name = F.when(F.col("speaker_id") % 10 == 0, F.concat(F.lit("Name "), F.floor(F.col("speaker_id") / 20).cast("string")))
    return t, lab, mem, mem.select("speaker_id", name.alias("name")).distinct()


@query("voice_talk_time", f"WITH {LABELS} SELECT session_id, coalesce(CAST(speaker_id AS VARCHAR), 'local:' || speaker) AS voice, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS turns FROM turns LEFT JOIN mem USING (session_id, speaker) GROUP BY 1, 2")
def voice_talk_time(spark, sf_dir):
    t, _, mem, _ = labels(spark, sf_dir)
    return vo.talk_time(t, mem)


@query("session_labels", f"WITH {LABELS} SELECT session_id, speaker, speaker_id, name FROM lab LEFT JOIN mem USING (session_id, speaker) LEFT JOIN spk USING (speaker_id)")
def session_labels(spark, sf_dir):
    _, lab, mem, spk = labels(spark, sf_dir)
    return vo.session_labels(lab, mem, spk).select("session_id", "speaker", "speaker_id", "name")


def transcripts(t: DataFrame) -> DataFrame:
    """Turns as transcripts whose speaker is a field of their JSON metadata."""
    t = t.select("session_id", "turn_id", F.to_json(F.struct("speaker")).alias("metadata"))
    return t.withColumn("speaker", F.get_json_object("metadata", "$.speaker"))


@query("said_by_speaker", f"WITH {LABELS} SELECT session_id, turn_id FROM turns JOIN mem USING (session_id, speaker) WHERE speaker_id = 10")
def said_by_speaker(spark, sf_dir):
    t, lab, mem, spk = labels(spark, sf_dir)
    return vo.said_by(transcripts(t), vo.session_labels(lab, mem, spk), F.col("speaker_id") == 10).select("session_id", "turn_id")


@query("said_by_name", f"WITH {LABELS} SELECT session_id, turn_id FROM turns JOIN mem USING (session_id, speaker) JOIN spk USING (speaker_id) WHERE name = 'Name 0'")
def said_by_name(spark, sf_dir):
    t, lab, mem, spk = labels(spark, sf_dir)
    return vo.said_by(transcripts(t), vo.session_labels(lab, mem, spk), F.col("name") == "Name 0").select("session_id", "turn_id")


@query("stamped_transcripts", f"WITH {LABELS} SELECT turn_id, speaker_id, name AS speaker_name FROM turns LEFT JOIN mem USING (session_id, speaker) LEFT JOIN spk USING (speaker_id)")
def stamped_transcripts(spark, sf_dir):
    t, _, mem, spk = labels(spark, sf_dir)
    known = mem.join(spk, "speaker_id").withColumnsRenamed({"speaker": "label", "name": "speaker_name"})
    return tl.stamped(t.withColumnRenamed("speaker", "label"), known).select("turn_id", "speaker_id", "speaker_name")


@query("pinned_turns", f"WITH {d.TURNS}, pins AS (SELECT DISTINCT session_id, speaker, k % 2 AS model, session_id * 10 AS pinned_to FROM turns WHERE session_id % 2 = 0 AND k < 40) SELECT turn_id, pinned_to FROM turns LEFT JOIN pins ON pins.session_id = turns.session_id AND pins.speaker = turns.speaker AND model = k % 2")
def pinned_turns(spark, sf_dir):
    t = d.turns(spark, sf_dir).withColumn("model", F.col("k") % 2)
    pins = t.filter("session_id % 2 = 0 and k < 40").select("session_id", "speaker", "model", (F.col("session_id") * 10).alias("pinned_to")).distinct()
    return t.join(pins, ["session_id", "speaker", "model"], "left").select("turn_id", "pinned_to")


@query("cluster_rebuild_counts", f"WITH {E}, p AS (SELECT *, CASE WHEN vec_id % 97 = 0 THEN -1 - vec_id % 2 END AS pin FROM e), g AS (SELECT *, pin IS NOT NULL OR talk_ms >= 3000 AS used FROM p) SELECT user_id, count(DISTINCT CASE WHEN used THEN coalesce(pin, label) END) AS clusters, count(CASE WHEN used AND pin IS NULL THEN 1 END) AS assigned, count(CASE WHEN NOT used THEN 1 END) AS skipped, count(pin) AS pinned FROM g GROUP BY user_id")
def cluster_rebuild_counts(spark, sf_dir):
    pin = F.when(F.col("vec_id") % 97 == 0, F.lit(-1) - F.col("vec_id") % 2)
    return vo.rebuild_counts(prints(spark, sf_dir).withColumn("pin", pin).withColumnRenamed("label", "cluster"), ["user_id"], min_talk_ms=3000)


@query("speaker_rebuild")
def speaker_rebuild(spark, sf_dir):
    """Speakers of every user made anew under the user's own gate and threshold."""
    p = prints(spark, sf_dir).withColumn("pin", F.when(F.col("vec_id") % 97 == 0, F.concat(F.lit("p"), F.col("vec_id") % 2)))
    parameters = p.select("user_id").distinct().withColumn("min_talk_ms", F.col("user_id") * 1000).withColumn("threshold", F.when(F.col("user_id") % 2 == 0, 0.65).otherwise(0.5))
    return vo.rebuilt(p, ["user_id"], parameters, id_col="vec_id")[1]


def merges(spark, sf_dir):
    p = prints(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("speaker_id"), "embedding")
    speakers = p.select("speaker_id", F.when(F.col("speaker_id") % 2 == 1, F.concat(F.lit("Name "), F.col("speaker_id").cast("string"))).alias("name")).distinct()
    there = speakers.select((F.col("speaker_id") - 1).alias("from_id"), F.col("speaker_id").alias("to_id"))
    edges = there.join(speakers.select(F.col("speaker_id").alias("from_id")), "from_id").filter("from_id % 3 <> 2")
    return vo.merged_clusters(edges, p, speakers, "embedding")


#: Chains of merges 0 -> 1 -> 2, 3 -> 4 -> 5 and so on, of the labels that are there.
CHAINS = "ed AS (SELECT DISTINCT label AS a, label + 1 AS b FROM e WHERE label % 3 <> 2 AND label + 1 IN (SELECT label FROM e)), up AS (SELECT label AS id, label AS r FROM e UNION SELECT id, b FROM up JOIN ed ON r = a), sv AS (SELECT id AS label, max(r) AS survivor FROM up GROUP BY id)"


@query("merged_cluster_members", f"WITH RECURSIVE {E}, {CHAINS} SELECT vec_id AS id, survivor, label IN (SELECT a FROM ed UNION SELECT b FROM ed) AS pinned FROM e JOIN sv USING (label)")
def merged_cluster_members(spark, sf_dir):
    return merges(spark, sf_dir)[0].select("id", "survivor", "pinned")


@query("merged_clusters", f"WITH RECURSIVE {CENT}, {CHAINS}, c AS (SELECT survivor, i, avg(x) AS x FROM x JOIN sv USING (label) GROUP BY ALL), n AS (SELECT survivor, CASE WHEN survivor % 2 = 1 THEN 'Name ' || survivor ELSE 'Name ' || min(CASE WHEN label % 2 = 1 THEN label END) END AS name FROM sv GROUP BY 1) SELECT survivor, name, i, round(x, 6) AS x FROM c JOIN n USING (survivor)")
def merged_clusters(spark, sf_dir):
    c = merges(spark, sf_dir)[1]
    return c.select("survivor", "name", F.posexplode("centroid").alias("i", "x")).select("survivor", "name", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("kept_centroids", f"WITH {CENT}, o AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT label, i, avg(x) AS x FROM x WHERE label % 2 = 0 AND talk_ms >= 3000 GROUP BY ALL) SELECT label, i, round(coalesce(n.x, o.x), 6) AS x FROM o LEFT JOIN n USING (label, i)")
def kept_centroids(spark, sf_dir):
    p = prints(spark, sf_dir)
    c = ve.kept_centroids(ve.centroids(p.filter("label % 2 = 0 and talk_ms >= 3000"), ["label"], "embedding"), ve.centroids(p, ["label"], "embedding"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("cluster_markers")
def cluster_markers(spark, sf_dir):
    """Projection fitted on all prints; points with little talk are left out only after that."""
    p = prints(spark, sf_dir)
    _, markers = vo.projection_view(ve.projected(p, ve.fit_projection(p, "embedding"), "embedding"), F.col("talk_ms") >= 3000, ["label"])
    return markers.select("label", *[F.round(c, 6).alias(c) for c in "xyz"], "points")


@query("farthest_members", f"WITH {CV}, m AS (SELECT e.user_id, e.label, vec_id AS id, round(1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 5) AS distance FROM e JOIN cv ON e.user_id = cv.user_id AND e.label = cv.label), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY distance DESC, id) AS place FROM m) SELECT user_id, label, id, distance, place FROM r WHERE place BETWEEN 4 AND 6")
def farthest_members(spark, sf_dir):
    p = prints(spark, sf_dir).select("user_id", "label", F.col("vec_id").alias("id"), "embedding")
    m = ve.member_distances(p, ve.centroids(p, ["user_id", "label"], "embedding"), ["user_id", "label"], "embedding")
    return vo.farthest_members(m.withColumn("distance", F.round("distance", 5)), ["user_id", "label"], 3, 3).select("user_id", "label", "id", "distance", "place")


FEED = f"{E}, f AS (SELECT vec_id AS id, label + vec_id % 2 AS from_id, 99 AS to_id FROM e WHERE vec_id % 3 = 0)"


def moves(spark, sf_dir):
    p = prints(spark, sf_dir)
    feed = p.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + F.col("vec_id") % 2).alias("from_id"), F.lit(99).cast("long").alias("to_id"))
    return cl.reassigned(p.select(F.col("vec_id").alias("id"), F.col("label").alias("speaker_id")), feed)


@query("moved_members", f"WITH {FEED} SELECT vec_id AS id, CAST(coalesce(to_id, label) AS BIGINT) AS speaker_id FROM e LEFT JOIN f ON id = vec_id AND from_id = label")
def moved_members(spark, sf_dir):
    return moves(spark, sf_dir)[0]


@query("refused_moves", f"WITH {FEED} SELECT id, from_id FROM f JOIN e ON id = vec_id WHERE from_id <> label")
def refused_moves(spark, sf_dir):
    return moves(spark, sf_dir)[1].select("id", "from_id")


@query("stride_sample", "WITH r AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT user_id, event_id FROM r WHERE i % CAST(ceil(n / 7.0) AS BIGINT) = 0")
def stride_sample(spark, sf_dir):
    return vo.stride_sample(d.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id")


@query("rebased_words", f"WITH {d.TURNS} SELECT session_id, turn_id, start_ms, end_ms FROM turns")
def rebased_words(spark, sf_dir):
    """Clips of 20 s with word times relative to them; back to the session's time."""
    t = d.turns(spark, sf_dir).withColumn("clip_ms", F.floor(F.col("start_ms") / 20000) * 20000)
    word = F.struct("turn_id", (F.col("start_ms") - F.col("clip_ms")).alias("start_ms"), (F.col("end_ms") - F.col("clip_ms")).alias("end_ms"))
    clips = t.groupBy("session_id", "clip_ms").agg(F.collect_list(word).alias("words"))
    return iv.rebased(clips, "words", "clip_ms").select("session_id", F.explode("words").alias("w")).select("session_id", "w.*")


@query("namespaced_turns", f"WITH {d.TURNS} SELECT turn_id, 'b' || (start_ms // 60000 * 60000) || ':' || speaker AS speaker FROM turns WHERE end_ms - start_ms >= 300")
def namespaced_turns(spark, sf_dir):
    return iv.namespaced(d.turns(spark, sf_dir).withColumn("block_start", F.floor(F.col("start_ms") / 60000) * 60000)).select("turn_id", "speaker")


@query("utterance_blocks", f"WITH {d.TURNS}, u AS (SELECT *, k % 4 <> 0 AS b FROM turns) SELECT session_id, CASE WHEN b THEN start_ms // 60000 * 60000 ELSE start_ms END AS block_start, CASE WHEN b THEN start_ms // 60000 * 60000 + 60000 ELSE end_ms END AS block_end, count(*) AS utterances FROM u GROUP BY ALL")
def utterance_blocks(spark, sf_dir):
    block = F.when(F.col("k") % 4 != 0, F.floor(F.col("start_ms") / 60000) * 60000)
    return iv.by_block(d.turns(spark, sf_dir).withColumn("block_start", block).withColumn("block_end", F.col("block_start") + 60000))


TIERS = ["vad", "diarize", "transcribe"]
OUTPUTS = "o AS (SELECT l_orderkey AS session_id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'vad' WHEN 'N' THEN 'diarize' ELSE 'transcribe' END AS pipeline FROM lineitem), kept AS (SELECT * FROM o WHERE pipeline = 'vad' OR session_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))"


def after_redo(spark, sf_dir):
    flag = F.col("l_returnflag")
    out = d.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("n"), F.when(flag == "A", "vad").when(flag == "N", "diarize").otherwise("transcribe").alias("pipeline"))
    chosen = d.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"))
    return tb.redone(out, chosen, TIERS, "diarize")


@query("redo_outputs", f"WITH {OUTPUTS} SELECT session_id, n, pipeline FROM kept")
def redo_outputs(spark, sf_dir):
    return after_redo(spark, sf_dir)


@query("pending_after_redo", f"WITH {OUTPUTS} SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT session_id FROM kept WHERE pipeline = 'diarize')")
def pending_after_redo(spark, sf_dir):
    all_ = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    return tb.pending(all_, after_redo(spark, sf_dir).filter("pipeline = 'diarize'"), ["session_id"], ["session_id"])


@query("incremental_sessions", f"WITH {d.SESSIONS} SELECT session_id, last_at FROM sessions WHERE ended_at IS NOT NULL AND (session_id % 3 = 0 OR n_events % 2 = 0)")
def incremental_sessions(spark, sf_dir):
    """Ended sessions that were never processed, or that have changed since."""
    s = d.sessions(spark, sf_dir).filter("ended_at is not null")
    done = s.filter("session_id % 3 <> 0").select("session_id", F.when(F.col("n_events") % 2 == 0, F.col("last_at") - F.expr("interval 1 hour")).otherwise(F.col("last_at")).alias("last_at"))
    return tb.newly_ready(s, done, ["session_id"], "last_at").select("session_id", "last_at")


@query("audio_attrs_check", "WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) - 5 AS rate, CASE WHEN l_tax > 0.04 THEN l_linenumber - 1 END AS channels FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN rate <= 0 THEN 'rate' WHEN channels <= 0 THEN 'channels' END AS error FROM a")
def audio_attrs_check(spark, sf_dir):
    attrs = F.create_map(F.lit("rate"), (F.col("l_quantity").cast("int") - 5).cast("string"), F.lit("channels"), F.when(F.col("l_tax") > 0.04, F.col("l_linenumber") - 1).cast("string"))
    return d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", attrs.alias("attrs")).select("l_orderkey", "l_linenumber", ar.audio_errors().alias("error"))


@query("model_windows", f"WITH {d.ORD} SELECT event_id, i * 5000 AS start_ms, i * 5000 + 10000 AS end_ms FROM ord WHERE k % 5 <> 0 AND k % 7 <> 0")
def model_windows(spark, sf_dir):
    """Answers with inverted bounds (every fifth) or a null score (every seventh) are left out."""
    start, score = F.col("i") * 5000, F.when(F.col("k") % 7 != 0, F.col("k") / 99.0)
    w = F.struct(start.alias("start_ms"), F.when(F.col("k") % 5 == 0, start - 1).otherwise(start + 10000).alias("end_ms"), F.array(F.struct(F.col("event_type").alias("label"), score.alias("score"))).alias("labels"))
    raw = d.ordered_events(spark, sf_dir).select("event_id", F.to_json(F.array(w)).alias("response"))
    return ar.model_windows(raw).select("event_id", "start_ms", "end_ms")


@query("lenient_vectors", "SELECT vec_id, vec_id % 10 <> 0 AS usable FROM embeddings")
def lenient_vectors(spark, sf_dir):
    broken = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, F.lit(float("nan"))).otherwise(x))
    return pcm.checked_vectors(prints(spark, sf_dir).withColumn("embedding", broken), "embedding", strict=False).select("vec_id", F.col("embedding").isNotNull().alias("usable"))


@query("scored_prints", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS size FROM embeddings")
def scored_prints(spark, sf_dir):
    """The seam of models, with one that gives each vector's length."""

    def setup():
        return lambda b: pa.RecordBatch.from_arrays([b.column("vec_id"), pc.list_value_length(b.column("embedding")).cast(pa.int64())], names=["vec_id", "size"])

    return pcm.scored(prints(spark, sf_dir).select("vec_id", "embedding"), setup, "vec_id long, size long")


@query("frame_messages", f"WITH {d.ORD} SELECT user_id AS session_id, i AS sequence, k AS bytes, CASE WHEN k % 2 = 1 THEN 'partial sample' WHEN k > 80 THEN 'too large' END AS error FROM ord WHERE k > 0")
def frame_messages(spark, sf_dir):
    """Binary messages of k bytes of PCM, read back and judged."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    e = d.ordered_events(spark, sf_dir)
    raw = e.select(F.concat(F.unhex(F.lit("4652414D01")), number(F.col("user_id")), number(F.col("i")), number(epoch_ms(F.col("ts"))), F.encode(F.expr("repeat('a', int(k))"), "utf-8")).alias("value"))
    return ar.frame_messages(raw).select("session_id", "sequence", F.length("pcm").cast("long").alias("bytes"), ar.frame_errors(max_bytes=80).alias("error"))


KINDS = [("speech-detect", "speech-span"), ("transcribe", "transcript"), ("audio-tag", "audio-tag"), ("sound-span", "sound-span"), ("other", "thing")]


@query("expanded_timeline", f"""WITH {d.TURNS}, m AS (SELECT *, k / 99.0 AS x FROM turns)
SELECT session_id, turn_id, start_ms AS at_ms, 'speech-start' AS type, x AS confidence, NULL AS text, NULL AS chars, NULL AS speaker, NULL AS label FROM m WHERE k % 5 = 0
UNION ALL SELECT session_id, turn_id, end_ms, 'speech-end', x, NULL, NULL, NULL, NULL FROM m WHERE k % 5 = 0
UNION ALL SELECT session_id, turn_id, start_ms, 'transcript', NULL, 'said ' || k, length('said ' || k), speaker, NULL FROM m WHERE k % 5 = 1
UNION ALL SELECT session_id, turn_id, start_ms, 'audio-tag', NULL, NULL, NULL, NULL, NULL FROM m WHERE k % 5 = 2
UNION ALL SELECT session_id, turn_id, start_ms, 'sound-span', NULL, NULL, NULL, NULL, speaker FROM m WHERE k % 5 = 3 AND k % 7 <> 0""")
def expanded_timeline(spark, sf_dir):
    """Artifacts of four kinds as typed events by the registered expanders; an unknown kind and a span without a label give none."""
    kind = F.array(*[F.struct(F.lit(p).alias("pipeline"), F.lit(k).alias("kind")) for p, k in KINDS])[(F.col("k") % 5).cast("int")]
    said = F.to_json(F.struct((F.col("k") / 99.0).alias("confidence"), F.concat(F.lit("said "), F.col("k")).alias("text"), "speaker", F.when(F.col("k") % 7 != 0, F.col("speaker")).alias("label")))
    a = d.turns(spark, sf_dir).withColumn("of", kind).select("session_id", "of.*", "start_ms", "end_ms", F.col("turn_id").alias("source"), said.alias("metadata"))
    return tl.expanded(a).select("session_id", F.col("source").alias("turn_id"), "at_ms", "type", "confidence", "text", "chars", "speaker", "label")


@query("segment_timeline", f"WITH {d.POINTS} SELECT session_id, CAST(day AS VARCHAR) AS day, at_ms, 'location-point' AS type, round(lat, 6) AS lat, round(lon, 6) AS lon, epoch_ms(ts) AS captured_ms FROM fixes WHERE day <> DATE '2024-01-15'")
def segment_timeline(spark, sf_dir):
    """Raw segments as typed events by their resource; those of a resource without an expander give none."""
    day = F.to_date("captured_at")
    s = d.points(spark, sf_dir).select("session_id", "started_at", "points", day.cast("string").alias("source"), F.when(day == F.lit("2024-01-15").cast("date"), "audio").otherwise("location").alias("resource"))
    return tl.expanded_segments(s).select("session_id", F.col("source").alias("day"), "at_ms", "type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "captured_ms")


@query("artifacts_of_session", f"WITH {d.TURNS} SELECT turn_id AS artifact_id FROM turns WHERE session_id = 1 AND (k % 11 = 0 OR (end_ms > 10000 AND start_ms < 60000))")
def artifacts_of_session(spark, sf_dir):
    whole = F.col("k") % 11 == 0
    a = d.turns(spark, sf_dir).select("session_id", F.col("turn_id").alias("artifact_id"), *[F.when(~whole, F.col(c)).alias(c) for c in ("start_ms", "end_ms")])
    return ar.of_session(a, 1, from_ms=10000, to_ms=60000).select("artifact_id")


@query("json_objects", f"""WITH {d.ORD} SELECT event_id, '{{"id":' || event_id || CASE WHEN k % 2 = 0 THEN ',"label":"' || event_type || '"' ELSE '' END || '}}' AS body FROM ord""")
def json_objects(spark, sf_dir):
    """JSON objects; null fields are left out."""
    e = d.ordered_events(spark, sf_dir)
    return e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("label"))).alias("body"))


@query("names_any_case", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def names_any_case(spark, sf_dir):
    """Orders joined to customers by a name in other letters."""
    o = d.table(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("given"))
    return o.join(d.table(spark, sf_dir, "customer"), F.lower("given") == F.lower("c_name")).select("o_orderkey", "c_custkey")


@query("rounded_positions", "SELECT event_id, round_even(value / 1700 - 90, 5) AS lat FROM events")
def rounded_positions(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select("event_id", F.bround(F.col("value") / 1700 - 90, 5).alias("lat"))


@query("rotation_instants", "SELECT event_id, date_trunc('day', ts - INTERVAL 4 HOUR) + INTERVAL 4 HOUR AS rotated_at FROM events")
def rotation_instants(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select("event_id", rotation_instant(F.col("ts"), "04:00", "UTC").alias("rotated_at"))
