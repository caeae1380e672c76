"""Queries over session timelines: scored windows, turns, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import intervals as iv
from sessionloom.operators import spans as sp
from sessionloom.plans import derived as d
from sessionloom.plans.catalog import query

HYST = d.WINDOWS + """,
mem AS (SELECT DISTINCT ON (session_id, label, start_ms, end_ms) * FROM win WHERE score >= 0.3 ORDER BY session_id, label, start_ms, end_ms, score DESC),
m1 AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id, label ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM mem),
m2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, label ORDER BY start_ms, end_ms) AS isl FROM m1),
m3 AS (SELECT *, max(CASE WHEN score >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, label, isl ORDER BY start_ms, end_ms) AS opened FROM m2),
hs AS (SELECT session_id, label, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS windows, max(score) AS peak, avg(score) AS mean FROM m3 WHERE opened = 1 GROUP BY session_id, label, isl HAVING count(*) >= 3)"""


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.hysteresis_spans(sp.exploded(d.scored_windows(spark, sf_dir), ["session_id"]), ["session_id"])


@query("sound_spans", f"WITH {HYST} SELECT session_id, label, start_ms, end_ms, windows, round(peak, 6) AS peak, round(mean, 6) AS mean FROM hs")
def sound_spans(spark, sf_dir):
    s = hysteresis(spark, sf_dir)
    return s.select("session_id", "label", "start_ms", "end_ms", "windows", F.round("peak", 6).alias("peak"), F.round("mean", 6).alias("mean"))


LANES = HYST + """,
cl AS (SELECT session_id, label, count(*) AS spans, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, max(peak) AS class_peak FROM hs GROUP BY session_id, label),
rk AS (SELECT *, row_number() OVER w AS rank, sum(spans) OVER (PARTITION BY session_id ORDER BY total_ms DESC, class_peak DESC, label ROWS UNBOUNDED PRECEDING) AS running FROM cl WINDOW w AS (PARTITION BY session_id ORDER BY total_ms DESC, class_peak DESC, label))"""


@query("sound_span_lanes", f"WITH {LANES} SELECT session_id, label, spans, total_ms, round(class_peak, 6) AS peak, rank FROM rk")
def sound_span_lanes(spark, sf_dir):
    return sp.class_lanes(hysteresis(spark, sf_dir), ["session_id"]).select("session_id", "label", "spans", "total_ms", F.round("peak", 6).alias("peak"), F.col("rank").cast("long").alias("rank"))


SELECTED = LANES + """,
kept AS (SELECT session_id, label, rank, spans FROM rk WHERE rank <= 3 AND (running <= 6 OR rank = 1)),
pick AS (SELECT hs.*, kept.rank, kept.spans, row_number() OVER (PARTITION BY hs.session_id, hs.label ORDER BY hs.end_ms - hs.start_ms DESC, hs.start_ms) AS i FROM hs JOIN kept ON hs.session_id = kept.session_id AND hs.label = kept.label)"""


@query("sound_span_budget", f"WITH {SELECTED} SELECT session_id, label, start_ms, end_ms, windows, rank AS class_rank FROM pick WHERE spans <= 6 OR i <= 6")
def sound_span_budget(spark, sf_dir):
    s = sp.selected_spans(hysteresis(spark, sf_dir), ["session_id"], top_k=3, max_spans=6)
    return s.select("session_id", "label", "start_ms", "end_ms", "windows", F.col("class_rank").cast("long").alias("class_rank"))


TAGS = d.ORD + """,
lab AS (SELECT user_id AS session_id, i, unnest([event_type, 'any']) AS label, unnest([k / 99.0, 1 - k / 99.0]) AS score, count(*) OVER (PARTITION BY user_id) AS total FROM ord),
hit AS (SELECT *, i - row_number() OVER (PARTITION BY session_id, label ORDER BY i) AS run FROM lab WHERE score >= 0.3),
runs AS (SELECT session_id, label, run, total, count(*) AS n, max(score) AS score FROM hit GROUP BY session_id, label, run, total),
tg AS (SELECT session_id, label, max(score) AS score FROM runs GROUP BY session_id, label, total HAVING max(n) >= least(2, total)),
tr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, label) AS rank FROM tg)"""


@query("session_tags", f"WITH {TAGS} SELECT session_id, label, round(score, 6) AS score, rank FROM tr WHERE rank <= 15")
def session_tags(spark, sf_dir):
    return sp.session_tags(d.scored_windows(spark, sf_dir), ["session_id"]).select("session_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("tag_search", f"WITH {d.WINDOWS}, h AS (SELECT DISTINCT ON (session_id, start_ms) * FROM win WHERE label ILIKE '%i%' AND score >= 0.5 ORDER BY session_id, start_ms, score DESC, label) SELECT session_id, start_ms, end_ms, label, round(score, 6) AS score FROM h ORDER BY h.score DESC, session_id, start_ms LIMIT 100")
def tag_search(spark, sf_dir):
    return sp.tag_search(d.scored_windows(spark, sf_dir), ["session_id"], "I", min_score=0.5, limit=100).select("session_id", "start_ms", "end_ms", "label", F.round("score", 6).alias("score"))


@query("tag_vocabulary", f"WITH {d.WINDOWS} SELECT label, count(*) AS windows, round(max(score), 6) AS max_score FROM win GROUP BY label")
def tag_vocabulary(spark, sf_dir):
    return sp.tag_vocabulary(d.scored_windows(spark, sf_dir), ["session_id"]).withColumn("max_score", F.round("max_score", 6))


EDGES = """edges AS (SELECT n_name AS label, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: d.table(spark, sf_dir, n)
    nation = t("nation")
    up = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), F.col("r_name").alias("parent"))
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", "n_name")
    s = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name")
    return up.union(c).union(s).distinct()


@query("ontology_closure", f"WITH RECURSIVE {EDGES}, up AS (SELECT label, parent AS ancestor FROM edges UNION SELECT up.label, e.parent FROM up JOIN edges e ON up.ancestor = e.label) SELECT label, ancestor FROM up WHERE label <> ancestor")
def ontology_closure(spark, sf_dir):
    return sp.closure(ontology(spark, sf_dir))


SUPPRESSED = f"""WITH RECURSIVE {EDGES}, up AS (SELECT label, parent AS ancestor FROM edges UNION SELECT up.label, e.parent FROM up JOIN edges e ON up.ancestor = e.label),
l AS (SELECT o_orderdate AS win, c_name AS label, max(o_totalprice) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
 UNION ALL SELECT o_orderdate, n_name, avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT CAST(win AS VARCHAR) AS win, label, round(score, 2) AS score FROM l WHERE NOT EXISTS (SELECT 1 FROM l c JOIN up ON c.label = up.label WHERE c.win = l.win AND up.ancestor = l.label AND c.score >= l.score)"""


@query("ancestor_suppression", SUPPRESSED)
def ancestor_suppression(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").join(d.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(d.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = o.groupBy(F.col("o_orderdate").alias("win"), F.col("c_name").alias("label")).agg(F.max("o_totalprice").alias("score"))
    b = o.groupBy(F.col("o_orderdate").alias("win"), F.col("n_name").alias("label")).agg(F.avg("o_totalprice").alias("score"))
    kept = sp.without_ancestors(a.union(b), sp.closure(ontology(spark, sf_dir)), ["win"])
    return kept.select(F.col("win").cast("string").alias("win"), "label", F.round("score", 2).alias("score"))


MERGED = """mi0 AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM turns WHERE end_ms > start_ms),
mi1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, speaker ORDER BY start_ms, end_ms) AS isl FROM mi0),
merged AS (SELECT session_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM mi1 GROUP BY session_id, speaker, isl)"""


@query("merged_turns", f"WITH {d.TURNS}, {MERGED.format(gap=1500)} SELECT session_id, speaker, start_ms, end_ms, n FROM merged")
def merged_turns(spark, sf_dir):
    return iv.merge_intervals(d.turns(spark, sf_dir).filter("end_ms > start_ms"), ["session_id", "speaker"], 1500).select("session_id", "speaker", "start_ms", "end_ms", "n")


@query("turns_overlapping", f"WITH {d.TURNS} SELECT session_id, turn_id, start_ms, end_ms FROM turns WHERE start_ms < 60000 AND end_ms > 20000")
def turns_overlapping(spark, sf_dir):
    return iv.overlapping(d.turns(spark, sf_dir), 20_000, 60_000).select("session_id", "turn_id", "start_ms", "end_ms")


@query("turn_range_join", f"WITH {d.TURNS} SELECT a.session_id, count(*) AS pairs, CAST(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS BIGINT) AS overlap_ms FROM turns a JOIN turns b ON a.session_id = b.session_id AND a.speaker < b.speaker AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY a.session_id")
def turn_range_join(spark, sf_dir):
    t = d.turns(spark, sf_dir).select("session_id", "speaker", "start_ms", "end_ms")
    met = iv.range_join(t, t, ["session_id"]).filter("speaker < speaker_r")
    return met.groupBy("session_id").agg(F.count("*").alias("pairs"), F.sum(F.least("end_ms", "end_ms_r") - F.greatest("start_ms", "start_ms_r")).alias("overlap_ms"))


OVERLAP = MERGED.format(gap=0) + """,
ed AS (SELECT session_id, x, sum(d) AS d FROM (SELECT session_id, start_ms AS x, 1 AS d FROM merged UNION ALL SELECT session_id, end_ms, -1 FROM merged) GROUP BY session_id, x),
lv AS (SELECT session_id, x, sum(d) OVER (PARTITION BY session_id ORDER BY x) AS level, lead(x) OVER (PARTITION BY session_id ORDER BY x) AS till FROM ed),
reg AS (SELECT session_id, x AS start_ms, till AS end_ms FROM lv WHERE level >= 2)"""


@query("speaker_overlap", f"WITH {d.TURNS}, {OVERLAP}, r0 AS (SELECT *, lag(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms) AS pe FROM reg), r1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms > pe THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms) AS g FROM r0) SELECT session_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r1 GROUP BY session_id, g")
def speaker_overlap(spark, sf_dir):
    return iv.speaker_overlap(d.turns(spark, sf_dir), ["session_id"]).select("session_id", "start_ms", "end_ms")


CLEAN = OVERLAP + """,
ov AS (SELECT t.session_id, t.turn_id, sum(least(t.end_ms, r.end_ms) - greatest(t.start_ms, r.start_ms)) AS o FROM turns t JOIN reg r ON t.session_id = r.session_id AND t.start_ms < r.end_ms AND r.start_ms < t.end_ms GROUP BY ALL),
clean AS (SELECT t.*, CAST(coalesce(o, 0) AS BIGINT) AS overlap_ms, CAST(greatest(t.end_ms - t.start_ms - coalesce(o, 0), 0) AS BIGINT) AS clean_ms FROM turns t LEFT JOIN ov ON t.session_id = ov.session_id AND t.turn_id = ov.turn_id)"""


@query("turn_clean_time", f"WITH {d.TURNS}, {CLEAN} SELECT session_id, turn_id, overlap_ms, clean_ms FROM clean")
def turn_clean_time(spark, sf_dir):
    return iv.clean_time(d.turns(spark, sf_dir), ["session_id"], "turn_id").select("session_id", "turn_id", "overlap_ms", "clean_ms")


@query("prorated_overlap", f"WITH {d.TURNS}, {CLEAN}, u AS (SELECT DISTINCT session_id, (start_ms // 10000) * 10000 AS start_ms FROM turns), x AS (SELECT u.session_id, u.start_ms, sum(round_even(c.overlap_ms * (least(c.end_ms, u.start_ms + 10000) - greatest(c.start_ms, u.start_ms)) / (c.end_ms - c.start_ms), 0)) AS o FROM u JOIN clean c ON c.session_id = u.session_id AND c.start_ms < u.start_ms + 10000 AND c.end_ms > u.start_ms GROUP BY ALL) SELECT session_id, start_ms, CAST(o AS BIGINT) AS overlap_ms FROM x")
def prorated_overlap(spark, sf_dir):
    t = d.turns(spark, sf_dir)
    u = t.select("session_id", F.expr("(start_ms div 10000) * 10000").alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + 10000).withColumn("id", F.col("start_ms"))
    return iv.prorated_overlap(u, iv.clean_time(t, ["session_id"], "turn_id"), ["session_id"], "id").select("session_id", "start_ms", "overlap_ms")


GAPS = MERGED.format(gap=0) + """,
gp AS (SELECT session_id, speaker, end_ms AS gs, lead(start_ms) OVER (PARTITION BY session_id, speaker ORDER BY start_ms) AS ge FROM merged)"""


@query("gap_crosstalk", f"""WITH {d.TURNS}, {GAPS}, g AS (SELECT * FROM gp WHERE ge > gs AND ge - gs <= 20000),
c0 AS (SELECT g.session_id, g.speaker, g.gs, g.ge, greatest(t.start_ms, g.gs) AS s, least(t.end_ms, g.ge) AS e FROM g JOIN turns t ON t.session_id = g.session_id AND t.speaker <> g.speaker AND t.start_ms < g.ge AND t.end_ms > g.gs),
c1 AS (SELECT *, coalesce(max(e) OVER (PARTITION BY session_id, speaker, gs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS pe FROM c0),
c2 AS (SELECT session_id, speaker, gs, sum(greatest(e - greatest(s, pe), 0)) AS ms FROM c1 GROUP BY ALL)
SELECT g.session_id, g.speaker, g.gs AS start_ms, g.ge AS end_ms, CAST(coalesce(ms, 0) AS BIGINT) AS crosstalk_ms FROM g LEFT JOIN c2 ON g.session_id = c2.session_id AND g.speaker = c2.speaker AND g.gs = c2.gs""")
def gap_crosstalk(spark, sf_dir):
    from pyspark.sql import Window

    t = d.turns(spark, sf_dir)
    m = iv.merge_intervals(t.filter("end_ms > start_ms"), ["session_id", "speaker"])
    w = Window.partitionBy("session_id", "speaker").orderBy("start_ms")
    g = m.select("session_id", "speaker", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms")).filter("end_ms > start_ms and end_ms - start_ms <= 20000").withColumn("gap_id", F.concat_ws(":", "speaker", "start_ms"))
    return iv.gap_crosstalk(g, t, ["session_id"], "gap_id").select("session_id", "speaker", "start_ms", "end_ms", "crosstalk_ms")


@query("diarization_blocks")
def diarization_blocks(spark, sf_dir):
    return iv.capped_runs(d.turns(spark, sf_dir), ["session_id"], 4_000, 60_000)


@query("utterances")
def utterances(spark, sf_dir):
    return iv.utterances(d.turns(spark, sf_dir), ["session_id"])


@query("speech_spans")
def speech_spans(spark, sf_dir):
    return iv.speech_spans(d.frames(spark, sf_dir), ["session_id"], threshold=0.8, merge_gap_ms=100, min_speech_ms=64, pad_ms=20, max_span_ms=600)


@query("speech_map", f"""WITH {d.FRAMES}, f AS (SELECT *, frame - row_number() OVER (PARTITION BY session_id ORDER BY frame) AS g FROM frames WHERE p >= 0.5),
r AS (SELECT session_id, g, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY ALL)
SELECT t.session_id, count(r.g) AS spans, CAST(coalesce(sum(r.n), 0) * 32 AS BIGINT) AS speech_ms, t.n * 32 AS total_ms FROM t LEFT JOIN r ON t.session_id = r.session_id GROUP BY t.session_id, t.n""")
def speech_map(spark, sf_dir):
    f = d.frames(spark, sf_dir)
    runs = iv.merge_intervals(f.filter("p >= 0.5").select("session_id", (F.col("frame") * 32).alias("start_ms"), ((F.col("frame") + 1) * 32).alias("end_ms")), ["session_id"])
    total = f.groupBy("session_id").agg(((F.max("frame") + 1) * 32).alias("total_ms"))
    by = runs.groupBy("session_id").agg(F.count("*").alias("spans"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return total.join(by, "session_id", "left").select("session_id", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("speech_ms", F.lit(0)).alias("speech_ms"), "total_ms")


@query("even_pieces", f"WITH {d.TURNS}, t AS (SELECT *, end_ms - start_ms AS len, greatest(CAST(ceil((end_ms - start_ms) / 3000.0) AS BIGINT), 1) AS n FROM turns) SELECT session_id, turn_id, start_ms + (len * i) // n AS start_ms, start_ms + (len * (i + 1)) // n AS end_ms FROM t, LATERAL unnest(range(n)) AS u(i)")
def even_pieces(spark, sf_dir):
    return iv.even_pieces(d.turns(spark, sf_dir), 3_000).select("session_id", "turn_id", "start_ms", "end_ms")


@query("block_sub_spans", f"WITH {d.TURNS} SELECT session_id, turn_id, x AS start_ms, least(x + 4000, end_ms) AS end_ms FROM turns, LATERAL unnest(range(start_ms, greatest(end_ms, start_ms + 1), 4000)) AS u(x)")
def block_sub_spans(spark, sf_dir):
    return iv.fixed_pieces(d.turns(spark, sf_dir), 4_000).select("session_id", "turn_id", "start_ms", "end_ms")


@query("window_grid", "WITH c AS (SELECT doc_id, n_chars AS total FROM documents WHERE n_chars > 0) SELECT doc_id, s AS start_ms, least(s + 1000, total) AS end_ms FROM c, LATERAL unnest(range(0, total, 500)) AS u(s) WHERE s = 0 OR (s + 500 < total AND least(s + 1000, total) - s >= 200)")
def window_grid(spark, sf_dir):
    clips = d.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("total_ms"))
    return iv.window_grid(clips, window_ms=1000, hop_ms=500, min_tail_ms=200).select("doc_id", "start_ms", "end_ms")


@query("render_spans", "WITH c AS (SELECT doc_id, n_chars AS total FROM documents WHERE n_chars > 0) SELECT doc_id, i * 1900 AS start_ms, least(i * 1900 + 2000, total) AS end_ms FROM c, LATERAL unnest(range(greatest(CAST(ceil((total - 100) / 1900.0) AS BIGINT), 1))) AS u(i)")
def render_spans(spark, sf_dir):
    clips = d.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("total_ms"))
    return iv.render_spans(clips, span_ms=2000, overlap_ms=100).select("doc_id", "start_ms", "end_ms")


@query("words_in_utterances", f"WITH {d.TURNS} SELECT t.session_id, t.turn_id, count(*) AS words FROM turns t JOIN turns w ON t.session_id = w.session_id AND (w.start_ms + w.end_ms) // 2 >= t.start_ms AND (w.start_ms + w.end_ms) // 2 < t.end_ms GROUP BY ALL")
def words_in_utterances(spark, sf_dir):
    t = d.turns(spark, sf_dir)
    words = t.select("session_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))
    return iv.assign_points(words, t, ["session_id"]).groupBy("session_id", "turn_id").agg(F.count("*").alias("words"))
