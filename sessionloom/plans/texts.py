"""Queries of transcript search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.english import STOP_WORDS, SUFFIXES
from sessionloom.functions.storage import shared_dir
from sessionloom.operators import search_index as ix
from sessionloom.operators import text as tx
from sessionloom.plans import derived as d
from sessionloom.plans.catalog import query


def stem_sql(x: str) -> str:
    for pattern, rest in SUFFIXES:
        x = f"regexp_replace({x}, '{pattern}', '{rest}')"
    return x


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def post_sql(source: str, id_col: str) -> str:
    return f"""w AS (SELECT {id_col} AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM {source}),
p0 AS (SELECT id, len(ws) AS n_words, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
post AS (SELECT id, n_words, pos, {stem_sql('word')} AS stem FROM p0 WHERE word NOT IN ({STOPS}))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each benchmark item as queries: plain, with a phrase, with a bar, with an alternative."""
    w = F.split(F.lower("text"), r"[^a-z0-9]+")
    b = d.table(spark, sf_dir, "benchmark").filter(F.size(w) >= 6).select(F.col("item_id").alias("query_id"), w.alias("w"))
    q = F.when(F.col("query_id") % 4 == 0, F.concat_ws(" ", F.col("w")[0], F.col("w")[2])).when(F.col("query_id") % 4 == 1, F.concat(F.lit('"'), F.col("w")[0], F.lit(" "), F.col("w")[1], F.lit('"')))
    q = q.when(F.col("query_id") % 4 == 2, F.concat(F.col("w")[0], F.lit(" -"), F.col("w")[3])).otherwise(F.concat_ws(" or ", F.col("w")[1], F.col("w")[4]))
    return b.select("query_id", q.alias("query"))


@query("posting_counts", f"WITH {post_sql('documents', 'doc_id')} SELECT stem, count(*) AS occurrences, count(DISTINCT id) AS documents FROM post GROUP BY stem")
def posting_counts(spark, sf_dir):
    p = tx.postings(d.table(spark, sf_dir, "documents"), "doc_id", "text", "light")
    each = p.groupBy("stem", "id").agg(F.count("*").alias("n"))
    return each.groupBy("stem").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


MATCHES = f"""WITH {post_sql('(SELECT conv_id * 1000 + turn AS id, text FROM conversations)', 'id')},
b0 AS (SELECT item_id AS q, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM benchmark), b AS (SELECT * FROM b0 WHERE len(w) >= 6),
s AS (SELECT q, {', '.join(f"CASE WHEN w[{i + 1}] IN ({STOPS}) OR w[{i + 1}] = '' THEN NULL ELSE {stem_sql(f'w[{i + 1}]')} END AS s{i}" for i in range(5))} FROM b),
pr AS (SELECT DISTINCT id, stem FROM post)
SELECT q AS query_id, id FROM s, (SELECT DISTINCT id FROM pr) x WHERE q % 4 = 0 AND (s0 IS NOT NULL OR s2 IS NOT NULL) AND (s0 IS NULL OR (id, s0) IN (SELECT id, stem FROM pr)) AND (s2 IS NULL OR (id, s2) IN (SELECT id, stem FROM pr))
UNION SELECT q, a.id FROM s JOIN post a ON a.stem = coalesce(s0, s1) LEFT JOIN post c ON c.id = a.id AND c.pos = a.pos + 1 AND c.stem = s1 WHERE q % 4 = 1 AND (s0 IS NULL OR s1 IS NULL OR c.id IS NOT NULL)
UNION SELECT q, id FROM s JOIN pr ON stem = s0 WHERE q % 4 = 2 AND (s3 IS NULL OR (id, s3) NOT IN (SELECT id, stem FROM pr))
UNION SELECT q, id FROM s JOIN pr ON stem = s1 OR stem = s4 WHERE q % 4 = 3"""


@query("search_matches", MATCHES)
def search_matches(spark, sf_dir):
    return tx.matches(tx.postings(corpus(spark, sf_dir), "id", "text", "light"), tx.parsed_queries(asked(spark, sf_dir), "light"))


@query("indexed_matches", MATCHES)
def indexed_matches(spark, sf_dir):
    """The same from a stored index, of which a third of the documents came in a second generation, some in place of others."""
    path, c = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", corpus(spark, sf_dir)
    stale = c.withColumn("text", F.when(F.col("id") % 3 == 1, F.concat(F.lit("stale "), F.reverse("text"))).otherwise(F.col("text")))
    ix.index_documents(stale.filter("id % 9 <> 1"), path, analyser="light")
    ix.index_documents(c.filter("id % 3 = 1"), path, analyser="light")
    terms = tx.parsed_queries(asked(spark, sf_dir), "light")
    return tx.matches(ix.looked_up(spark, path, terms), terms)


@query("search_transcripts")
def search_transcripts(spark, sf_dir):
    return tx.search(corpus(spark, sf_dir), asked(spark, sf_dir), "id", "text")


@query("headlines", "SELECT doc_id, count(*) AS segments, count(CASE WHEN m THEN 1 END) AS matches FROM (SELECT doc_id, unnest(regexp_extract_all(replace(replace(text, '[[', ''), ']]', ''), '[^ \\n]+')) LIKE '%the%' AS m FROM documents) GROUP BY doc_id")
def headlines(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace("text", r"\[\[|\]\]", ""))
    words = F.regexp_extract_all("t", F.lit(r"[^ \n]+"), F.lit(0))
    marked = F.array_join(F.transform(words, lambda w: F.when(w.contains("the"), F.concat(F.lit("[["), w, F.lit("]]"))).otherwise(w)), "][".replace("][", " "))
    seg = docs.select("doc_id", F.size(words).alias("n"), tx.snippet_segments(marked).alias("s"))
    return seg.filter("n > 0").select("doc_id", F.col("n").cast("long").alias("segments"), F.size(F.filter("s", lambda x: x["match"])).cast("long").alias("matches"))


@query("first_match_headline")
def first_match_headline(spark, sf_dir):
    """The best fragment of 10 to 30 words of every document for three stems."""
    docs = d.table(spark, sf_dir, "documents").filter("text is not null").withColumn("stems", F.array(F.lit("th"), F.lit("and"), F.lit("ing")))
    return docs.select("doc_id", tx.headline("text", "stems").alias("headline"))
