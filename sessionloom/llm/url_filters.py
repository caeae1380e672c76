"""URL filtering by rules and by a tree of path templates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, table, written

OUTPUTS = ["host", "path", "template", "rule", "verdict"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path from its slash on, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or for want of ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    none = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), none), F.coalesce(path, none)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host, or a parent domain of the host, and path prefix fit."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shaped(path: Column) -> Column:
    """The path with digits, and long hexadecimal runs, as wildcards; no trailing slash or page suffix."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.(html?|php|aspx?)$", ""), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?<=/|-|_)[0-9a-f]{8,}(?=/|-|_|$)", "*"), r"[0-9]+", "*")


def segments(shape: Column, max_depth: int) -> Column:
    """The segments of a shape behind its first slash; from ``max_depth`` on the whole rest is one."""
    each = F.slice(F.split(shape, "/"), 2, 1 << 30)
    rest = F.array_join(F.slice(each, max_depth, 1 << 30), "/")
    return F.when(F.size(each) <= max_depth, each).otherwise(F.concat(F.slice(each, 1, max_depth - 1), F.array(rest)))


def templates(shapes: DataFrame, *, max_children: int, max_depth: int = 32) -> DataFrame:
    """(host, shape, k, good) with its template: from the root down, a node with more than ``max_children`` children has the rarer of them made a wildcard.

    ``shapes``: host, shape, n, k, good.  A child holding a tenth of its parent's rows
    stays as it is.  A node of at most ``max_children`` shapes can have no wider node
    below, so its shapes are done at once: the rounds end where no wide node is left,
    at ``max_depth`` in any case, where what is left of a path is one segment.
    """
    t = shapes.withColumn("seg", segments(F.col("shape"), max_depth)).withColumn("prefix", F.lit(""))
    done, level = None, 0
    while True:
        # the node's shapes, and so the most children that any node below it can have
        node = t.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("shapes"))
        wide = t.join(node.filter(F.col("shapes") > max_children).select("host", "prefix"), ["host", "prefix"], "left_semi").filter(F.size("seg") > level)
        rest = F.concat("prefix", F.when(F.size("seg") > level, F.concat(F.lit("/"), F.array_join(F.slice("seg", level + 1, 1 << 30), "/"))).otherwise(F.lit("")))
        narrow = t.join(node.filter(F.col("shapes") > max_children).select("host", "prefix").withColumn("wide", F.lit(True)), ["host", "prefix"], "left").filter(F.col("wide").isNull() | (F.size("seg") <= level))
        out = narrow.select("host", "shape", "k", "good", rest.alias("template"))
        done = out if done is None else done.unionByName(out)
        wide = written(wide, "wide")
        if wide.isEmpty():
            return written(done, "templates")
        s = F.col("seg")[level]
        child = wide.groupBy("host", "prefix", s.alias("s")).agg(F.sum("n").alias("n"))
        parent = child.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all"))
        rare = child.join(parent, ["host", "prefix"]).filter((F.col("children") > max_children) & (10 * F.col("n") < F.col("all"))).select("host", "prefix", "s", F.lit("*").alias("to"))
        t = wide.withColumn("s", s).join(rare, ["host", "prefix", "s"], "left").withColumn("prefix", F.concat("prefix", F.lit("/"), F.coalesce("to", "s"))).drop("s", "to")
        level += 1
        t = written(t, "templates")


def branches(by_template: DataFrame, *, merge_z: float, max_depth: int = 32) -> DataFrame:
    """(host, template, branch): templates merged bottom-up.

    At each node a child whose rate of label 1 differs from that of its siblings
    together (two-proportion z of ``merge_z`` or more) is a branch of its own; the
    others merge and stand for the node when that is compared with its own siblings.
    ``by_template``: host, template, k labels, good of them.  A template without labels
    goes with its node.  Levels at which no node has two labelled children decide
    nothing and are passed over; segments from ``max_depth`` on are one.
    """
    t = by_template.withColumn("parts", F.concat(F.array(F.lit("")), segments(F.col("template"), max_depth))).withColumn("branch", F.size("parts")).withColumn("apart", F.lit(False))
    at = lambda n: F.array_join(F.slice("parts", 1, n), "/")  # noqa: E731  the node of n parts that a template lies under
    labelled = t.filter("k > 0")
    forks = labelled.select("host", "parts", F.explode(F.sequence(F.lit(2), F.greatest(F.col("branch"), F.lit(2)))).alias("level")).select("host", "level", at(F.col("level") - 1).alias("parent"), F.element_at("parts", F.least("level", F.size("parts"))).alias("child")).distinct()
    forked = {r[0] for r in forks.groupBy("host", "level", "parent").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("level").distinct().collect()}  # numbers up to the depth of the tree
    climbed = lambda level: F.when(F.col("apart"), F.col("branch")).otherwise(F.least("branch", F.lit(level)))
    for level in sorted(forked, reverse=True):
        t = t.withColumn("branch", climbed(level))
        here = ~F.col("apart") & (F.col("branch") == level)
        node = t.filter(here).groupBy("host", at(F.lit(level)).alias("node"), at(F.lit(level - 1)).alias("parent")).agg(F.sum("k").alias("k"), F.sum("good").alias("good"))
        whole = node.groupBy("host", "parent").agg(F.sum("k").alias("k0"), F.sum("good").alias("good0"))
        n = node.join(whole, ["host", "parent"]).withColumn("k0", F.col("k0") - F.col("k")).withColumn("good0", F.col("good0") - F.col("good"))
        pooled = F.try_divide(F.col("good") + F.col("good0"), F.col("k") + F.col("k0"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("k")) + F.try_divide(F.lit(1.0), F.col("k0"))))
        z = F.abs(F.try_divide(F.try_divide("good", "k") - F.try_divide("good0", "k0"), spread))
        differs = n.filter(F.coalesce(z, F.lit(0.0)) >= merge_z).select("host", "node", F.lit(True).alias("differs"))
        t = t.withColumn("here", here).withColumn("node", at(F.lit(level))).join(differs, ["host", "node"], "left")
        apart = F.col("here") & F.coalesce("differs", F.lit(False))
        t = t.select("host", "template", "k", "good", "parts", F.when(F.col("here") & ~apart, level - 1).otherwise(F.col("branch")).alias("branch"), (F.col("apart") | apart).alias("apart"))
        t = written(t, "branches")
    return t.select("host", "template", at(climbed(1)).alias("branch"))


def url_verdicts(urls: DataFrame, labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", rules: list[tuple[str, str, str]] = (), max_children: int = 12, max_depth: int = 32, merge_z: float = 1.96, prior_weight: float = 10.0, min_purity: float = 0.6) -> DataFrame:
    """allow or block for every URL.

    The longest fitting rule decides.  Elsewhere the URL's path template does: per
    host, digit and hexadecimal segments and, where a node has many children, the
    rarer ones become wildcards; similar branches are merged (see ``branches``) by the
    labels of one half of the labelled URLs; a branch is rejected if the rate of label
    1 in the other half, smoothed towards the overall rate by ``prior_weight`` labels,
    is under ``min_purity``.  ``labelled`` has ``url_col`` and a 0/1 ``label_col`` (null:
    no label); repeated rows count each; a URL's half is by its hash.

    Adds host, path, template, rule and verdict.  Null URLs and such without ``://``:
    host and path empty, template empty, judged like a host of that name.  URLs of any
    length are taken whole; of more than ``max_depth`` path segments the last are one.  With no labels all is allowed that no rule blocks.
    Input columns named like these outputs are replaced.
    """
    host, path = host_and_path(F.col(url_col))
    urls = dropped(urls, OUTPUTS)
    pages = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"), shaped(path).alias("shape"))
    marks = labelled.select(host.alias("host"), shaped(path).alias("shape"), F.col(label_col).cast("double").alias("y"), (F.pmod(F.xxhash64(url_col), F.lit(2)) == 1).alias("judges")).filter(F.col("y").isNotNull())
    per_shape = marks.filter("not judges").groupBy("host", "shape").agg(F.count("*").alias("k"), F.sum("y").alias("good"))
    held = marks.filter("judges").groupBy("host", "shape").agg(F.count("*").alias("k"), F.sum("y").alias("good"))
    shapes = pages.groupBy("host", "shape").agg(F.count("*").alias("n")).join(per_shape, ["host", "shape"], "left").fillna(0, ["k", "good"])
    t = templates(written(shapes, "shapes"), max_children=max_children, max_depth=max_depth)
    by_template = t.groupBy("host", "template").agg(F.sum("k").alias("k"), F.sum("good").alias("good"))
    tree = branches(written(by_template, "by-template"), merge_z=merge_z, max_depth=max_depth)
    overall = marks.agg(F.coalesce(F.avg("y"), F.lit(1.0)).alias("p")).first()["p"]
    purity = (F.sum("good") + prior_weight * overall) / (F.sum("k") + prior_weight)
    judges = t.select("host", "shape", "template").join(held, ["host", "shape"]).join(tree, ["host", "template"])
    by_branch = judges.groupBy("host", "branch").agg(F.when((purity < min_purity) & (F.sum("k") > 0), "block").otherwise("allow").alias("own"))
    judged = t.select("host", "shape", "template").join(tree.join(by_branch, ["host", "branch"], "left"), ["host", "template"]).select("host", "shape", "template", "own")
    rule, verdict = ruled(F.col("host"), F.col("path"), list(rules))
    out = pages.join(written(judged, "judged"), ["host", "shape"], "left")
    return out.select("row.*", "host", "path", "template", rule.alias("rule"), F.coalesce(verdict, F.col("own"), F.lit("allow")).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; a page's label is the quality of the document that its path's last number names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = host_and_path(F.col("url"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    labelled = pages.withColumn("doc_id", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("bigint")).join(labels, "doc_id").select("url", "label")
    return url_verdicts(pages, labelled, rules=RULES).select("page_id", "host", "path", "rule", "verdict", "template")
