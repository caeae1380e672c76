"""Shards by a hierarchical weighted hash tree; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, free_name, table, written

OUTPUTS = ["shard", "slot"]


@dataclass(frozen=True)
class Node:
    """A region or rack (with children) or a shard (with its number)."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def tree(n_shards: int, *, shards_per_rack: int = 4, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Regions of racks of shards, filled in order; an inner node weighs what its shards weigh."""
    leaves = [Node(f"shard{i}", (weights or {}).get(i, 1.0), shard=i) for i in range(n_shards)]

    def over(nodes: list[Node], fan: int, kind: str) -> list[Node]:
        groups = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        return [Node(f"{kind}{k}", sum(n.weight for n in g), tuple(g)) for k, g in enumerate(groups)]

    regions = over(over(leaves, shards_per_rack, "rack"), racks_per_region, "region")
    return Node("all", sum(n.weight for n in regions), tuple(regions))


def descended(node: Node, key: Column) -> Column:
    """The shard a key falls to: at each level the child with the least -ln(u) / weight, u drawn by hash of child and key.

    The tree is three constant arrays (of each node its children's names, weights and
    numbers) and the descent a fold over its levels, so the expression is the same for
    every tree, however many shards it has.
    """
    nodes, at = [node], 0
    below: list[list[int]] = []
    while at < len(nodes):
        children = nodes[at].children
        below.append(list(range(len(nodes), len(nodes) + len(children))))
        nodes += children
        at += 1
    depth, level = 0, [node]
    while any(n.children for n in level):
        depth, level = depth + 1, [c for n in level for c in n.children]

    def arrays(values, one, kind: str) -> Column:
        return F.expr("array(" + ", ".join(f"cast(array({', '.join(map(one, v))}) as array<{kind}>)" for v in values) + ")")

    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = arrays([[c.name for c in n.children] for n in nodes], quoted, "string")
    weights = arrays([[c.weight for c in n.children] for n in nodes], lambda x: f"{x!r}D", "double")
    numbers = arrays(below, str, "int")

    def step(n: Column, _: Column) -> Column:
        draw = lambda name, i: F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(name, key), 11) + 1) / float(1 << 53)) / weights[n][i]).alias("d"), i.alias("i"))
        return F.when(F.size(numbers[n]) == 0, n).otherwise(numbers[n][F.array_min(F.transform(names[n], draw))["i"]])

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)
    return F.expr("array(" + ", ".join(str(n.shard) for n in nodes) + ")")[leaf]


def slotted(df: DataFrame, *, by: str, order: list[str], rows_per_chunk: int = 200_000) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each value of ``by``.

    Rows are numbered within chunks of about ``rows_per_chunk`` rows (a hash of
    ``order`` and of the row's place, so that equal rows are spread too), and each chunk starts where the chunks before it end, so no task
    holds a whole shard.
    """
    n_chunks = max(8, -(-df.count() // rows_per_chunk))
    chunk, place, start = (free_name(df, n) for n in ("_chunk", "_i", "_start"))
    # the row's own number parts rows that are equal in all of ``order``
    df = df.withColumn(chunk, F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(n_chunks)))
    df = written(df, "chunks")
    sizes = df.groupBy(F.col(by).alias("by"), F.col(chunk).alias("c")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("by").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("by", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)).alias("s")
    numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(by, chunk).orderBy(*order))).alias("r")
    joined = numbered.join(starts, F.col(f"r.{by}").eqNullSafe(F.col("s.by")) & (F.col(f"r.{chunk}") == F.col("s.c")))
    return joined.select("r.*", (F.col(f"s.{start}") + F.col(f"r.{place}") - 1).alias("slot")).drop(place, chunk)


def sharded(rows: DataFrame, nodes: Node, *, key_col: str = "doc_id", grown: Node | None = None) -> DataFrame:
    """Adds shard and slot (gapless from 0 in a shard) and, with ``grown``, grown_shard.

    Only the key and the tree decide.  If one subtree's weight changes, a key moves
    into it, out of it or within it; elsewhere none moves.  A shard that starts a
    region of its own takes keys only into itself; one added to an open rack draws
    them into that rack.  Rows of equal or null keys share a shard; their order in
    it is by the row's hash.  Input columns named like these outputs are replaced.
    """
    rows = dropped(rows, [*OUTPUTS, "grown_shard"])
    put = rows.withColumn("shard", descended(nodes, F.col(key_col)).cast("int"))
    if grown:
        put = put.withColumn("grown_shard", descended(grown, F.col(key_col)).cast("int"))
    return slotted(put, by="shard", order=[key_col, *[c for c, t in rows.dtypes if c != key_col and t in ("string", "bigint", "int")]])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by doc_id; grown_shard has one more, which opens a region and takes rows only into itself."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharded(rows, tree(16), grown=tree(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
