"""Near duplicates by an exact Jaccard join of word shingles under several token orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.storage import discard
from sessionloom.llm.common import released, small_batches, table, written
from sessionloom.llm.textvec import Hasher, Texts, mixed, slices
from sessionloom.operators.graph import components

CELL_BITS = 22  # of a shingle's hash: its counter
SLICES = 64  # of the counters, each summed apart
HOT = 128  # classes from here on: cells that hold more than so many times the mean cell
ORDERS = 3
PART = 1 << 18  # bytes of text whose words are hashed at a time: a few dozen bytes of memory each


def shingle_sets(texts: list[bytes], hasher: Hasher, k: int) -> list:
    """Per text the sorted distinct 64-bit hashes of its runs of ``k`` words; of fewer words, one hash of them all."""
    import numpy as np

    t = Texts(texts, lower=True)
    w = hasher.ranges(hasher.sums(t.data), t.start, t.stop)
    powers = [pow(0xC2B2AE3D27D4EB4F, i, 1 << 64) for i in range(k)]
    n = max(len(w) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i, p in enumerate(powers):
        h += w[i : i + n] * np.uint64(p)
    h = mixed(h)
    out = []
    for first, m in zip(t.first.tolist(), t.n_words.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(h[first : first + m - k + 1]))
        elif m:
            whole = sum(int(x) * powers[i] for i, x in enumerate(w[first : first + m].tolist())) + m
            out.append(mixed(np.array([whole & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefixes(n: int, percent: int) -> tuple[int, int]:
    """How many first tokens of a set of ``n`` any set as large or smaller must meet, and any as large or larger."""
    probe = n - -(-percent * n // 100) + 1
    index = n - -(-2 * percent * n // (100 + percent)) + 1
    return probe, index


def ordered(s, classes, order: int, n: int):
    """The first ``n`` tokens of a set in a global order: rare classes first, then by a hash of the order's own."""
    import numpy as np

    seed = np.uint64((order + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return s[np.lexsort((mixed(s ^ seed), classes[s >> np.uint64(64 - CELL_BITS)]))[:n]]


def frequency_classes(docs: DataFrame, text_col: str, k: int):
    """A class for each of 2**22 hash cells: 0 for cells of usual weight, more for those that frequent shingles weigh down.

    Classes below ``HOT`` hold at most ``HOT`` times the mean cell and one, a 32 768th of
    all shingles: no token of theirs is a larger group.  Counts every document's distinct shingles; the counters have a fixed size, are
    summed by Spark in slices and reach the driver as 16 MB; 4 MB are broadcast.
    """
    import numpy as np

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hasher, total = Hasher(), np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for _, part in slices((t.as_py() for t in batch.column(0)), PART):
                np.add.at(total, (np.concatenate(shingle_sets(part, hasher, k)) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        if total.any():
            shrink = zstandard.ZstdCompressor(level=1).compress
            for i, c in enumerate(np.split(total, SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([shrink(c.astype("<u4").tobytes())], pa.binary())], names=["cell", "counts"])
        del total
        released()

    def add(t: pa.Table) -> pa.Table:
        import zstandard

        open_, total = zstandard.ZstdDecompressor().decompress, np.zeros((1 << CELL_BITS) // SLICES, np.uint64)
        for b in t.column("counts"):
            total += np.frombuffer(open_(b.as_py()), "<u4")
        most = np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()], pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(most)], pa.binary())})

    import zstandard

    schema = "cell int, counts binary"
    sliced = docs.select(text_col).mapInArrow(count, schema)
    # in two steps, so that no group has more than a few slices
    part = sliced.withColumn("g", F.spark_partition_id() % 32).groupBy("cell", "g").applyInArrow(add, schema)
    total = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.uint32)
    for cell, counts in part.groupBy("cell").applyInArrow(add, schema).collect():
        total[cell] = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "<u4")
    total = total.ravel()
    mean = float(np.median(total)) + 1
    over = np.maximum(total - mean, 0) / (3 * np.sqrt(mean))
    weight = np.where(over < 1, 0, np.ceil(np.log2(over + 1))).astype(np.uint8)
    return weight + np.where(total > HOT * (total.mean() + 1), HOT, 0).astype(np.uint8)


def maybe_in(column: str, of: DataFrame):
    """A filter on ``column``: false only for values that are not in ``of``'s column of that name.

    A bit for each of 2**23 hash cells, whatever the size of ``of``: at most 131 072
    numbers reach the driver and are broadcast.  What passes is joined afterwards;
    the filter only spares rows the shuffle.
    """
    import numpy as np

    cell = F.pmod(F.xxhash64(column), F.lit(1 << 23))
    words = of.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(c & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << 17, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = of.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(c: pa.Array) -> pa.Array:
        at = c.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return maybe(cell)


def sketch(s, cells: int = 2) -> bytes:
    """A bit for each token in a power of two of cells, ``cells`` to twice as many a token."""
    import numpy as np

    m = 1 << max(6, int(cells * len(s) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[((s >> np.uint64(4)) & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Members:
    """Rows of candidate groups, in order of their group, and which pairs of them may link.

    Columns: ``own`` (the row's block), ``low`` (of the group's lower size band),
    ``lists`` (per further order the groups that the row is in, 16 bits of each: they
    can only let a pair pass that the sketches then judge) and ``sketch``; for
    ``links`` in place of these two ``tokens`` (the row's whole set).
    """

    def __init__(self, batch: pa.RecordBatch, percent: int):
        import numpy as np

        self.percent = percent
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.row, self.n, self.comp, self.own, self.low = (column(c) for c in ("row", "n", "comp", "own", "low"))
        self.diagonal = column("bi") == column("bj")
        keys = [column(c) for c in ("g", "bi", "bj")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        self.first, self.g = np.flatnonzero(new), keys[0]
        self.size = np.diff(np.append(self.first, batch.num_rows))
        self.lists = []
        if "tokens" in batch.schema.names:
            self.sets = self._flat(batch.column("tokens"), np.uint64)
            return
        for o in range(ORDERS - 1):
            flat, at = self._flat(batch.column(f"in_{o}"), np.int64)
            flat = np.unique(flat, return_inverse=True)[1]
            keys = np.repeat(np.arange(batch.num_rows), np.diff(at)) * (int(flat.max(initial=0)) + 1) + flat
            self.lists.append((np.sort(keys), flat, at))
        self.sketches = self._flat(batch.column("sketch"), np.uint64)

    @staticmethod
    def _flat(c: pa.Array, kind):
        import numpy as np

        if pa.types.is_binary(c.type):
            raw = c.to_pylist()
            return np.frombuffer(b"".join(raw), kind), np.cumsum([0, *(len(b) // 8 for b in raw)])
        return c.flatten().to_numpy().astype(kind), c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py()

    def pairs(self):
        """(a, b): places of the pairs of each group that size, band, block and component allow; about 2**18 at a time."""
        import numpy as np

        cost = np.cumsum(self.size.astype(np.int64) ** 2)
        cuts = np.searchsorted(cost, np.arange(1 << 18, cost[-1] + (1 << 18), 1 << 18), "left") + 1
        for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            first, size = self.first[lo:hi], self.size[lo:hi].astype(np.int64)
            if not len(size):
                continue
            each = np.repeat(size, size)  # partners of each member
            a = np.repeat(np.repeat(first, size) + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size), each)
            b = np.repeat(np.repeat(first, size), each) + np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
            a, b = (x[a < b] for x in (a, b))
            small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
            ok = (self.comp[a] != self.comp[b]) & (100 * small >= self.percent * large) & (self.low[a] | self.low[b]) & (self.diagonal[a] | (self.own[a] != self.own[b]))
            yield a[ok], b[ok]

    def meet(self, keys, flat, at, a, b):
        """Whether the lists of a and b share an entry; ``keys``: (row, entry) of all, sorted, as one number each."""
        import numpy as np

        size, out = at[a + 1] - at[a], np.zeros(len(a), bool)
        ends = np.cumsum(size)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(1 << 19, int(ends[-1]) if len(a) else 0, 1 << 19)), len(a)))
        for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            n = size[lo:hi]
            which = np.repeat(np.arange(lo, hi), n)
            mine = flat[np.repeat(at[a[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            want = b[which] * (int(flat.max()) + 1) + mine
            out[which[keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want]] = True
        return out

    def bound(self, a, b, words, starts):
        """Most tokens that a and b can share: a token whose cell the other has not set is not in it."""
        import numpy as np

        out = np.empty(len(a), np.int64)
        width = np.diff(starts)
        for w in np.unique(np.minimum(width[a], width[b])).tolist():
            of = np.flatnonzero(np.minimum(width[a], width[b]) == w)
            step = max(1, (1 << 18) // w)
            for at in range(0, len(of), step):
                p = of[at : at + step]
                x, y = (self._cells(r[p], w, width, words, starts) for r in (a, b))
                only_a, only_b = (np.bitwise_count(c).sum(1, dtype=np.int64) for c in (x & ~y, y & ~x))
                out[p] = np.minimum(self.n[a[p]] - only_a, self.n[b[p]] - only_b)
        return out

    @staticmethod
    def _cells(r, w: int, width, words, starts):
        """Sketches of rows r, wider ones folded to w words."""
        import numpy as np

        out = words[starts[r][:, None] + np.arange(w)]
        for k in range(1, int(width[r].max()) // w):
            wide = np.flatnonzero(width[r] > k * w)
            out[wide] |= words[starts[r[wide]][:, None] + k * w + np.arange(w)]
        return out

    def similar(self, a, b, sketches):
        """(a, b, share): those pairs that the sketches allow, and the most that each can share."""
        common = self.bound(a, b, *sketches)
        total = self.n[a] + self.n[b] - common
        ok = 100 * common >= self.percent * total
        return a[ok], b[ok], common[ok] / total[ok]

    def passing(self):
        """(a, b, share): the pairs that lists and sketches allow."""
        for a, b in self.pairs():
            for each in self.lists:
                ok = self.meet(*each, a, b)
                a, b = a[ok], b[ok]
            yield self.similar(a, b, self.sketches)

    def open(self):
        """The rows that a pair may link: at most all of the batch."""
        import numpy as np

        there = np.zeros(len(self.row), bool)
        for a, b, _ in self.passing():
            there[a] = there[b] = True
        return there

    def links(self):
        """(a, b): rows of links that join components; of all links of the batch a spanning forest, so fewer than it has rows.

        Pairs are judged by sketches as before, by others eight times as wide and by
        the whole sets.  A pair whose components are joined already needs no judging.
        """
        import numpy as np

        tokens, at = self.sets
        each = lambda r: tokens[at[r] : at[r + 1]]
        comp = np.unique(self.comp, return_inverse=True)[1]
        root = np.arange(len(self.comp))  # of each component
        sketches = []
        for cells in (2, 16):
            bits = [sketch(each(r), cells) for r in range(len(self.row))]
            sketches.append((np.frombuffer(b"".join(bits), np.uint64), np.cumsum([0, *(len(x) // 8 for x in bits)])))
        for a, b in self.pairs():
            apart = root[comp[a]] != root[comp[b]]
            a, b = a[apart], b[apart]
            for s in sketches:
                a, b, share = self.similar(a, b, s)
            out = []
            for i in np.argsort(-share, kind="stable").tolist():
                x, y = int(a[i]), int(b[i])
                one, two = root[comp[x]], root[comp[y]]
                if one == two:
                    continue
                common = len(np.intersect1d(each(x), each(y), assume_unique=True))
                if 100 * common >= self.percent * (int(self.n[x]) + int(self.n[y]) - common):
                    root[root == two] = one
                    out.append((self.row[x], self.row[y]))
            if out:
                yield np.sort(np.array(out, np.int64), axis=1)

    def candidates(self):
        """(a, b, open): of the pairs that the sketches allow each member's best with an earlier one, and its best of all.

        ``open``: groups of which more pairs pass than are given.
        """
        import numpy as np

        for a, b, share in self.passing():
            more = np.empty(0, np.int64)
            if len(a):
                one, two = np.concatenate([b, a]), np.concatenate([a, b])
                pick = []
                for own, other, s in ((b, a, share), (one, two, np.concatenate([share, share]))):
                    order = np.lexsort((self.row[other], -s, own))
                    pick.append((own[order], other[order], np.append(True, np.diff(own[order]) != 0)))
                every = np.minimum(a, b) * len(self.row) + np.maximum(a, b)
                of = self.g[a]
                a, b = (np.concatenate([p[i][p[2]] for p in pick]) for i in (1, 0))
                more = np.unique(of[~np.isin(every, np.minimum(a, b) * len(self.row) + np.maximum(a, b))])
            x, y = self.row[a], self.row[b]
            if len(x):
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield both[0], both[1], more


@small_batches
def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """(id, n_shingles, component_id) of every row: components of the links with 100 * intersection >= percent * union.

    Words: runs without ASCII white space, A-Z folded; a set: the distinct runs of
    ``k`` words, or the whole text of fewer words.  Null and empty texts have the
    empty set and link with nothing.  ``component_id`` is the least id reachable.
    Ids name documents: rows with one id are one node with the links of each.  A null
    id has its count but no component.  Other columns are left out.

    Exact.  Equal sets are one from the start.  Under each of three global token
    orders (frequent shingles last, then by the order's own hash) linked sets must
    share a token of the smaller's index prefix and the larger's probe prefix.  Rows
    that share one, and of a similar size, are a group; groups of the same members
    are one.  Only rows that are in groups of every order stay, and a pair is a
    candidate only if it meets in all three and the sketches of both sets, two to
    four bits a token, allow the similarity.  No text moves before that.

    Groups of more than ``block`` rows are split.  First each row's best partners
    in its block are verified; then, in split groups and those where more pairs passed,
    all pairs of different components, the largest component of a group against the
    others only.  Of these pairs the sketches give the rows that any may link, then the
    whole sets the links that join components.  So no step gives pairs by the square of
    a group: at most two for each member, or a row for each member and block that it is
    held against.  None is capped.
    """
    import numpy as np

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(source, "text", k))
    kind = source.schema["id"].dataType.simpleString()

    @F.arrow_udf("n long, h binary, sketch binary, " + ", ".join(f"tokens_{o} array<long>, cold_{o} int" for o in range(ORDERS)))
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        hasher, cls = Hasher(), classes.value
        none = np.empty(0, np.int64)
        for batch in batches:
            n, h, bits, tokens, cold = [], [], [], [[] for _ in range(ORDERS)], [[] for _ in range(ORDERS)]
            for _, part in slices((t.as_py() for t in batch), PART):
                for s in shingle_sets(part, hasher, k):
                    n.append(len(s))
                    h.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bits.append(sketch(s))
                    for o in range(ORDERS):
                        first = ordered(s, cls, o, prefixes(len(s), percent)[0]) if len(s) else s
                        tokens[o].append((first & ~np.uint64(0xFFFF)).view(np.int64))
                        cold[o].append(int((cls[first >> np.uint64(64 - CELL_BITS)] < HOT).sum()))
            lists, names = [pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(bits, pa.binary())], ["n", "h", "sketch"]
            for o, (t, c) in enumerate(zip(tokens, cold, strict=True)):
                lists += [pa.ListArray.from_arrays(np.cumsum([0, *map(len, t)]).astype(np.int32), pa.array(np.concatenate([none, *t]))), pa.array(c, pa.int32())]
                names += [f"tokens_{o}", f"cold_{o}"]
            yield pa.StructArray.from_arrays(lists, names=names)
            del n, h, bits, tokens, cold, lists
            released()

    @F.arrow_udf("binary")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        hasher = Hasher()
        for batch in batches:
            yield pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for _, part in slices((t.as_py() for t in batch), PART) for s in shingle_sets(part, hasher, k)], pa.binary())
            released()

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hasher = Hasher()

        def similar(x, y) -> bool:
            common = len(x) + len(y) - len(np.union1d(x, y))
            return 100 * common >= percent * (len(x) + len(y) - common)

        for a, b in batches:
            out = []
            for at in range(0, len(a), 200):
                left, right = a[at : at + 200].to_pylist(), b[at : at + 200].to_pylist()
                texts, sets = list(dict.fromkeys([*left, *right])), {}
                for first, part in slices(texts, PART):
                    sets.update(zip(texts[first : first + len(part)], shingle_sets(part, hasher, k), strict=True))
                out += [similar(sets[x], sets[y]) for x, y in zip(left, right, strict=True)]
            yield pa.array(out, pa.bool_())
            released()

    @F.arrow_udf("binary")
    def set_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """The set of a text as bytes; null if it is not the one of that digest."""
        import hashlib

        hasher = Hasher()
        for texts, digests in batches:
            sets = [s.tobytes() for _, part in slices((t.as_py() for t in texts), PART) for s in shingle_sets(part, hasher, k)]
            yield pa.array([s if hashlib.blake2b(s, digest_size=16).digest() == h else None for s, h in zip(sets, digests.to_pylist(), strict=True)], pa.binary())
            released()

    sig = written(source.withColumn("s", signature("text")).select(F.monotonically_increasing_id().alias("row"), "id", "s.*"), "signatures")
    known = sig.filter("id is not null and n > 0")
    # rows of one set, and rows of one id: all but the first hang on it
    again = known.groupBy("h").agg(F.min("row").alias("rep"), F.count("*").alias("m")).filter("m > 1").drop("m")
    equal = written(known.select("row", "h").join(written(again, "sets"), "h").filter("row != rep").select("row", "rep"), "equal")
    named = known.groupBy("id").agg(F.min("row").alias("rep"), F.count("*").alias("m")).filter("m > 1").drop("m")
    same_id = written(known.select("row", "id").join(named, "id").filter("row != rep").select("row", "rep"), "ids")
    fixed = equal.union(same_id).select(F.col("rep").alias("a"), F.col("row").alias("b"))
    maybe = maybe_in("row", equal)
    reps = known.filter(~maybe).union(known.filter(maybe).join(equal.select("row"), "row", "left_anti").select(known.columns))

    def groups(order: int, of: DataFrame) -> DataFrame:
        """(g, row, low): rows of ``of`` that share a prefix token of the order, by size band; groups of the same members are one.

        Tokens are shuffled once and grouped where they arrive: the cells' counts bound
        each group.  Those of hot cells are counted map-side and joined with the counts.
        """
        n_index = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
        # linked sets are of one band or of two that touch; a group: one band, and the next above it
        band = F.floor(F.log("n") / (np.log(100 / percent) * 1.001)).cast("int")
        t, cold, low = F.col(f"tokens_{order}"), F.col(f"cold_{order}"), F.explode(F.array(F.lit(True), F.lit(False)))

        def tokens(some, before) -> DataFrame:
            """A row a token: its first 48 bits, and ``at``: the row and in the last 8 bits twice its band, and one if it is in the index prefix.

            Tokens that differ in the other bits alone are of one cell, so the cells' bound holds for them together.
            """
            each = of.select("row", band.alias("band"), (n_index - before).alias("k"), F.posexplode(some).alias("pos", "t"))
            place = 2 * F.col("band") + (F.col("pos") < F.col("k")).cast("int")
            return each.select(F.shiftright("t", 16).alias("t"), F.shiftleft("row", 8).bitwiseOR(place.cast("long")).alias("at"))

        def twice(rows: DataFrame) -> DataFrame:
            place = F.col("at").bitwiseAND(F.lit(255))
            both = rows.select("t", F.shiftright("at", 8).alias("row"), F.shiftright(place, 1).cast("int").alias("band"), (place % 2 == 1).alias("is_index"), low.alias("low"))
            return both.withColumn("band", F.when(F.col("low"), F.col("band")).otherwise(F.col("band") - 1))

        facts = {"c": F.count("*"), "i": F.max(F.col("low") & F.col("is_index"))} | {f"x{x}": F.bit_xor(F.xxhash64(F.lit(x), "row", "low")) for x in (0, 1)}
        met, g = F.expr("c > 1 and i"), F.xxhash64("x0", "x1", "c").alias("g")
        here = Window.partitionBy("t", "band")
        usual = twice(tokens(F.slice(t, F.lit(1), cold), F.lit(0)).repartition("t")).select("row", "low", *[f.over(here).alias(name) for name, f in facts.items()])
        frequent = twice(tokens(F.slice(t, cold + 1, F.size(t)), cold))
        counted = frequent.groupBy("t", "band").agg(*[f.alias(name) for name, f in facts.items()]).filter(met).select("t", "band", g)
        return written(usual.filter(met).select(g, "row", "low").union(frequent.join(counted, ["t", "band"]).select("g", "row", "low")).distinct(), "groups")

    grouped, left = [], reps
    for order in range(ORDERS):
        grouped.append(groups(order, left))
        # rows that the bitmap lets pass without need are in no group of another order, or fall out below
        left = left.filter(maybe_in("row", grouped[-1]))
    staying = grouped[0].select("row")
    for other in grouped[1:]:
        staying = staying.join(other.select("row").distinct(), "row", "left_semi")
    staying = written(staying.distinct(), "staying")
    # of the last order's groups what stays, again one of those of the same members
    facts = [F.bit_xor(F.xxhash64(F.lit(x), "row", "low")).alias(f"x{x}") for x in (0, 1)]
    stays = written(grouped[-1].join(staying, "row", "left_semi"), "stays")
    alike = stays.groupBy("g").agg(F.count("*").alias("c"), F.max("low").alias("i"), *facts).filter("c > 1 and i").select("g", F.xxhash64("x0", "x1", "c").alias("of"))
    member_of = written(stays.join(alike, "g").select(F.col("of").alias("g"), "row", "low").distinct(), "members")
    lists = written(member_of.select("row").distinct(), "compared")
    discard(stays)
    needed = maybe_in("row", lists)
    for order in range(ORDERS - 1):
        own = grouped[order].filter(needed).groupBy("row").agg(F.collect_set((F.pmod("g", F.lit(1 << 16)) - (1 << 15)).cast("short")).alias(f"in_{order}"))
        lists = lists.join(own, "row")
    bodies = written(lists.join(known.filter(needed).select("row", "n", "sketch"), "row"), "bodies")
    rows = written(sig.select("row", "id", "n", "h"), "rows")
    discard(*grouped, staying, sig)
    known = rows.filter("id is not null and n > 0")

    def by_group(members: DataFrame, judge, schema: str) -> DataFrame:
        """``judge`` of the members (g, row, low, comp, n, the blocks own, bi and bj, and the rest that ``Members`` names) where a group meets."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if held is not None:
                    batch = pa.concat_batches([held, batch])
                key = [batch.column(c).to_numpy() for c in ("g", "bi", "bj")]
                last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in key]))  # the last group may go on
                cut = int(last[-1]) + 1 if len(last) else 0
                held = batch.slice(cut)
                if cut:
                    yield from judge(batch.slice(0, cut))
            if held is not None:
                yield from judge(held)
            released()

        return members.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj").mapInArrow(compare, schema)

    def once(members: DataFrame) -> DataFrame:
        """Of blocks with the same members, on the same sides, one: near copies meet in many groups, and each would get their sets."""
        block = ["g", "bi", "bj"]
        sides = members.withColumn("own", F.when(F.col("bi") == F.col("bj"), zero).otherwise((F.col("own") == F.col("bj")).cast("long")))
        sides = written(sides.withColumn("across", (F.col("bi") != F.col("bj")).cast("long")), "sides")
        facts = [F.bit_xor(F.xxhash64(F.lit(x), "row", "low", "own", "across")).alias(f"x{x}") for x in (0, 1)]
        alike = sides.groupBy(*block).agg(F.count("*").alias("c"), *facts).filter("c > 1").select(*block, F.xxhash64("x0", "x1", "c").alias("of"))
        named = sides.join(alike, block).select(F.col("of").alias("g"), "row", "low", "comp", "own", zero.alias("bi"), F.col("across").alias("bj"), "n")
        return named.distinct()

    def best(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) of rows, and the groups (g) of which more pass."""
        for a, b, more in Members(batch, percent).candidates():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "g"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more, pa.int64())], names=["a", "b", "g"])

    def may_link(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.select(["g", "row", "low", "comp", "own", "bi", "bj", "n"]).filter(pa.array(Members(batch, percent).open()))

    def joining(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for links in Members(batch, percent).links():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in links.T], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs of rows; only now their texts are fetched."""
        wanted = written(known.join(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "row", "left_semi").select("row", "id", "h"), "wanted")
        texts = source.filter(maybe_in("id", wanted)).join(wanted, "id").filter(digest("text") == F.col("h")).groupBy("row").agg(F.first("text").alias("text"))
        texts = written(texts, "texts")
        both = pairs
        for c in "ab":
            both = both.join(texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}")), c)
        out = written(both.filter(linked("text_a", "text_b")).select("a", "b"), "links")
        discard(wanted, texts)
        return out

    salted = lambda parts: F.pmod(F.xxhash64(F.lit(7), "row"), parts)
    zero = F.lit(0).cast("long")
    size = member_of.groupBy("g").agg(F.count("*").alias("c"))
    parts = F.greatest(F.ceil(F.col("c") / block), F.lit(1)).cast("long")
    first = member_of.join(written(size.filter("c > 1"), "sizes"), "g").withColumn("own", salted(parts))
    first = first.select("g", "row", "low", F.col("row").alias("comp"), "own", F.col("own").alias("bi"), F.col("own").alias("bj"))
    both = written(by_group(first.join(bodies, "row"), best, "a long, b long, g long").distinct(), "candidates")
    unfinished = both.filter("g is not null").select("g")
    links = fixed.union(verified(both.filter("g is null").select("a", "b")))
    found = components(links)

    # what is left: pairs of different components
    named_rows = written(member_of.join(found.withColumnRenamed("id", "row"), "row", "left").withColumn("comp", F.coalesce("component", "row")).drop("component"), "members")
    by_comp = named_rows.groupBy("g", "comp").agg(F.count("*").alias("m"))
    top = written(by_comp.groupBy("g").agg(F.sum("m").alias("c"), F.max(F.struct("m", "comp")).alias("top")).filter("c > top.m").select("g", "c", F.col("top.m").alias("m"), F.col("top.comp").alias("most")).join(unfinished.withColumn("u", F.lit(True)), "g", "left").filter(F.col("u") | (F.col("c") > block)).drop("u"), "top")
    rest, large = F.ceil((F.col("c") - F.col("m")) / block).cast("long"), F.ceil(F.col("m") / block).cast("long")
    split, is_top = F.col("c") > block, F.col("comp") == F.col("most")
    own = F.when(~split, zero).when(is_top, rest + salted(large)).otherwise(salted(rest))
    others = F.when(~split, F.array(zero)).when(is_top, F.sequence(zero, rest - 1)).otherwise(F.sequence(zero, rest + large - 1))
    second = named_rows.join(top, "g").withColumn("own", own).withColumn("other", F.explode(others))
    second = second.select("g", "row", "low", "comp", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    second = written(once(by_group(second.join(bodies, "row"), may_link, "g long, row long, low boolean, comp long, own long, bi long, bj long, n long")), "open")
    wanted = written(known.join(second.select("row").distinct(), "row", "left_semi").select("row", "id", "h"), "wanted")
    sets = source.filter(maybe_in("id", wanted)).join(wanted, "id").select("row", set_of("text", "h").alias("tokens")).filter("tokens is not null").groupBy("row").agg(F.first("tokens").alias("tokens"))
    more = written(by_group(second.join(written(sets, "sets"), "row"), joining, "a long, b long").distinct(), "links")
    if more.limit(1).count():
        found = components(links.union(more))
    nodes = known.select("row", "id").join(found.withColumnRenamed("id", "row"), "row")
    least = nodes.join(nodes.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("row", "component_id")
    out = rows.select("row", "id", "n").join(least, "row", "left").select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    out = written(out, "components")
    discard(bodies, member_of, named_rows, top, rows)
    return out


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that are the least of their component; columns as before."""
    gone = near_duplicates(docs, id_col=id_col, **how).filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(written(gone, "copies"), id_col, "left_anti").select(*docs.columns)


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT id AS doc_id, min(reached) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
