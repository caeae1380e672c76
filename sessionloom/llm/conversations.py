"""Repair of conversations: a cheapest edit of role and fault sequences, shared by a grammar."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.storage import discard
from sessionloom.llm.common import released, table, written

#: What an edit costs, and what an undeleted truncated row adds.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of what has been put out: nothing, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row's symbol: its role's initial (x: another), upper-case if truncated; - if it must go.
SYMBOLS = "suaxSUAX-"
#: Inserted turns that lead from a state to another, at the least cost.
INSERTS = {(p, q): n for p, chain in {START: (START, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}.items() for n, q in enumerate(chain)}
NEVER = 1 << 60
#: Rows and bytes of text in a segment (one row at least), rules a round of the grammar makes, and rounds.
SEGMENT_ROWS, SEGMENT_BYTES, RULES, ROUNDS = 512, 1 << 20, 64, 6
FIRST_RULE = 0x100


class Matrix:
    """Of a run of rows, from state to state: the least cost, and the place of its audit among those from one state.

    Two audits of the same run from the same state at the same cost are never one
    the other's prefix: an audit's letters decide its states and so its cost, and a
    run's audits end with a row's edit.  So the first letter that differs orders them
    whatever is put before or behind, and an audit of a product is ordered by the
    place of its left part, then of its right part; no text is compared.
    ``mid``: the state between both parts of a product, from which audits are unrolled.
    """

    __slots__ = ("cost", "place", "mid", "own")

    def __init__(self, cost, place, mid=None, own=None):
        self.cost, self.place, self.mid, self.own = cost, place, mid, own


def base_matrix(symbol: str) -> Matrix:
    """One row: turns inserted before it, then its edit."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if symbol in "SUAX" else 0
    for (p, m), n in INSERTS.items():
        edits = [(DELETE, "D", m)]
        if symbol != "-":
            edits += [(RE_ROLE + extra, "R", NEXT[m, r]) for r in "ua" if (m, r) in NEXT]
            if (m, symbol.lower()) in NEXT:
                edits.append((extra, "K", NEXT[m, symbol.lower()]))
        for cost, letter, q in edits:
            mine = (cost + n * INSERT, "I" * n + letter)
            found[p, q] = min(found.get((p, q), mine), mine)
    own = [[found.get((p, q), (NEVER, ""))[1] for q in STATES] for p in STATES]
    cost = [[found.get((p, q), (NEVER, ""))[0] for q in STATES] for p in STATES]
    place = [[sorted(own[p]).index(own[p][q]) for q in STATES] for p in STATES]
    return Matrix(cost, place, own=own)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The run of ``a`` and then that of ``b``, over (minimum, plus)."""
    cost, mid = [[NEVER] * 4 for _ in STATES], [[0] * 4 for _ in STATES]
    place = [[0] * 4 for _ in STATES]
    for p in STATES:
        for q in STATES:
            c, _, m = min((a.cost[p][m] + b.cost[m][q], a.place[p][m], m) for m in STATES)
            cost[p][q], mid[p][q] = min(c, NEVER), m
        order = sorted(STATES, key=lambda q: (cost[p][q] >= NEVER, a.place[p][mid[p][q]], b.place[mid[p][q]][q]))
        for n, q in enumerate(order):
            place[p][q] = n
    return Matrix(cost, place, mid)


class Grammar:
    """Rules, each a pair of symbols, and a transfer matrix for every symbol, from the rows' upwards."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.pair = {chr(FIRST_RULE + n): r for n, r in enumerate(rules)}
        self.matrix = {s: base_matrix(s) for s in SYMBOLS}
        for s, (x, y) in self.pair.items():
            self.matrix[s] = product(self.matrix[x], self.matrix[y])

    def packed(self, symbols: str, since: int = 0) -> str:
        """The sequence with the rules from ``since`` on applied in their order."""
        for n, r in enumerate(self.rules[since:], since):
            symbols = symbols.replace(r, chr(FIRST_RULE + n))
        return symbols

    def of(self, top: str) -> tuple[Matrix | None, list[Matrix]]:
        """The matrix of a packed sequence, and those of its prefixes."""
        runs = []
        for s in top:
            runs.append(product(runs[-1], self.matrix[s]) if runs else self.matrix[s])
        return (runs[-1] if runs else None), runs

    def audit(self, top: str, p: int, q: int) -> str:
        """The letters of the best way from p to q, unrolled from the rules' states in between."""
        _, runs = self.of(top)
        todo, out = [], []
        for k in range(len(top) - 1, -1, -1):  # states before each top symbol, from the end
            m = p if k == 0 else runs[k].mid[p][q]
            todo.append((top[k], m, q))
            q = m
        while todo:
            s, a, b = todo.pop()
            if s in self.pair:
                m = self.matrix[s].mid[a][b]
                todo += [(self.pair[s][1], m, b), (self.pair[s][0], a, m)]
            else:
                out.append(self.matrix[s].own[a][b])
        return "".join(out)


def pair_counts(symbols: str) -> Counter:
    """How often each pair of neighbours can be replaced, from the left and without overlap."""
    out, last = Counter(), {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if pair[0] == pair[1] and last.get(pair) == i - 1:
            last.pop(pair)
            continue
        last[pair] = i
        out["".join(pair)] += 1
    return out


def learned_grammar(shapes: DataFrame, *, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over all sequences in ``symbols``, each weighted by ``n``, in ``rounds`` passes of ``rules`` rules.

    Each pass counts the neighbouring pairs of the sequences as packed so far, in
    the tasks and then over all, and makes the most frequent (ties: the lesser) into
    rules; it stops where none is found twice.  The driver gets ``rules`` pairs a pass;
    the grammar has ``rules * rounds`` rules at most, however large the corpus.  It
    decides what is shared, never what comes out.
    """
    made: list[str] = []
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], made=tuple(made)) -> Iterator[pa.RecordBatch]:
            grammar, sums = Grammar(list(made)), Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    for pair, k in pair_counts(grammar.packed(symbols)).items():
                        sums[pair] += k * n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["pair", "n"])

        best = shapes.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect()
        made += [r["pair"] for r in best]
        if not best:
            break
    return Grammar(made)


def faulted(turns: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str, gone=None) -> DataFrame:
    """Equal rows once, with how many there are (n), the role's initial, whether blank or truncated, and whether seen earlier.

    ``gone``: a condition under which a row isn't there; its conversation still is, as a row with n = 0.
    """
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    no = lambda x, kind: F.when(~gone, x).cast(kind)
    rows = turns.select(
        F.col(id_col).alias("_id"), no(F.col(turn_col), "long").alias("_turn"), no(F.coalesce(F.col(role_col), F.lit(" ")), "string").alias("_role"), no(F.coalesce(F.col(text_col), F.lit(" ")), "string").alias("_text"), F.when(gone, 0).otherwise(1).alias("_n")
    )
    rows = rows.groupBy("_id", "_turn", "_role", "_text").agg(F.sum("_n").cast("long").alias("_n"))
    bare = F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.select("*", (bare == "").alias("_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("_open"), F.substring("_role", 1, 1).alias("_first"), F.unhex(F.sha2("_text", 256)).alias("_digest"))
    when = F.struct(F.col("_turn").isNotNull().alias("s"), F.col("_turn").alias("t"))  # nulls first
    keys = ["_id", "_role", "_digest"]
    again = rows.filter("_n > 0").groupBy(*keys).agg(F.min(when).alias("_since"), F.count(F.lit(1)).alias("_turns")).filter("_turns > 1")
    again = again.select(*[F.col(k).alias(f"{k}2") for k in keys], "_since")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_role") == F.col("_role2")) & (F.col("_digest") == F.col("_digest2"))
    return rows.join(again, same, "left").withColumn("_seen", F.coalesce(when != F.col("_since"), F.lit(False))).drop("_id2", "_role2", "_digest2", "_since")


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
LEGAL = ("su", "ua", "au")


def segments_of(rows: DataFrame, n_parts: int | None = None) -> DataFrame:
    """The rows in order of conversation, turn, role and text as segments of SEGMENT_ROWS at most.

    A range sort over all conversations: a long one lies in several partitions.
    Columns: _id, _part and _seq (their order), symbols, roles, texts, and what joins
    the counts of neighbouring segments.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    order = [F.col("_id").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_digest")]
    ranged = rows.repartitionByRange(n_parts, *order) if n_parts else rows.repartitionByRange(*order)
    schema = f"_id {kind}, _part long, _seq long, symbols string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, size, id_type, now = TaskContext.get().partitionId(), 0, [], 0, None, None
        kinds = [pa.int64()] * 2 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())] + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
        names = ["_id", "_part", "_seq", "symbols", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns"]

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [id_type, *kinds], strict=True)], names=names)

        def fresh(i):
            return {"id": i, "symbols": [], "roles": [], "texts": [], "bytes": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": None, "tail": None, "low": None, "high": None, "turns": 0}

        def ended(s):
            nonlocal seq
            seq += 1
            return (s["id"], part, seq, "".join(s["symbols"]), s["roles"], s["texts"], *[s[k] for k in names[6:]])

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for r in (x for i in range(0, batch.num_rows, 500) for x in batch.slice(i, 500).to_pylist()):
                if now is None or now["id"] != r["_id"]:
                    if now is not None:
                        out.append(ended(now))
                        size += now["bytes"]
                    now = fresh(r["_id"])
                for k in range(r["_n"]):
                    if len(now["symbols"]) == SEGMENT_ROWS or now["bytes"] > SEGMENT_BYTES:
                        out.append(ended(now))
                        size += now["bytes"]
                        now = fresh(r["_id"])
                    if len(out) > 500 or size > 4 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                    first = r["_first"]
                    fault = "blank" if r["_blank"] else "duplicate" if r["_seen"] or k else "truncated" if r["_open"] else None
                    letter = first if first in ("s", "u", "a") else "x"
                    now["symbols"].append("-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
                    now["roles"].append(r["_role"])
                    now["texts"].append("" if fault in ("blank", "duplicate") else r["_text"])
                    now["bytes"] += len(now["texts"][-1])
                    if fault:
                        now[fault] += 1
                    if now["tail"] is not None and now["tail"] + first not in LEGAL:
                        now["illegal"] += 1
                    now["head"], now["tail"] = first if now["head"] is None else now["head"], first
                    if r["_turn"] is not None and r["_turn"] != now["high"]:
                        now["low"], now["high"], now["turns"] = r["_turn"] if now["low"] is None else now["low"], r["_turn"], now["turns"] + 1
        if now is not None:
            out.append(ended(now))
            yield batch_of(out)
        released()

    return ranged.sortWithinPartitions(*order).mapInArrow(cut, schema)


def repaired(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone=None) -> DataFrame:
    """Each conversation's segments with the cheapest edits that make its roles ``(s?(ua)+)?``.

    Rows in order of turn (nulls first), then role and text.  A row's first fault
    counts: blank, duplicate (role and text seen earlier in the conversation; of
    equal rows all but one) or truncated.  Keep costs 0, a new role user or assistant
    1, deletion 2 (blank and duplicate rows must go), an inserted empty turn 5, and a
    truncated row that stays 5; of the cheapest edits the ASCII-least letters count.
    A null role or text is one space, null conversations are one; ids stay as they are,
    texts and segments of any length; of no rows nothing comes out.  ``gone``: see ``faulted``.

    Sequences of rows' symbols are equal across conversations: each distinct one is
    solved once, over a grammar learned from all (``learned_grammar``), as the product
    of its symbols' matrices.  Conversations are the products of their segments.

    Returns per segment: _id, _part and _seq (their order), audit, roles and texts (of what
    is left), and on a conversation's last segment stats (gaps, blank, duplicate,
    truncated, illegal, cost).
    """
    rows = faulted(turns, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col, gone=gone)
    segments = written(segments_of(rows), "segments")
    kind = segments.schema["_id"].dataType.simpleString()
    shapes = written(segments.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "shapes")
    grammar = learned_grammar(shapes)
    rules = grammar.rules

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            symbols = batch.column("symbols").to_pylist()
            tops = [grammar.packed(s) for s in symbols]
            found = [grammar.of(t)[0] for t in tops]
            flat = lambda m: None if m is None else [x for r in m for x in r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(symbols, pa.string()), pa.array(tops, pa.string()), pa.array([flat(m and m.cost) for m in found], pa.list_(pa.int64())), pa.array([flat(m and m.place) for m in found], pa.list_(pa.int64()))], names=["symbols", "top", "_cost", "_place"]
            )

    solved = shapes.mapInArrow(solve, "symbols string, top string, _cost array<long>, _place array<long>")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    small = segments.select("_id", "_part", "_seq", "symbols", *counts, "head", "tail", "low", "high", "turns").join(solved, "symbols").drop("symbols")
    ways = f"_id2 {kind}, _part long, _seq long, top string, _from int, _to int, _after int, stats struct<{STATS.replace(' long', ': long')}>"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each conversation, segment by segment in order: the states between them on the best way."""
        id_type, stats_type = None, pa.struct([(x.split()[0], pa.int64()) for x in STATS.split(", ")])
        kinds = [pa.int64()] * 2 + [pa.string()] + [pa.int32()] * 3 + [stats_type]
        names, out, now = ["_id2", "_part", "_seq", "top", "_from", "_to", "_after", "stats"], [], None

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [id_type, *kinds], strict=True)], names=names)

        def begin(i):
            return {"id": i, "cost": [0, NEVER, NEVER, NEVER], "place": [0, 1, 2, 3], "back": [], "n": dict.fromkeys(counts, 0), "head": None, "tail": None, "low": None, "high": None, "turns": 0}

        def step(s, r):
            before = [0, 1, 2, 3]
            if r["_cost"] is not None:
                cost, place = [], []
                for q in STATES:
                    c, _, m = min((s["cost"][m] + r["_cost"][4 * m + q], s["place"][m], m) for m in STATES)
                    cost.append(min(c, NEVER))
                    place.append((c >= NEVER, s["place"][m], r["_place"][4 * m + q]))
                    before[q] = m
                s["cost"], s["place"] = cost, [sorted(place).index(x) for x in place]
            s["back"].append((r["_part"], r["_seq"], r["top"], before))
            for k in counts:
                s["n"][k] += r[k]
            if s["tail"] is not None and r["head"] is not None and s["tail"] + r["head"] not in LEGAL:
                s["n"]["illegal"] += 1
            s["tail"] = s["tail"] if r["tail"] is None else r["tail"]
            if r["low"] is not None:
                s["turns"] += r["turns"] - (r["low"] == s["high"])
                s["low"], s["high"] = r["low"] if s["low"] is None else s["low"], r["high"]

        def ended(s):
            ends = {q: n for (q, e), n in INSERTS.items() if e in (START, ASSISTANT) and (q, e) != (START, ASSISTANT)}
            cost, _, q = min((s["cost"][q] + n * INSERT, s["place"][q], q) for q, n in ends.items())
            gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
            done, after = [], ends[q]
            for part, seq, top, before in reversed(s["back"]):
                stats = None if done else {"gaps": gaps, **s["n"], "cost": cost}
                done.append((s["id"], part, seq, top, before[q], q, after, stats))
                q, after = before[q], 0
            return done

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for r in (x for i in range(0, batch.num_rows, 500) for x in batch.slice(i, 500).to_pylist()):
                if now is None or now["id"] != r["_id"]:
                    if now is not None:
                        out += ended(now)
                    now = begin(r["_id"])
                    if len(out) > 1000:
                        yield batch_of(out)
                        out = []
                step(now, r)
        if now is not None:
            yield batch_of(out + ended(now))

    chosen = small.repartition("_id").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_part", "_seq").mapInArrow(choose, ways)
    out_schema = f"_id {kind}, _part long, _seq long, audit string, roles array<string>, texts array<string>, stats struct<{STATS.replace(' long', ': long')}>"

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, memo = Grammar(rules), {}
        for batch in batches:
            id_type, stats_type = batch.schema.field("_id").type, batch.schema.field("stats").type
            out = []
            for r in batch.to_pylist():
                key = r["top"], r["_from"], r["_to"]
                if key not in memo:
                    if len(memo) > 5000:
                        memo.clear()
                    memo[key] = grammar.audit(*key)
                audit = memo[key] + "I" * r["_after"]
                state, at, roles, texts = r["_from"], 0, [], []
                for letter in audit:
                    role, text = None, ""
                    if letter != "I":
                        role, text = r["roles"][at], r["texts"][at]
                        at += 1
                    if letter == "D":
                        continue
                    state = NEXT[state, role[0]] if letter == "K" else ASSISTANT if state == USER else USER
                    roles.append(role if letter == "K" else NAMES[state])
                    texts.append(text)
                out.append((r["_id"], r["_part"], r["_seq"], audit, roles, texts, r["stats"]))
            if out:
                kinds = [id_type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), stats_type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_id", "_part", "_seq", "audit", "roles", "texts", "stats"])

    texts = segments.select("_id", "_part", "_seq", "roles", "texts")
    out = written(texts.join(chosen.drop("_id2"), ["_part", "_seq"]).select("_id", "_part", "_seq", "roles", "texts", "top", "_from", "_to", "_after", "stats").mapInArrow(edit, out_schema), "repaired")
    discard(segments, shapes)
    return out


def repaired_turns(segments: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What ``repaired`` leaves as rows: id, _part, _seq and position in the segment (their order), role and text."""
    return segments.select(F.col("_id").alias(id_col), "_part", "_seq", F.posexplode(F.arrays_zip("roles", "texts"))).select(id_col, "_part", "_seq", F.col("pos").alias("position"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text"))


def repair_report(segments: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row for each conversation: its stats, audit and the SHA-256 of its repaired ``role:text`` lines.

    A hash runs over a conversation from its begin to its end, so one task reads the
    segments of one, in order and one at a time.
    """
    kind = segments.schema["_id"].dataType.simpleString()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [x.split()[0] for x in STATS.split(", ")]
        now, out, id_type = None, [], None

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [id_type, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=["_id", *names, "audit", "repaired_sha256"])

        def row(s):
            return (s["id"], *[s["stats"][n] for n in names], "".join(s["audit"]), s["hash"].hexdigest())

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for r in (x for i in range(0, batch.num_rows, 100) for x in batch.slice(i, 100).to_pylist()):
                if now is None or now["id"] != r["_id"]:
                    if now is not None:
                        out.append(row(now))
                    now = {"id": r["_id"], "audit": [], "hash": hashlib.sha256(), "some": False, "stats": None}
                    if len(out) > 1000:
                        yield batch_of(out)
                        out = []
                now["audit"].append(r["audit"])
                now["stats"] = r["stats"] or now["stats"]
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    now["hash"].update(("\n" * now["some"] + f"{role}:{text}").encode())
                    now["some"] = True
        if now is not None:
            yield batch_of([*out, row(now)])

    ordered = segments.repartition("_id").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_part", "_seq")
    return ordered.mapInArrow(total, f"_id {kind}, {STATS}, audit string, repaired_sha256 string").withColumnRenamed("_id", id_col)


def damaged(turns: DataFrame) -> tuple[DataFrame, F.col]:
    """``conversations`` damaged by a hash of id and turn, and the condition under which a row is dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    how = turns.select("conv_id", "turn", "role", text.alias("text"), (F.crc32(key) % 20).alias("_how"))
    how = how.withColumn("text", F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")))
    twice = F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return how.withColumn("_copy", twice).drop("_copy"), F.col("_how") == 0


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    turns, gone = damaged(table(spark, sf_dir, "conversations"))
    return repair_report(repaired(turns, gone=gone)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: The same by a table of the best (cost, audit, repaired turns) for each row and state, row after row; crc32 by its table.
OP13_SQL = """
with recursive crc as (
    select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(0, 256) r(i)),
keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hashed as (
    select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j::int, 1))::bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::bigint) % 20 as how
    from keyed, crc),
hurt as (
    select conv_id, turn, case when how = 4 then 'user' else role end as role, case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when how = 3 then [0, 1] else [0] end) as copy
    from hashed where how <> 0),
placed as (
    select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from hurt),
flagged as (
    select *, left(role, 1) as ini, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault, lag(left(role, 1)) over (partition by conv_id order by i) as before
    from placed),
inserts(p, m, n, put) as (values ('', '', 0, []::varchar[]), ('', 'u', 1, ['user:']), ('', 'a', 2, ['user:', 'assistant:']), ('s', 's', 0, []), ('s', 'u', 1, ['user:']), ('s', 'a', 2, ['user:', 'assistant:']), ('u', 'u', 0, []), ('u', 'a', 1, ['assistant:']), ('a', 'a', 0, []), ('a', 'u', 1, ['user:'])),
follows(m, q) as (values ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edits(m, letter, q, price) as (select distinct p, 'D', p, 2 from inserts union all select m, 'K', q, 0 from follows union all select m, 'R', q, 1 from follows where q <> 's'),
dp(conv_id, i, st, best) as (
    select distinct conv_id, 0::bigint, '', {'cost': 0::bigint, 'audit': '', 'put': []::varchar[]} from conversations
    union all
    select conv_id, i, q, min(way) from (
        select d.conv_id, f.i, e.q, {
            'cost': d.best.cost + 5 * n.n + e.price + case when e.letter <> 'D' and f.fault is not null then 5 else 0 end,
            'audit': d.best.audit || repeat('I', n.n) || e.letter,
            'put': list_concat(d.best.put, n.put, case e.letter when 'D' then [] when 'K' then [f.role || ':' || f.text] else [case e.q when 'u' then 'user' else 'assistant' end || ':' || f.text] end)} as way
        from dp d join flagged f on f.conv_id is not distinct from d.conv_id and f.i = d.i + 1 join inserts n on n.p = d.st join edits e on e.m = n.m
        where e.letter = 'D' or (coalesce(f.fault, '') not in ('blank', 'duplicate') and (e.letter = 'R' or e.q = f.ini))) x
    group by conv_id, i, q),
last as (select conv_id, count(i) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal from (select distinct conv_id from conversations) c left join flagged f using (conv_id) where c.conv_id is not null group by conv_id
    union all select null, count(i), coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0), count(*) filter (fault = 'blank'), count(*) filter (fault = 'duplicate'), count(*) filter (fault = 'truncated'), count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au'))
    from flagged where conv_id is null having exists (select 1 from conversations where conv_id is null)),
ended as (
    select d.conv_id, d.i, min({'cost': d.best.cost + 5 * n.n, 'audit': d.best.audit || repeat('I', n.n), 'put': list_concat(d.best.put, n.put)}) as best
    from dp d join inserts n on n.p = d.st where n.m = 'a' or (d.st = '' and n.m = '') group by d.conv_id, d.i)
select l.conv_id, l.gaps::bigint as gaps, l.blank, l.duplicate, l.truncated, l.illegal, e.best.cost as cost, e.best.audit as audit, sha256(coalesce(array_to_string(e.best.put, chr(10)), '')) as repaired_sha256
from last l join ended e on e.conv_id is not distinct from l.conv_id and e.i = l.rows
"""
