"""Repair of conversations against a search over all edits, one conversation at a time."""

import hashlib
import heapq
import random
import zlib

import pytest

from oracle import connection, same
from sessionloom.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def searched(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of (turn, role, text) in order: the least (cost, audit) first."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns, seen, faults = [r[0] for r in rows if r[0] is not None], set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, put = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        names = [(n, w) for n, w in (("u", "user"), ("a", "assistant")) if (last, n) in follows]
        for n, w in names:
            heapq.heappush(heap, (cost + 5, audit + "I", i, n, (*put, w + ":")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, put))
        if faults[i] in (None, "truncated"):
            more, first, (_, role, text) = 5 * (faults[i] is not None), rows[i][1][:1], rows[i]
            if (last, first) in follows:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, first, (*put, f"{role}:{text}")))
            for n, w in names:
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, n, (*put, f"{w}:{text}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(put).encode()).hexdigest())


def plainly(rows, damage):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {conv: searched(sorted(own, key=order)) for conv, own in by.items()}


def invented(seed):
    rng, rows = random.Random(seed), []
    roles, texts = ["user", "assistant", "system", "tool", None, "", "user", "assistant"], ["a.", "b.", "c", "", None, " \n", "d!", "e?  ", "f", "é。", "q. \x0b\x0c"]
    for i in range(60):
        for _ in range(rng.randrange(14)):
            rows.append((i if rng.random() < 0.97 else None, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice([*texts, f"z{rng.randrange(99)}."])))
    rows += [(777, t // 2 if t % 7 else None, rng.choice(roles[:3]), rng.choice(["a.", "b", f"q{t}.", f"w{t}!"])) for t in range(1200)]
    return rows + [(888, 5, "user", "again and again.")] * 700


def as_dict(report):
    return {r[0]: tuple(r[1:]) for r in report.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_ROWS", 50)
    rows = invented(seed)
    got = C.repair_report(C.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert as_dict(got) == plainly(rows, False)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(C.op13_conversation_repair(spark, sf)) == plainly(rows, True)


def test_sql_of_odd_rows(spark, tmp_path):
    rows = [r for r in invented(7) if r[0] not in (777, 888)] + [(90, t, "user", None) for t in range(4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/w")
    import glob

    con = connection("/root/testdata/sf0.001")
    con.execute(f"create or replace view conversations as select * from '{glob.glob(f'{tmp_path}/w/*.parquet')[0]}'")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_conversation_repair(spark, str(tmp_path))
    same(got, con.sql(C.OP13_SQL))
    assert as_dict(got) == plainly(rows, True)


def test_rows_that_come_out(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Yes."), (1, 3, "user", "cut"), (2, 0, "user", "Only.")]
    left = C.repaired_turns(C.repaired(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "_id"), id_col="_id"), "_id").orderBy("_id", "_part", "_seq", "position")
    assert [(r["_id"], r["role"], r["text"]) for r in left.collect()] == [(1, "system", "Be."), (1, "user", "Hi."), (1, "assistant", "Yes.")]
    assert C.repair_report(C.repaired(spark.createDataFrame([], SCHEMA))).count() == 0


def test_grammar_changes_nothing():
    rng = random.Random(4)
    runs = ["".join(rng.choice(C.SYMBOLS) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["ua" * 200]
    made = []
    for _ in range(8):
        sums = C.Counter()
        for r in runs:
            sums.update(C.pair_counts(C.Grammar(made).packed(r)))
        made += [p for p, n in sums.most_common(4) if n > 1]
    rich, bare = C.Grammar(made), C.Grammar([])
    for r in runs:
        top, x, y = rich.packed(r), rich.of(rich.packed(r))[0], bare.of(r)[0]
        assert x.cost == y.cost
        for p in C.STATES:
            for q in C.STATES:
                if x.cost[p][q] < C.NEVER:
                    assert rich.audit(top, p, q) == bare.audit(r, p, q)
    assert len(rich.packed("ua" * 200)) < 100
    assert C.pair_counts("aaaa") == {"aa": 2} and C.pair_counts("aaa") == {"aa": 1}
