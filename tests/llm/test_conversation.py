"""Conversation repair against brute force over all edits, and against its SQL on odd tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import conversation as C
from corpusflow.llm.queries import ORACLES
from tools.check_oracles import rows_of

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(C.SPACES)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def by_brute_force(rows):
    """Least (cost, audit) of all edits with at most two inserts before each row and at the end."""
    marks, best = faults(rows), None
    gaps = ["", "u", "a", "ua", "au"]
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        choices = [["D"] if m in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for m in marks]
        for acts in itertools.product(*choices):
            cost, audit, roles = 0, "", ""
            for gap, act, mark, (role, _) in zip(ins, acts, marks, rows):
                audit += "I" * len(gap) + act[0]
                cost += 2 * len(gap) + {"K": 0, "R": 2, "D": 3}[act[0]] + (act != "D" and mark == "truncated")
                roles += gap + (role[:1] if act == "K" else act[1:].lower() if act[0] == "R" else "")
            audit, cost, roles = audit + "I" * len(ins[-1]), cost + 2 * len(ins[-1]), roles + ins[-1]
            if LEGAL.match(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_repair_equals_brute_force():
    rng = random.Random(3)
    for size in (0, 1, 2, 3):
        for _ in range(40):
            rows = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["a.", "b", "", " \n", "c!"])) for _ in range(size)]
            marks = faults(rows)
            pattern = C.pattern_of([(m if m != "duplicate" else "", m != "duplicate", 1, r, t) for m, (r, t) in zip(marks, rows)])
            cost, audit, _ = C.close(C.repairs(pattern))
            dropped = sum(m in ("blank", "duplicate") for m in marks)
            assert (cost + 3 * dropped, audit) == by_brute_force(rows)


def test_pieces_joined_equal_one_piece():
    """Choosing among the repairs of pieces gives the repair of the whole, wherever it is cut."""
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(300):
        pattern = "".join(rng.choice("ssuuuaaaUAxXd") for _ in range(rng.randint(1, 14)))
        cuts = sorted(rng.sample(range(len(pattern) + 1), rng.randint(0, min(3, len(pattern)))))
        parts = [pattern[a:b] for a, b in zip([0, *cuts], [*cuts, len(pattern)])]
        batch = pa.RecordBatch.from_pydict(
            {"conv_id": [1] * len(parts), "task": [0] * len(parts), "piece": list(range(len(parts))), "links": [C._links(p) for p in parts]}
        )
        rows = sorted((r for b in C._choose(iter([batch])) for r in b.to_pylist()), key=lambda r: r["chosen_piece"])
        audit = ""
        for part, row in zip(parts, rows):
            start, end = C.SETTLED[row["start"]], C.SETTLED[row["end"]]
            audit += C.repairs(part, start)[end][1] + (C.ending(end) if row["last"] else "")
        assert audit == C.close(C.repairs(pattern))[1]


ROWS = [
    *[(1, t, r, x) for t, r, x in [(0, "system", "Be kind."), (1, "user", "Hi"), (2, "user", "Hello?"), (5, "assistant", "Yes. ")]],
    *[(2, 0, "user", "Same.")] * 5,  # repeated rows
    *[(3, t, "user" if t % 2 else "assistant", "Turn.") for t in range(40)],  # duplicates of one text
    *[(None, None, None, None), (None, 3, "user", "Who?"), (None, None, "user", "When?")],
    *[(4, None, "", "No role."), (4, 1, "assistant", ""), (4, 1, "assistant", "Tied."), (4, 1, "assistant", "Also tied")],
    *[(5, t, random.Random(t).choice(["user", "assistant", "system", "tool"]), f"Line {t}" + "." * (t % 3)) for t in range(1500)],
    *[(k, t, "user" if t % 2 == 0 else "assistant", f"{k} says {t}.") for k in range(6, 60) for t in range(4)],
    (60, 0, "user", "x" * 300_000 + "."),
]


def by_sql(rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    res = con.execute(ORACLES["op11_conversation"])
    return [d[0] for d in res.description], res.fetchall()


def test_odd_conversations_equal_sql(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumn("n", F.lit(1)).withColumn("audit", F.lit("x")).withColumn("task", F.lit(0))
    got = C.summarise(C.repair(C.damage(df), "copies"))
    cols, want = by_sql(ROWS)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, want)


def test_a_conversation_of_a_third_of_all_rows_is_cut(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(4000)]
    rows += [(k + 100, t, "user" if t == 0 else "assistant", f"{k} {t}.") for k in range(4000) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = C.repair(df)
    assert pieces.where("conv_id = 7").count() >= 4000 // C.PIECE_ROWS
    done = {r.conv_id: r for r in C.summarise(pieces).collect()}
    assert len(done) == 4001 and all(r.cost == 0 for r in done.values())
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:4000])
    assert done[7].audit == "K" * 4000 and done[7].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.summarise(C.repair(C.damage(df), "copies")).collect() == []
