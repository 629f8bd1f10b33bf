"""Conversation repair by generalised LR over the role grammar ``T -> empty | B | s B; B -> P | B P; P -> u a``.

Every turn is kept, reroled, deleted or preceded by inserted turns, each at a price. All choices are
followed at once: stacks of LR states share their common parts as tuples of a graph, a shift is followed
by its reductions, and stacks that come out equal are merged by the least (cost, audit). The grammar is
left-recursive, so only eight settled stacks exist and a turn costs the same however long the conversation is.

Turns are range-sorted by conversation, turn, role and text, and cut into pieces of bounded rows and
bytes. A piece that is a whole conversation is repaired where it lies. The others (long conversations, and
those at the border of a task) are repaired from every stack they may start with; only the prices and the
order of the audits of these repairs are brought together, which picks one repair per piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialise

#: LR automaton of the grammar: states by what was read: 0 nothing, 1 s, 2 u, 3 B, 4 P, 5 s B, 6 u a, 7 B P.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 6}, 3: {"u": 2}, 5: {"u": 2}}
REDUCE = {6: (2, "P"), 4: (1, "B"), 7: (2, "B")}
GOTO = {(0, "P"): 4, (0, "B"): 3, (1, "P"): 4, (1, "B"): 5, (3, "P"): 7, (5, "P"): 7}
ACCEPT = {0, 3, 5}
FRESH = (0,)
SETTLED = (FRESH, (0, 1), (0, 2), (0, 1, 2), (0, 3), (0, 3, 2), (0, 1, 5), (0, 1, 5, 2))

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
PIECE_ROWS, PIECE_BYTES, REMEMBERED = 512, 1_000_000, 50_000


def push(stack: tuple, role: str) -> tuple | None:
    """The settled stack after shifting a role initial, or None where the grammar does not allow it."""
    state = SHIFT[stack[-1]].get(role)
    if state is None:
        return None
    stack += (state,)
    while stack[-1] in REDUCE:
        n, symbol = REDUCE[stack[-1]]
        stack = stack[:-n]
        stack += (GOTO[stack[-1], symbol],)
    return stack


PUSHED = {(top, role): push(top, role) for top in SETTLED for role in "sua"}


def _merge(tops: dict, stack: tuple | None, cost: int, audit: str) -> bool:
    if stack is None or (stack in tops and tops[stack] <= (cost, audit)):
        return False
    tops[stack] = (cost, audit)
    return True


def with_inserts(tops: dict) -> dict:
    """Stacks reached by inserting turns, those without any included."""
    out, new = dict(tops), list(tops)
    while new:
        reached = []
        for stack in new:
            cost, audit = out[stack]
            for role in "ua":
                after = PUSHED[stack, role]
                if _merge(out, after, cost + INSERT, audit + "I"):
                    reached.append(after)
        new = reached
    return out


def repairs(pattern: str, start: tuple = FRESH) -> dict:
    """{stack: (cost, audit)} after the turns of ``pattern``, from the stack ``start``.

    A turn is its role's initial (``x``: outside the grammar), in upper case if truncated, or ``d`` if it
    (or a run of such turns) has to be deleted. Turns are inserted only before a turn that stays: elsewhere
    they cost as much and come later in the order of audits. So no audit begins another of the same turns.
    """
    tops = {start: (0, "")}
    for turn in pattern:
        after = {}
        if turn == "d":
            tops = {stack: (cost, audit + "D") for stack, (cost, audit) in tops.items()}
            continue
        for stack, (cost, audit) in tops.items():
            _merge(after, stack, cost + DELETE, audit + "D")
        more = TRUNCATED if turn.isupper() else 0
        for stack, (cost, audit) in with_inserts(tops).items():
            if turn != "x" and turn != "X":
                _merge(after, PUSHED[stack, turn.lower()], cost + more, audit + "K")
            for role in "ua":
                _merge(after, PUSHED[stack, role], cost + more + REROLE, audit + "R")
        tops = after
    return tops


def ending(stack: tuple) -> str:
    """The inserts that complete a stack."""
    return "II" if stack == (0, 1) else "" if stack[-1] in ACCEPT else "I"


def close(tops: dict) -> tuple[int, str, tuple]:
    """(cost, audit, last stack) of the least complete repair."""
    done = ((c + INSERT * len(ending(s)), a + ending(s), s) for s, (c, a) in tops.items())
    return min(done)


TURN = "fault string, first boolean, n long, role string, text string"
STATS = (
    "conv_id long, task int, piece long, whole boolean, min_turn long, max_turn long, n_turns long, head string, tail string, "
    "blank long, duplicate long, truncated long, illegal long"
)
PIECES = f"{STATS}, cost long, audit string, n_kept long, repaired string, links array<int>, turns array<struct<{TURN.replace(' ', ':').replace(',:', ',')}>>"


def pattern_of(turns: list) -> str:
    """Turns (fault, first, n, role, text) as a pattern of :func:`repairs`; copies of a turn follow it as one ``d``."""
    out = []
    for fault, first, n, role, _ in turns:
        if fault != "blank" and first and n:
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            out.append(c.upper() if fault == "truncated" else c)
            n -= 1
        if n:
            out.append("d")
    return "".join(out)


def apply_audit(turns: list, audit: str, start: tuple) -> tuple[str, list[str]]:
    """(audit with a letter per turn, lines ``role:text``) of a repair of ``turns``."""
    letters, lines, k, asked = [], [], 0, start[-1] == 2

    def answer() -> str:
        return "assistant" if asked else "user"

    for fault, first, n, role, text in turns:
        if fault != "blank" and first and n:
            while audit[k] == "I":
                lines.append(f"{answer()}:")
                letters.append("I")
                asked, k = not asked, k + 1
            if audit[k] == "K":
                lines.append(f"{role}:{text}")
                asked = role[:1] == "u"
            elif audit[k] == "R":
                lines.append(f"{answer()}:{text}")
                asked = not asked
            letters.append(audit[k])
            n, k = n - 1, k + 1
        if n:
            letters.append("D" * n)
            k += 1
    for _ in audit[k:]:
        lines.append(f"{answer()}:")
        letters.append("I")
        asked = not asked
    return "".join(letters), lines


def _statistics(turns: list, numbers: list) -> tuple:
    """Turn range and counts of the turns of a piece, as in STATS."""
    known = [t for t, row in zip(numbers, turns) if t is not None and row[2]]
    blank = sum(r[2] for r in turns if r[0] == "blank")
    doubled = sum(r[2] - bool(r[1] and r[2]) for r in turns if r[0] != "blank")
    cut = sum(1 for r in turns if r[0] == "truncated" and r[1] and r[2])
    illegal, before, head = 0, None, None
    for _, _, n, role, _ in turns:
        if not n:
            continue
        c = role[:1]
        head = c if head is None else head
        if before is not None:
            illegal += before + c not in ("su", "ua", "au")
        if n > 1:
            illegal += n - 1
        before = c
    low, high = (known[0], known[-1]) if known else (None, None)
    distinct = sum(1 for i, t in enumerate(known) if not i or t != known[i - 1])
    return low, high, distinct, head, before, blank, doubled, cut, illegal


def _links(pattern: str) -> list[int]:
    """(start, end, cost, place of the audit among those of the start) of all repairs of a piece."""
    out = []
    for i, start in enumerate(SETTLED):
        found = repairs(pattern, start)
        for place, stack in enumerate(sorted(found, key=lambda s: found[s][1])):
            out += [i, SETTLED.index(stack), found[stack][0], place]
    return out


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _repair_pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, memory = TaskContext.get().partitionId(), 0, {}
        out, size = [], 0

        def finish(conv, turns, numbers, whole):
            nonlocal piece
            stats = _statistics(turns, numbers)
            row = [conv, task, piece, whole, *stats]
            pattern = pattern_of(turns)
            if whole:
                if pattern not in memory:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[pattern] = close(repairs(pattern))[:2]
                cost, audit = memory[pattern]
                # a run of deleted turns is one letter of the pattern and may stand for many turns
                cost += DELETE * (_deletions(turns))
                audit, lines = apply_audit(turns, audit, FRESH)
                row += [cost, audit, len(lines), "\n".join(lines), None, None]
            else:
                row += [None, None, None, None, _links(pattern), [dict(zip(FIELDS, t)) for t in turns]]
            piece += 1
            out.append(row)

        conv, turns, numbers, held, closed = None, [], [], 0, False
        begun = False
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for c, number, role, text, n, first, fault in zip(*cols):
                if begun and c != conv:
                    finish(conv, turns, numbers, closed)
                    turns, numbers, held, closed = [], [], 0, True
                elif turns and (len(turns) >= PIECE_ROWS or held + len(text) > PIECE_BYTES):
                    finish(conv, turns, numbers, False)
                    turns, numbers, held, closed = [], [], 0, False
                conv, begun = c, True
                turns.append((fault, first, n, role, text))
                numbers.append(number)
                held += len(text)
                size += len(text)
                if size > 4 * PIECE_BYTES:
                    yield _table(out, schema)
                    out, size = [], 0
        if begun:
            finish(conv, turns, numbers, False)
        yield _table(out, schema)

    return run


FIELDS = ("fault", "first", "n", "role", "text")


def _deletions(turns: list) -> int:
    """Cost of deleted copies, as the number of turns that have to be deleted."""
    return sum(n if fault == "blank" or not first else n - 1 for fault, first, n, _, _ in turns if n)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One repair per piece of (conv_id, task, piece, links), sorted: (task, piece, start, end, last)."""
    here, pieces, steps, tops, begun = None, [], [], {0: (0, 0)}, False

    def walk():
        end = min(tops, key=lambda e: (tops[e][0] + INSERT * len(ending(SETTLED[e])), tops[e][1]))
        rows = []
        for (task, piece), back in zip(reversed(pieces), reversed(steps)):
            rows.append((task, piece, back[end], end, not rows))
            end = back[end]
        return rows

    names = ["chosen_task", "chosen_piece", "start", "end", "last"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    schema = pa.schema(list(zip(names, types)))
    for batch in batches:
        out = []
        for conv, task, piece, links in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if begun and conv != here:
                out += walk()
                pieces, steps, tops = [], [], {0: (0, 0)}
            here, begun = conv, True
            # the least (cost, place) of each end; places compare audits: first of what came before, then of the piece
            best = {}
            for i in range(0, len(links), 4):
                start, end, cost, place = links[i : i + 4]
                if start in tops:
                    way = (tops[start][0] + cost, tops[start][1], place, start)
                    if end not in best or way < best[end]:
                        best[end] = way
            order = sorted(best, key=lambda e: best[e][1:3])
            tops = {e: (best[e][0], order.index(e)) for e in best}
            pieces.append((task, piece))
            steps.append(bytes(best[e][3] if e in best else 0 for e in range(len(SETTLED))))
        yield _table(out, schema)
    if begun:
        yield _table(walk(), schema)


def _apply_chosen(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns = [tuple(t[f] for f in FIELDS) for t in row["turns"]]
                start, end = SETTLED[row["start"]], SETTLED[row["end"]]
                cost, audit = repairs(pattern_of(turns), start)[end]
                more = ending(end) if row["last"] else ""
                audit, lines = apply_audit(turns, audit + more, start)
                done = {
                    "cost": cost + DELETE * _deletions(turns) + INSERT * len(more),
                    "audit": audit, "n_kept": len(lines), "repaired": "\n".join(lines), "links": None, "turns": None,
                }
                rows.append([(row | done)[f.name] for f in schema])
            yield _table(rows, schema)

    return run


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Pieces of conversations, repaired; of (conv_id, turn, role, text) and, if named, a count of ``copies``.

    A row per piece: ``conv_id``, ``task`` and ``piece`` (their order within it), ``whole`` (the only piece of its conversation),
    turn range and counts (see the module), ``cost``, ``audit`` and ``repaired``, ``n_kept`` lines ``role:text``. Rows are taken
    by turn (nulls first), ties by role and text, so equal rows lie side by side; null roles and texts are one
    space; null ids form one conversation. A row of 0 copies stands for no turn, yet its conversation is returned.
    Roles outside the grammar (an empty one, say) cannot be kept as they are. A piece holds 512 different turns or
    1 MB of text, a longer text is a piece of its own. An empty table gives none; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    there = n > 0
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(there, role).otherwise("").alias("role"),
        F.when(there, text).otherwise("").alias("text"),
        n.alias("n"),
    )
    # Keys without nulls, the same for the grouping and the join, so that the texts are dealt out once.
    base = base.select(
        "*",
        F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("c0"),
        F.coalesce("turn", F.lit(0)).alias("t"), F.col("turn").isNotNull().alias("t1"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("k"),
    )
    keys = ["c", "c0", "t1", "t", "k"]
    # Equal rows are combined before the shuffle; the earliest turn of each role and text is its first.
    merged = base.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("role").alias("role"), F.first("text").alias("text")
    )
    least = base.where("n > 0").groupBy("c", "c0", "k").agg(F.min(F.struct("t1", "t")).alias("at"))
    least = least.select("c", "c0", "at.t1", "at.t", "k", F.lit(True).alias("first"))
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(seen == "", "blank").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    flagged = merged.join(least, keys, "left").select(
        F.when(~F.col("c0"), F.col("c")).alias("conv_id"),
        F.when(F.col("t1"), F.col("t")).alias("turn"),
        "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"), fault.alias("fault"),
    )
    flagged = materialise(flagged, "turns")
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = flagged.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = _arrow(PIECES)
    pieces = materialise(ordered.mapInArrow(_repair_pieces(schema), PIECES), "conversation-pieces")
    parted = pieces.where(~F.col("whole"))
    links = parted.select("conv_id", "task", "piece", "links").repartition(parts, "conv_id")
    chosen = links.sortWithinPartitions("conv_id", "task", "piece").mapInArrow(
        _choose, "chosen_task int, chosen_piece long, start int, end int, last boolean"
    )
    same = (F.col("task") == F.col("chosen_task")) & (F.col("piece") == F.col("chosen_piece"))
    parted = parted.join(materialise(chosen, "conversation-choices"), same)
    parted = parted.drop("chosen_task", "chosen_piece").mapInArrow(_apply_chosen(schema), PIECES)
    return pieces.where("whole").unionByName(parted).drop("links", "turns")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _assemble(schema: pa.Schema):
    """Pieces in order, one conversation after the other, to a row each; texts only pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, out = None, False, []
        state = None

        def done():
            low, high, turns = state["turns"]
            gaps = high - low + 1 - turns if turns else 0
            return [conv, gaps, *state["counts"], "".join(state["audit"]), state["sha"].hexdigest()]

        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != conv:
                    out.append(done())
                    state = None
                if state is None:
                    state = {"turns": (0, 0, 0), "counts": [0] * 5, "audit": [], "sha": hashlib.sha256(), "tail": None, "lines": 0}
                conv, begun = row["conv_id"], True
                if row["n_turns"]:
                    low, high, turns = state["turns"]
                    more = row["n_turns"] - (1 if turns and high == row["min_turn"] else 0)
                    state["turns"] = (low if turns else row["min_turn"], row["max_turn"], turns + more)
                counts = [row[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
                state["counts"] = [a + b for a, b in zip(state["counts"], counts)]
                if row["head"] is not None:
                    if state["tail"] is not None:
                        state["counts"][3] += state["tail"] + row["head"] not in ("su", "ua", "au")
                    state["tail"] = row["tail"]
                state["audit"].append(row["audit"])
                if row["n_kept"]:
                    state["sha"].update(("\n" if state["lines"] else "").encode() + row["repaired"].encode())
                    state["lines"] += row["n_kept"]
            yield _table(out, schema)
            out = []
        if begun:
            yield _table([done()], schema)

    return run


def summarise(pieces: DataFrame) -> DataFrame:
    """A row per conversation: gaps, faults, ``cost``, ``audit`` and the SHA-256 of the repaired conversation.

    A digest and an audit of a conversation are by definition built in its order, so the pieces of one
    pass a single task one after the other; no task holds their texts.
    """
    whole = pieces.where("whole").select(
        "conv_id",
        F.when(F.col("n_turns") > 0, F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns")).otherwise(0).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"),
    )
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = pieces.where(~F.col("whole")).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "task", "piece")
    return whole.unionByName(parted.mapInArrow(_assemble(_arrow(SUMMARY)), SUMMARY))


def damage(turns: DataFrame) -> DataFrame:
    """Known faults by crc32 of ``conv_id:turn`` modulo 20: (conv_id, turn, role, text, ``copies``); nulls are one space.

    0 drops the turn, 1 empties it, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
