"""Repair of conversations: which turns to keep, rerole, delete or insert at the least cost.

A repaired conversation is a retained subsequence of turns, kept or given another role. What lies
between two retained turns is a gap: all its turns are deleted, at a price that prefix sums of
deletions give, and the two roles say how many turns have to be inserted. So the best way to end in
a role at a turn is the least, over the roles retained last, of a running minimum of cost less
deletions so far, plus the inserts of that pair of roles. Of ways that cost the same the one whose
audit, the initials of its edits, sorts first wins; audits of one length of turns are compared by
their ranks, not by their letters.

All turns lie in one global order, by conversation and turn, cut into ranges: a conversation longer
than any task is spread over many. Most conversations lie within a range and are repaired there. The
others leave blocks, each with the least cost and the audit from every state before it to every
state after it; these are put together per conversation.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import tidy

SPACE = " \t\n\x0b\x0c\r"
#: Prices of a turn deleted, one inserted, one given another role, and one kept though it is cut off.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: States: nothing retained, or the role retained last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts between the state before and the role retained next, and after the last one.
GAPS = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
ENDS = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Turns and characters after which a block is closed.
TURNS, CHARACTERS = 4096, 1 << 22


def _ways(initial: str, cut: bool):
    """For each state after a turn: (state before, cost less that of deleting it, edits)."""
    kept = ROLES.get(initial)
    ways = [[(state, 0, "D")] for state in range(4)]
    for (before, role), inserts in GAPS.items():
        if role == kept or role in NAMES:
            cost, letter = (0, "K") if role == kept else (REROLE, "R")
            ways[role].append((before, cost + CUT * cut + INSERT * inserts - DELETE, "I" * inserts + letter))
    return ways


WAYS = {(initial, cut): _ways(initial, cut) for initial in ("s", "u", "a", "") for cut in (False, True)}


def ranked(keys: list) -> list[int]:
    """The place of each key among the distinct ones."""
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [place[k] for k in keys]


def cheapest(steps: list, entry: int) -> list[tuple[int, str] | None]:
    """(cost, audit) from state ``entry`` to each state over ``steps``: turns (initial, cut off), or
    how many turns must go. None where no edits lead there."""
    less: list[int | None] = [None] * 4  # least cost to each state, less all deletions so far
    less[entry] = 0
    order, deleted, back = [0] * 4, 0, []
    for step in steps:
        if isinstance(step, int):
            deleted += DELETE * step
            back.append(step)
            continue
        initial, cut = step
        best = []
        for ways in WAYS[initial if initial in ROLES else "", cut]:
            best.append(min(((less[before] + cost, order[before], edits, before) for before, cost, edits in ways if less[before] is not None), default=None))
        deleted += DELETE
        less = [b and b[0] for b in best]
        order = ranked([b[1:3] if b else (0, "") for b in best])
        back.append([b and b[2:] for b in best])
    out: list = []
    for state in range(4):
        if less[state] is None:
            out.append(None)
            continue
        edits, at = [], state
        for step in reversed(back):
            if isinstance(step, int):
                edits.append("D" * step)
            else:
                edit, at = step[at]
                edits.append(edit)
        out.append((less[state] + deleted, "".join(reversed(edits))))
    return out


def ended(ways: list) -> tuple[int, str, int]:
    """(cost, audit, state) of the cheapest of (cost, audit or its rank) by state, ends included."""
    found = [(w[0] + INSERT * ENDS[s], w[1], s) for s, w in enumerate(ways) if w]
    return min(found)


def lines(audit: str, steps: list, turns: list[tuple[str, str]], state: int) -> list[str]:
    """'role:text' of the turns that an audit leaves, from ``state`` on; ``turns``: those of steps that needn't go."""
    out, rest = [], iter(turns)
    todo = itertools.chain.from_iterable(itertools.repeat(None, s) if isinstance(s, int) else (True,) for s in steps)
    for letter in audit:
        if letter == "I":
            state = ASSISTANT if state == USER else USER
            out.append(NAMES[state] + ":")
            continue
        turn = next(rest) if next(todo) else None
        if letter == "K":
            state = ROLES[turn[0][:1]]
            out.append(f"{turn[0]}:{turn[1]}")
        elif letter == "R":
            state = ASSISTANT if state == USER else USER
            out.append(f"{NAMES[state]}:{turn[1]}")
    return out


class Block:
    """Some turns of a conversation that follow each other, and what is counted over them."""

    COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.steps: list = []
        self.kept: list[tuple[str, str]] = []
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.head = self.tail = self.low = self.high = None
        self.size = 0

    def add(self, turn, role: str, text: str | None, blank: bool, cut: bool, copies: int) -> None:
        """``copies`` rows of one turn, role and text; the first may stay if ``text`` is there."""
        if not copies:
            return
        c, initial = self.counts, role[:1]
        c["rows"] += copies
        c["illegal"] += (copies - 1) + (self.tail is not None and self.tail + initial not in ("su", "ua", "au"))
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if turn is not None:
            c["turns"] += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if text is not None:
            self.steps.append((initial, cut))
            self.kept.append((role, text))
            c["truncated"] += cut
            self.size += len(text)
        gone = copies - (text is not None)
        c["blank" if blank else "duplicate"] += gone
        if gone:
            self.steps.append(gone)

    def full(self) -> bool:
        return len(self.steps) >= TURNS or self.size >= CHARACTERS


COUNTED = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _in_ranges(batches, kind):
    """Finished conversations, and blocks of those that touch an end of the range or are long."""
    place, out, size = TaskContext.get().partitionId() << 33, [], 0
    names = [*COUNTED, "cost", "audit", "repaired_sha256"]
    schema = pa.schema([("conv", kind), *((n, pa.int64()) for n in names[:-2]), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("done", pa.bool_()), ("place", pa.int64()), *((n, pa.int64()) for n in ("rows", "turns", "low", "high")), ("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("steps", pa.list_(pa.int64())), ("kept", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def finished(conv, b: Block):
        cost, audit, state = ended(cheapest(b.steps, NONE))
        text = "\n".join(lines(audit + "I" * ENDS[state], b.steps, b.kept, NONE))
        return {"conv": conv, "gaps": gaps(b.low, b.high, b.counts["turns"]), **{n: b.counts[n] for n in COUNTED[1:]}, "cost": cost, "audit": audit + "I" * ENDS[state], "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), "done": True}

    def part(conv, b: Block, at: int):
        ways = [w for entry in range(4) for w in cheapest(b.steps, entry)]
        steps = [s if isinstance(s, int) else 0 for s in b.steps]
        return {"conv": conv, **b.counts, "low": b.low, "high": b.high, "head": b.head, "tail": b.tail, "done": False, "place": at, "costs": [w[0] if w else None for w in ways], "audits": [w[1] if w else None for w in ways], "steps": steps, "kept": [{"role": r, "text": t} for r, t in b.kept]}

    now, block, whole, met = None, None, False, None  # ``whole``: the conversation began here, with this block
    for batch in batches:
        for conv, turn, role, key, n, blank, cut, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n is None:  # the first row of a text, ahead of the counts of its turn
                met = (conv, turn, role, key, text)
                continue
            if block is None or conv != now:
                if block is not None:
                    out.append(finished(now, block) if whole else part(now, block, place))
                whole, now = block is not None, conv
                block, place = Block(), place + 1
            elif block.full():
                out.append(part(now, block, place))
                block, whole, place = Block(), False, place + 1
            mine = met is not None and met[:4] == (conv, turn, role, key)
            size += len(text or "") + 64
            block.add(turn, role, met[4] if mine else None, blank, cut, n)
            met = None
            if len(out) >= 4096 or size >= CHARACTERS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if block is not None:
        out.append(part(now, block, place))
    yield pa.RecordBatch.from_pylist(out, schema)


def _put_together(table: pa.Table) -> pa.Table:
    """For the blocks of one conversation the states before and after each; counts with the first."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["place"])
    ways: list = [(0, 0), None, None, None]
    back = []
    for b in blocks:
        best = []
        for state in range(4):
            options = [(ways[e][0] + b["costs"][4 * e + state], ways[e][1], b["orders"][4 * e + state], e) for e in range(4) if ways[e] and b["costs"][4 * e + state] is not None]
            best.append(min(options, default=None))
        order = ranked([o[1:3] if o else (0, 0) for o in best])
        ways = [(o[0], r) if o else None for o, r in zip(best, order)]
        back.append([o and o[3] for o in best])
    cost, _, state = ended(ways)
    count = {n: sum(b[n] for b in blocks) for n in Block.COUNTS}
    some = [b for b in blocks if b["rows"]]
    count["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
    dated = [b for b in blocks if b["low"] is not None]
    count["turns"] -= sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    totals = {"gaps": gaps(dated[0]["low"], dated[-1]["high"], count["turns"]) if dated else 0, **{n: count[n] for n in COUNTED[1:]}, "cost": cost}
    out = []
    for k, b in reversed(list(enumerate(blocks))):
        before = back[k][state]
        out.append({"place": b["place"], "entry": before, "leave": state, "last": k == len(blocks) - 1} | (totals if k == 0 else dict.fromkeys(totals)))
        state = before
    schema = pa.schema([("place", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), *((n, pa.int64()) for n in totals)])
    return pa.Table.from_pylist(out, schema)


def _written(batches, kind):
    """Audit and hash of each conversation from its blocks in order; a block at a time is held."""
    schema = pa.schema([("conv", kind), *((n, pa.int64()) for n in [*COUNTED, "cost"]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    sha, audit, row, first = hashlib.sha256(), [], None, True
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            b = batch.slice(k, 1).to_pylist()[0]
            if b["cost"] is not None:  # the first block of a conversation
                sha, audit, row, first = hashlib.sha256(), [], {n: b[n] for n in ("conv", *COUNTED, "cost")}, True
            kept = [(t["role"], t["text"]) for t in b["kept"]]
            edits = b["audits"][4 * b["entry"] + b["leave"]] + ("I" * ENDS[b["leave"]] if b["last"] else "")
            rest = iter(kept)
            steps = [s or (next(rest)[0][:1], False) for s in b["steps"]]
            for line in lines(edits, steps, kept, b["entry"]):
                sha.update(("" if first else "\n").encode() + line.encode())
                first = False
            audit.append(edits)
            if b["last"]:
                out.append(row | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text with the faults that the hash of 'conv:turn' picks, and ``copies``."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv",
        "turn",
        F.when(code == 0, "").when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code <= 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def repaired_conversations(turns: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    * Turns go by ``turn_col``, null first; rows of one turn by role, then by the SHA-256 of their
      texts (blank ones first). Rows that repeat all of that follow each other. Null roles and texts
      are one space; rows of null id are one conversation. ``damage`` puts faults in first.
    * A row's first fault counts: blank (white space only), duplicate (role and text seen earlier),
      truncated (doesn't end in ``.!?``). Blank and duplicate rows are deleted.
    * An empty role has no initial: such a row is never kept as it is, and no pair with it is legal.
    * audit: K(eep), R(erole), D(elete), I(nsert) in order; of the cheapest ones the first by letters.
    * repaired_sha256 is a chain over the whole repaired text, so a conversation's kept texts pass, a
      block at a time, through one task; all else is spread over the ranges.
    An empty table gives an empty result; extra columns aren't read.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = damaged(rows) if damage else rows.select("conv", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    blank: Column = bare == ""
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    rows = rows.withColumn("blank", blank).withColumn("cut", cut & ~blank)
    key = F.sha2(F.col("text").cast("binary"), 256)
    # every row without its text, equal ones counted; and each text once, where its first row is
    counted = rows.groupBy("conv", "turn", "role", F.when(F.col("blank"), "").otherwise(key).alias("key"), "blank", "cut").agg(F.sum("copies").alias("n"))
    firsts = rows.filter((F.col("copies") > 0) & ~F.col("blank")).groupBy("conv", "role", "text").agg(F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn")).alias("turn"))
    firsts = firsts.select("conv", "turn", "role", key.alias("key"), F.lit(None).cast("bigint").alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), "text")
    columns = ["conv", "turn", "role", "key", "n", "blank", "cut", "text"]
    both = counted.withColumn("text", F.lit(None).cast("string")).select(*columns).unionByName(firsts)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    both = both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("n").asc_nulls_first())

    kind = both.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, ddl = to_arrow_type(kind), kind.simpleString()
    figures = ", ".join(f"{n} bigint" for n in [*COUNTED, "cost"])
    found = both.mapInArrow(
        tidy(lambda batches: _in_ranges(batches, arrow)),
        f"conv {ddl}, {figures}, audit string, repaired_sha256 string, done boolean, place bigint, rows bigint, turns bigint, low bigint, high bigint, head string, tail string, costs array<bigint>, audits array<string>, steps array<bigint>, kept array<struct<role: string, text: string>>",
    )
    found = materialise(found, "conversations")
    out = ["conv", *COUNTED, "cost", "audit", "repaired_sha256"]
    parts = found.filter(~F.col("done"))
    # of the audits of a block only their ranks are needed to choose between them
    ranks = F.transform(F.col("audits"), lambda a: F.array_position(F.array_sort(F.array_distinct(F.col("audits"))), a).cast("int"))
    chosen = (
        parts.select("conv", "place", *Block.COUNTS, "low", "high", "head", "tail", "costs", ranks.alias("orders"))
        .groupBy("conv")
        .applyInArrow(_put_together, f"place bigint, entry int, leave int, last boolean, {figures}")
    )
    joined = parts.select("conv", "place", "audits", "steps", "kept").join(chosen, "place").select("conv", "audits", "steps", "kept", "entry", "leave", "last", "place", *COUNTED, "cost")
    joined = joined.repartition("conv").sortWithinPartitions("conv", "place")
    long = joined.mapInArrow(tidy(lambda batches: _written(batches, arrow)), f"conv {ddl}, {figures}, audit string, repaired_sha256 string")
    return found.filter("done").select(*out).unionByName(long).select(F.col("conv").alias(conv_col), *out[1:])
