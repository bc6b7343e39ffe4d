"""Conversation repair against plain programs, however the turns are cut into blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from wirelake.llm import turns

BLANK = re.compile(r"[^\x20\x09-\x0D]")
PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """(turn, role, text) rows of one conversation, from (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if BLANK.search(t) else ""
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = BLANK.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def edits(row, fault, state):
    """(edit, cost, role, text) of one row."""
    yield "D", 3, None, None
    if fault not in ("blank", "duplicate"):
        more = fault == "truncated"
        yield "K", more, row[1], row[2]
        for role in ("user", "assistant"):
            yield "R", 2 + more, role, row[2]


def exhaustive(rows):
    """The least (cost, audit) over all sequences of edits with at most two inserts in a gap."""
    best, marks = None, faults(rows)
    inserted = [()] + [p for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]

    def go(k, cost, audit, kept):
        nonlocal best
        initials = "".join(r[:1] or "?" for r, _ in kept)
        if best is not None and cost > best[0] or not PATTERN.fullmatch(initials) and not PATTERN.fullmatch(initials + "a") and initials != "s":
            return
        for some in inserted:
            now = kept + [(r, "") for r in some]
            price, text = cost + 2 * len(some), audit + "I" * len(some)
            if k == len(rows):
                if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in now)) and (best is None or (price, text) < best[:2]):
                    best = (price, text, now)
                continue
            for letter, extra, role, said in edits(rows[k], marks[k], None):
                go(k + 1, price + extra, text + letter, now + ([(role, said)] if role is not None else []))

    go(0, 0, "", [])
    return best


def stepwise(rows):
    """The same by states, with whole audits as strings."""
    states, order = {"": (0, "", [])}, {"": "su", "s": "u", "u": "a", "a": "u"}
    for row, fault in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, audit, kept) in states.items():
            for inserts in range(3):
                at, now = state, list(kept)
                for _ in range(inserts):
                    at = "a" if at == "u" else "u"
                    now.append(({"u": "user", "a": "assistant"}[at], ""))
                for letter, extra, role, said in edits(row, fault, at):
                    if role is not None and (not role or role[0] not in order[at]):
                        continue
                    to = at if role is None else role[0]
                    found = (cost + 2 * inserts + extra, audit + "I" * inserts + letter, now + ([(role, said)] if role is not None else []))
                    if to not in new or found[:2] < new[to][:2]:
                        new[to] = found
        states = new
    ends = [(c + 2 * n, a + "I" * n, k + [("user", ""), ("assistant", "")][2 - n :]) for s, n in (("", 0), ("a", 0), ("u", 1), ("s", 2)) if s in states for c, a, k in [states[s]]]
    return min(ends, key=lambda e: e[:2])


def plain(rows, search):
    found = faults(rows)
    cost, audit, kept = search(rows)
    numbers = [t for t, _, _ in rows if t is not None]
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def tables(seed, convs, longest, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "é?  ", "Why? ", "a\nb."]
    rows = []
    for conv in [*range(convs), None]:
        n = rng.randint(1, longest)
        numbers = rng.sample(range(2 * n), n)
        for k in numbers:
            rows.append((conv, k if rng.random() < 0.95 else None, rng.choice(roles), rng.choice([*texts, f"Text {rng.random()}."])))
        if rng.random() < 0.3:
            rows.append(rng.choice(rows[-n:]))
    return rows


def result(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(rows, search=stepwise):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return sorted(((conv, *plain(damage(some), search)) for conv, some in by.items()), key=str)


DDL = "conv_id bigint, turn bigint, role string, text string"


def test_plain_programs_agree():
    for conv, rows in itertools.groupby(tables(3, 60, 5), key=lambda r: r[0]):
        rows = damage(list(rows)[:5])
        assert plain(rows, exhaustive) == plain(rows, stepwise)


@pytest.mark.parametrize("longest", [3, 12, 60])
def test_against_plain(spark, longest):
    rows = tables(longest, 80, longest)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", cost string, conv int")
    assert result(turns.repaired_conversations(df, damage=True)) == expected(rows)
    assert turns.repaired_conversations(df.limit(0), damage=True).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 7])
def test_blocks(spark, longest, monkeypatch):
    """Blocks of a turn or a few give what whole conversations give."""
    rows = [r for r in tables(7, 12, 70) if r[0] != 3] + [(3, k, "user" if k % 3 else "assistant", f"T{k % 50}.") for k in range(300)]
    df = spark.createDataFrame(rows, DDL)
    states = {}
    for entry in range(4):
        steps = [("u", False), 2, ("a", True), ("s", False), ("x", False), 1, ("a", False), ("u", True)] * 3
        whole = turns.cheapest(steps, entry)
        for cut in range(0, len(steps), longest):
            states.setdefault(cut, None)
        first, rest = turns.cheapest(steps[: 3 * longest], entry), [turns.cheapest(steps[3 * longest :], s) for s in range(4)]
        joined = [min(((f[0] + r[to][0], f[1] + r[to][1]) for f, r in zip(first, rest, strict=True) if f and r[to]), default=None) for to in range(4)]
        assert joined == whole
    by_one = spark.newSession()
    by_one.conf.set("spark.sql.shuffle.partitions", str(20 * longest))
    by_one.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = by_one.createDataFrame(rows, DDL)
    assert result(turns.repaired_conversations(df, damage=True)) == expected(rows)


def test_damage_off_and_repeats(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")] + [(2, None, None, None)] * 3 + [(3, 5, "assistant", "Hm")]
    got = {r[0]: r[1:] for r in result(turns.repaired_conversations(spark.createDataFrame(rows, DDL)))}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1] == (0, 0, 499, 0, 499, 3 * 499, "K" + "D" * 499 + "K", sha("user:Hi.\nassistant:Yes."))
    assert got[2] == (0, 3, 0, 0, 2, 9, "DDD", sha(""))
    assert got[3] == (0, 0, 0, 1, 0, 3, "D", sha(""))
