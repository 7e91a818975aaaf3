"""Conversation repair, against all edit sequences and against a table of best ways."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from brindle.llm import repair
from brindle.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at int, audit string, row long"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def by_hand(rows):
    """The contract's columns for one conversation's rows after damage, in order, by a table over (row, state)."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    nxt = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    name = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}

    def spread(b):
        out = dict(b)
        for _ in range(4):
            for g, (c, a, done) in list(out.items()):
                for x in nxt[g].replace("s", ""):
                    new = (c + 2, a + "I", (*done, (name[x], "")))
                    if to[x] not in out or new < out[to[x]]:
                        out[to[x]] = new
        return out

    for (_, role, text), f in zip(rows, faults, strict=True):
        best, after = spread(best), {}
        for g, (c, a, done) in best.items():
            ways = [(g, c + 3, "D", done)]
            if f not in ("b", "d"):
                e = f == "t"
                ways += [(to[x], c + 2 + e, "R", (*done, (name[x], text))) for x in nxt[g].replace("s", "")]
                if role[:1] and role[:1] in nxt[g]:
                    ways.append((to[role[0]], c + e, "K", (*done, (role, text))))
            for g2, c2, x, d2 in ways:
                if g2 not in after or (c2, a + x) < after[g2][:2]:
                    after[g2] = (c2, a + x, d2)
        best = after
    best = spread(best)
    cost, audit, done = min(best[g] for g in (0, 3) if g in best)
    text = "\n".join(f"{r}:{t}" for r, t in done)
    initials = [r[:1] for _, r, _ in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def table(seed=5, convs=60):
    r = random.Random(seed)
    say = ["Yes.", "No!", "Why?", "Well", "", " \n", "Yes. ", "a.b", "ü€", None, "x" * 3000 + ".", "Go on. "]
    out = []
    for c in range(convs):
        n = r.choice([1, 1, 2, 3, 5, 8, 13])
        turns = [t + (t > 4) * r.randint(0, 2) for t in range(n)]
        for t in turns:
            out.append((c, None if r.random() < 0.05 else t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(say)))
    out += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1000, None, "user", "a."), (1000, None, "assistant", "b.")]
    long = [(2000, t, ["user", "assistant", "assistant"][r.randrange(3)], r.choice(["One.", "Two", f"{t}.", f"{t}", "", f"Say {t}!"])) for t in range(700)]
    return out + long


def after_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def expected(rows, damage=True):
    convs = {}
    for c, t, role, text in after_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        convs.setdefault(c, []).append((t, role, text))
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(convs.get(c, []), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        out[c] = by_hand(own)
    return out


@pytest.mark.parametrize(("tasks", "most", "size"), [(3, 512, 1 << 20), (7, 4, 1 << 20), (40, 512, 2000)])
def test_against_table(spark, tasks, most, size):
    rows = table()
    given = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)
    segments = repair.repair(repair.damaged(given), tasks=tasks, most=most, size=size)
    got = {r[0]: tuple(r)[1:] for r in repair.reports(segments, given.select(given.conv_id.alias("conv"))).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, w in want.items():
        assert got[c] == w, c
    for r in segments.groupBy("conv").count().collect():
        assert r["count"] > 0
    if most == 4:
        assert segments.where("conv = 2000").count() >= 150


def test_grammar_and_edits():
    """Every sequence of edits of short conversations: none is cheaper, and the repair spells the grammar."""
    r = random.Random(9)
    for _ in range(150):
        turns = [(r.choice(["system", "user", "assistant", "x"]), r.choice(["", "", "blank", "truncated"])) for _ in range(r.randint(0, 3))]
        (cost, audit), *_ = repair.cheapest(len(turns), repair.edits(turns), 0, repair.ENDS, 1).values()
        done = repair.replay(turns, audit, 0)
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in done))
        best = None
        for n in range(len(turns), len(turns) + 4):
            for word in itertools.product("DIKR", repeat=n):
                if sum(x != "I" for x in word) != len(turns):
                    continue
                roles, i, c, ok = [("",)], 0, 0, True
                options = [""]
                for x in word:
                    role, fault = turns[i] if x != "I" else ("", "")
                    i += x != "I"
                    c += {"D": 3, "K": 0, "R": 2, "I": 2}[x] + (fault == "truncated" and x != "D")
                    ok &= not (fault == "blank" and x != "D")
                    if x != "D":
                        options = [o + y for o in options for y in ([role[0]] if x == "K" else ["u", "a"])]
                if ok and any(GRAMMAR.fullmatch(o) for o in options):
                    best = min(best or (c, "".join(word)), (c, "".join(word)))
        assert (cost, audit) == best


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.reports(repair.repair(none), none.select(none.conv_id.alias("conv"))).collect() == []


def test_query(spark):
    import duckdb

    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op11_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == expected(rows)
