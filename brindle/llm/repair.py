"""Repair of a conversation's structure by its cheapest edits.

A conversation is a walk over the lattice (turn index, grammar state). Roles,
by their initials, must spell ``(s?(ua)+)?``: state 0 is the start, 1 to 3 are
behind a system, user or assistant turn. Edges keep a turn (0), give it the role
that the grammar asks for (2), delete it (3; the only edge of a blank or repeated
turn) or insert an empty turn (2); a truncated turn that stays costs 1 more.
Dijkstra's algorithm on that implicit graph takes nodes by (cost, audit), the
edits' initials so far, and stops at the first accepting end node it takes. Two
audits of one node and cost are never prefixes of each other, so that the order
holds for what is appended, and parts may be solved on their own.

Conversations come range-sorted, so that one with very many turns lies in many
tasks; each task cuts it into segments of at most ``TURNS`` turns and ``BYTES``
bytes. A conversation within one segment is solved there. Of others each segment
is solved from every state to every state, which the driver never sees: their
summaries, no longer than the audits that the result holds, meet by conversation
and the same algorithm runs over segments.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import release, table

#: State behind a role's initial, by state; the role that a state asks for; states a conversation may end in.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
WANTED = ["user", "user", "assistant", "user"]
ENDS = (0, 3)
#: Costs of edits, and of a truncated turn that stays.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: Turns and bytes of a segment, at most (a longer turn is one of its own).
TURNS, BYTES = 512, 4 << 20

BLANK_ROW = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"


def cheapest(n: int, edges: Callable[[int, int], Iterable[tuple[int, int, int, str]]], start: int, ends: tuple[int, ...], stop: int) -> dict[int, tuple[int, str]]:
    """By end state of ``ends`` the least (cost, audit) from (0, ``start``) to the end of ``n`` steps, of the first ``stop`` taken.

    ``edges`` of (index, state) are (next index, next state, cost, audit).
    """
    heap, taken, found = [(0, "", 0, start)], set(), {}
    while heap and len(found) < stop:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in taken:
            continue
        taken.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
        for j, after, more, edit in edges(i, state):
            if (j, after) not in taken:
                heapq.heappush(heap, (cost + more, audit + edit, j, after))
    return found


def edits(turns: list[tuple[str, str]]) -> Callable[[int, int], Iterator[tuple[int, int, int, str]]]:
    """Edges over ``turns`` of (role, fault)."""

    def out(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        yield i, NEXT[state][WANTED[state][0]], COST["I"], "I"
        if i < len(turns):
            role, fault = turns[i]
            yield i + 1, state, COST["D"], "D"
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED * (fault == "truncated")
                if role[:1] in NEXT[state]:
                    yield i + 1, NEXT[state][role[:1]], COST["K"] + extra, "K"
                yield i + 1, NEXT[state][WANTED[state][0]], COST["R"] + extra, "R"

    return out


def replay(turns: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) after the edits of ``audit``."""
    out, i = [], 0
    for edit in audit:
        role, text = turns[i] if edit != "I" else ("", "")
        i += edit != "I"
        if edit == "D":
            continue
        role = role if edit == "K" else WANTED[state]
        state = NEXT[state][role[:1]]
        out.append((role, text))
    return out


#: A segment: its counts, ends of its turns and roles, and either its only repair or, by states, cost and audit.
SEGMENT = (
    "conv {kind}, at long, whole boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first string, last string, "
    "steps array<struct<start:int,end:int,cost:long,audit:string>>, rows array<struct<role:string,text:string,fault:string>>"
)


def illegal(a: str | None, b: str | None) -> bool:
    """Whether two initials may not follow each other."""
    return a is not None and b is not None and a + b not in ("su", "ua", "au")


def _segment(conv, at: int, rows: list[dict], whole: bool) -> dict:
    turns = [(r["role"], r["fault"]) for r in rows]
    said = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [role[:1] for role, _ in turns]
    if whole:
        done = cheapest(len(turns), edits(turns), 0, ENDS, 1)
        steps = [(0, end, *best) for end, best in done.items()]
    else:
        steps = [(start, end, *best) for start in range(4) for end, best in cheapest(len(turns), edits(turns), start, (0, 1, 2, 3), 4).items()]
    count = lambda f: sum(fault == f for _, fault in turns)
    return {
        "conv": conv, "at": at, "whole": whole, **{f: count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(map(illegal, initials, initials[1:])),
        "low": min(said, default=None), "high": max(said, default=None), "turns": len(set(said)),
        "first": initials[0], "last": initials[-1],
        "steps": [dict(zip(("start", "end", "cost", "audit"), s, strict=True)) for s in steps],
        "rows": [{k: r[k] for k in ("role", "text", "fault")} for r in rows],
    }


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int, size: int) -> Iterator[pa.RecordBatch]:
    """Segments of the sorted rows of a task. Its first and last conversation may go on in other tasks."""
    at, done = TaskContext.get().partitionId() << 33, []
    held: list[dict] = []
    bytes_ = 0
    number, first, split = 0, True, False
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv"] != held[0]["conv"]:
                done.append(_segment(held[0]["conv"], at + number, held, not first and not split))
                number, first, split, held, bytes_ = number + 1, False, False, [], 0
            elif held and (len(held) >= most or bytes_ + len(row["text"]) > size):
                done.append(_segment(held[0]["conv"], at + number, held, False))
                number, split, held, bytes_ = number + 1, True, [], 0
            held.append(row)
            bytes_ += len(row["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if held:
        yield pa.RecordBatch.from_pylist([_segment(held[0]["conv"], at + number, held, False)], schema)


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's segments, the repair's path: (conv, at, start, cost, audit) of each."""
    parts = parts.sort_values("at")
    steps = [[(s["start"], s["end"], s["cost"], s["audit"]) for s in part] for part in parts["steps"]]

    def over(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        if i < len(steps):
            yield from ((i + 1, end, cost, audit) for start, end, cost, audit in steps[i] if start == state)

    # The audits themselves are the keys; the way back finds each segment's.
    (end, (_, audit)), *_ = cheapest(len(steps), over, 0, ENDS, 1).items()
    ways: list[dict[int, tuple[int, int]]] = [{0: (0, 0)}]
    for i in range(len(steps)):
        ways.append({e: (place + len(said), start) for start, (place, _) in ways[-1].items() for _, e, _, said in over(i, start) if audit.startswith(said, place)})
    out, state = [], end
    for i in range(len(steps), 0, -1):
        start = ways[i][state][1]
        cost, said = next((c, a) for _, e, c, a in over(i - 1, start) if e == state and audit.startswith(a, ways[i - 1][start][0]))
        out.append((parts["at"].iloc[i - 1], start, cost, said))
        state = start
    return pd.DataFrame(out[::-1], columns=["at", "start", "cost", "audit"])


def _replayed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = batch.drop_columns(["rows"]).to_pylist()
        for row, turns in zip(out, batch.column("rows").to_pylist(), strict=True):
            done = replay([(t["role"], t["text"]) for t in turns], row["audit"], row["start"])
            row["repaired"] = [{"role": r, "text": t} for r, t in done]
        yield pa.RecordBatch.from_pylist(out, schema)


def flagged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(row, conv, turn, role, text, fault), written: each turn's first fault of blank, duplicate and truncated."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    # The first of equal turns is an aggregate, so that very many are no hot key.
    same = F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)
    order = F.struct(F.coalesce(F.col("turn").isNotNull(), F.lit(False)), "turn", "row")
    first = rows.groupBy("conv", same.alias("same")).agg(F.min(order).alias("o")).select(F.col("o.row").alias("row"), F.lit(True).alias("new"))
    fault = F.when(~F.col("text").rlike(BLANK_ROW), "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("text").rlike(WHOLE), "truncated")
    return rows.join(first, "row", "left").select("row", "conv", "turn", "role", "text", F.coalesce(fault, F.lit("")).alias("fault"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tasks: int | None = None, most: int = TURNS, size: int = BYTES) -> DataFrame:
    """Segments of repaired conversations: conv, at (their order), start (grammar state before), cost, audit,
    repaired (array of role and text), blank, duplicate, truncated, illegal, low, high, turns, first and last
    (counts, least and greatest turn, distinct turns and outer initials of the segment as it came).

    Turns are taken by ``turn``, nulls first, equal ones by role, text. A null role
    or text is one space. A turn is blank without a character that is no white
    space, a duplicate if role and text came before, truncated if its last such
    character is none of ``.!?``; its first fault counts. Rows without ``conv``
    are one conversation. Repeated rows are turns. A very long text is one
    segment. An empty table gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    known = flagged(rows, conv, turn, role, text)
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ordered = known.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("row")
    schema = SEGMENT.format(kind=known.schema["conv"].dataType.simpleString())
    arrow = pa_schema(spark, schema)
    parts = table(ordered.mapInArrow(lambda it: _segments(it, arrow, most, size), schema), "segments")
    only = parts.where("whole").select("*", F.col("steps")[0]["start"].alias("start"), F.col("steps")[0]["cost"].alias("cost"), F.col("steps")[0]["audit"].alias("audit"))
    paths = parts.where("not whole").select("conv", "at", "steps").groupBy("conv").applyInPandas(_joined, "at long, start int, cost long, audit string")
    several = parts.where("not whole").join(paths, "at").select(only.columns)
    out = only.unionByName(several).drop("whole", "steps")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "rows") + ", repaired array<struct<role:string,text:string>>"
    arrow2 = pa_schema(spark, schema)
    out = table(out.mapInArrow(lambda it: _replayed(it, arrow2), schema), "repaired")
    release(parts)
    return out


def pa_schema(spark, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, as its segments come in order: no more than one is held."""
    now, sha, empty, done = None, None, True, []
    for batch in batches:
        for row in batch.to_pylist():
            if sha is None or row["conv"] != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha, empty = row["conv"], hashlib.sha256(), True
            for line in row["lines"]:
                sha.update((b"" if empty else b"\n") + line.encode("utf-8", "surrogatepass"))
                empty = False
    if sha is not None:
        done.append((now, sha.hexdigest()))
    for at in range(0, len(done), 10_000):
        part = done[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], batch.schema.field("conv").type), pa.array([h for _, h in part])], ["conv", "sha"])


def reports(segments: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv`` of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of ``role:text`` lines). A conversation without segments has zeros and the digest of nothing.
    """
    line: Callable[[Column], Column] = lambda r: F.concat(r["role"], F.lit(":"), r["text"])
    piece = F.struct("at", "first", "last", "audit", F.col("low").alias("low"), F.col("high").alias("high"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")]
    by = segments.groupBy("conv").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(piece)).alias("p"))
    # Between one segment and the next: roles that may not follow, and a turn that both hold.
    inner = F.filter(F.transform("p", lambda x, i: F.when(i > 0, F.struct(F.concat(F.get("p", i - 1)["last"], x["first"]).alias("roles"), (F.get("p", i - 1)["high"] == x["low"]).alias("twice")))), lambda x: x.isNotNull())
    wrong = F.size(F.filter(inner, lambda x: ~x["roles"].isin("su", "ua", "au")))
    twice = F.size(F.filter(inner, lambda x: F.coalesce(x["twice"], F.lit(False))))
    by = by.select("conv", "blank", "duplicate", "truncated", "cost", (F.col("illegal") + wrong).alias("illegal"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + twice, F.lit(0)).cast("long").alias("gaps"), F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    lines = segments.select("conv", "at", F.transform("repaired", line).alias("lines"))
    kind = segments.schema["conv"].dataType.simpleString()
    shas = lines.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_hashed, f"conv {kind}, sha string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    every = conversations.select(F.col("conv").alias("c")).distinct()
    out = every.join(by, F.col("c").eqNullSafe(F.col("conv")), "left").drop("conv").join(shas, F.col("c").eqNullSafe(F.col("conv")), "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("c").alias("conv"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` damaged by the CRC-32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes the
    ``.!?`` out of it, 3 repeats it, 4 makes it the user's. Nulls are one space, in that key too."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv), F.col(turn), said(role).alias(role), said(text).alias(text))
    rows = rows.withColumn("_k", F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20).where("_k <> 0")
    cut = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    rows = rows.withColumns({text: cut, role: F.when(F.col("_k") == 4, "user").otherwise(F.col(role)), "_n": F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))})
    return rows.withColumn("_n", F.explode("_n")).drop("_k", "_n")
