"""Sharding by balanced label propagation.

Documents of equal text are linked. Every document starts in a shard drawn from
its identifier; iterative joins then move linked documents to the shard in
which most of their neighbours are, as far as that shard's quota of bytes
allows, until nothing moves or ``rounds`` have passed; shards above an even
share then give up whole texts to those below; unlinked documents fill what is left,
large ones first, so that sizes end even (the law is ``bytes``) while few links
are cut.

Links are never listed: equal texts have equal sizes and are interchangeable, so
the state is a row per (text, shard) with a count, at most ``shards`` rows for a
text however many copies it has. A text that exceeds every quota fills one
shard after the other. Only one number per shard goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import hex_digits, release, running_total, table

#: Size classes (lower bounds, bytes) in which unlinked documents are placed; the small ones even out the rest.
CLASSES = (1 << 20, 1 << 17, 1 << 15, 1 << 13, 1 << 11, 1 << 9, 0)

#: Quota of a shard while labels propagate, in even shares: without room to spare few texts could meet. What is above one share is drained.
SLACK = 1.5


def _loads(state: DataFrame, shards: int, size: str) -> list[int]:
    got = {r[0]: int(r[1]) for r in state.groupBy("shard").agg(F.sum(size)).collect()}
    return [got.get(s, 0) for s in range(shards)]


def level(loads: list[int], more: int) -> list[int]:
    """How ``more`` bytes raise the lowest loads to a common level, by shard; sums to ``more``."""
    order = sorted(range(len(loads)), key=lambda s: loads[s])
    out, k, top, left = [0] * len(loads), 1, loads[order[0]], more
    while k < len(order) and (loads[order[k]] - top) * k <= left:
        left -= (loads[order[k]] - top) * k
        top, k = loads[order[k]], k + 1
    for i, s in enumerate(order[:k]):
        out[s] = top - loads[s] + left // k + (i < left % k)
    return out


def _by_interval(quota: list[int], at: Column) -> Column:
    """The shard whose interval of the summed quotas holds ``at``."""
    out, end = None, sum(quota)
    for s in reversed(range(len(quota))):
        end -= quota[s]
        if quota[s] > 0:
            out = F.when(at >= end, s) if out is None else out.when(at >= end, s)
    return F.lit(0) if out is None else out.otherwise(next(s for s, q in enumerate(quota) if q > 0))


def propagate(state: DataFrame, capacity: int, shards: int, rounds: int) -> DataFrame:
    """Moves ``state`` (key, tick, size, shard, n) towards fewer cut links under ``capacity`` bytes a shard, for ``rounds`` at most."""
    for _ in range(rounds):
        loads = _loads(state.withColumn("bytes", F.col("n") * F.col("size")), shards, "bytes")
        room = [max(0, capacity - x) for x in loads]
        # Of the shards with room, or already holding it all, the one that has most of the text.
        open_ = F.array(*[F.lit(r) for r in room])
        held = F.struct("n", (-F.col("shard")).alias("s"))
        fits = F.get(open_, "shard") >= F.col("size")
        goal = state.groupBy("key").agg(F.max(F.when(fits, held)).alias("goal"), F.count(F.lit(1)).alias("parts")).where("parts > 1 and goal is not null")
        goal = goal.select("key", (-F.col("goal.s")).alias("to"), F.col("goal.n").alias("most"))
        # Larger holdings stay; what moves is ordered by the text's own tick, which is uniform.
        want = state.join(goal, "key").where((F.col("shard") != F.col("to")) & (F.col("n") <= F.col("most")))
        want = table(want.withColumn("bytes", F.col("n") * F.col("size")), "moves")
        total = want.count()
        if not total:
            release(want)
            break
        queued = running_total(want, ["to"], ["tick", "key", "shard"], "bytes", "before", hex_digits(total))
        quota = F.get(open_, "to")
        # A quota may take a part of the last one in the queue.
        taken = F.least(F.greatest(F.floor((quota - F.col("before")) / F.col("size")), F.lit(0)), F.col("n")).cast("long")
        moved = table(queued.withColumn("taken", taken).where("taken > 0").select("key", "tick", "size", "shard", "to", "taken"), "moved")
        if moved.isEmpty():
            release(want, moved)
            break
        out = moved.select("key", "tick", "size", "shard", (-F.col("taken")).alias("n"))
        into = moved.select("key", "tick", "size", F.col("to").alias("shard"), F.col("taken").alias("n"))
        new = state.unionByName(out).unionByName(into).groupBy("key", "tick", "size", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        new = table(new, "labels")
        release(want, moved)
        state = new
    return state


def drain(state: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Moves what shards hold beyond ``capacity`` bytes into the lowest of the others.

    A shard gives up whole texts, as far as they cover its excess; they queue,
    and the room below the common level, shard by shard, cuts the queue. So only
    texts at the ends of a room are split, and no shard ends above ``capacity``
    by more than about a document.
    """
    loads = _loads(state.withColumn("bytes", F.col("n") * F.col("size")), shards, "bytes")
    excess = [max(0, x - capacity) for x in loads]
    if not any(excess):
        return state
    over = F.array(*[F.lit(x) for x in excess])
    full = table(state.where(F.get(over, "shard") > 0).withColumn("bytes", F.col("n") * F.col("size")), "full")
    queued = running_total(full, ["shard"], ["tick", "key"], "bytes", "before", hex_digits(full.count()))
    # As many documents as begin before the excess ends; half a document is left, not moved.
    need = F.floor((F.get(over, "shard") - F.col("before")) / F.col("size") + F.lit(0.5))
    taken = F.least(F.greatest(need, F.lit(0)), F.col("n")).cast("long")
    moved = table(queued.withColumn("taken", taken).where("taken > 0").select("key", "tick", "size", "shard", "taken", F.lit("all").alias("all"), (F.col("taken") * F.col("size")).alias("bytes")), "moved")
    gone = _loads(moved, shards, "bytes")
    room = level([a - b for a, b in zip(loads, gone, strict=True)], sum(gone))
    pool = running_total(moved, ["all"], ["tick", "key", "shard"], "bytes", "at", hex_digits(moved.count()))
    ends, end = [], 0
    for s in (s for s in range(shards) if room[s]):
        ends.append((s, end, end + room[s]))
        end += room[s]
    # Documents whose middle is before a place in the queue.
    upto = lambda x: F.least(F.greatest(F.floor((F.lit(x) - F.col("at")) / F.col("size") + F.lit(0.5)), F.lit(0)), F.col("taken")).cast("long")
    if not ends:
        return state
    last = ends[-1][0]
    parts = F.array(*[F.struct(F.lit(s).alias("to"), ((F.col("taken") if s == last else upto(z)) - upto(a)).alias("m")) for s, a, z in ends])
    into = pool.select("key", "tick", "size", F.explode(F.filter(parts, lambda x: x["m"] > 0)).alias("x")).select("key", "tick", "size", F.col("x.to").alias("shard"), F.col("x.m").alias("n"))
    out = moved.select("key", "tick", "size", "shard", (-F.col("taken")).alias("n"))
    new = state.unionByName(out).unionByName(into).groupBy("key", "tick", "size", "shard").agg(F.sum("n").alias("n")).where("n > 0")
    new = table(new, "labels")
    release(full, moved)
    return new


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rounds: int = 30) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the bytes of the text plus 8; a null text has none and is linked
    with empty ones. Slots number a shard's rows without gaps. Rows that repeat,
    or whose identifier is null, are rows of their own. A very long text is one
    size. The law ``bytes`` does
    not fix a document's place in a larger layout: grown_shard is null. An
    empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        (F.octet_length("t") + 8).cast("long").alias("size"),
        F.crc32(F.encode("t", "UTF-8")).alias("crc"),
        F.md5("t").alias("key"),
    )
    # Rows without an identifier have their number in the table instead, so as not to be one key.
    rows = rows.withColumn("tick", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id())), "key")))
    rows = table(rows, "sizes")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity, digits = -(-int(total) // shards), hex_digits(n)

    # Linked documents: state by (text, first shard).
    linked = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")).where("copies > 1")
    linked = table(linked, "linked")
    first = F.pmod(F.xxhash64("tick"), F.lit(shards)).cast("int")
    state = rows.withColumn("shard", first).groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")).join(linked.select("key", "size"), "key")
    state = table(state.select("key", F.col("key").alias("tick"), "size", "shard", "n"), "labels")
    state = drain(propagate(state, int(capacity * SLACK), shards, rounds), capacity, shards)

    # A text's documents, ranked, fill its shards in order.
    ends = F.array_sort(F.collect_list(F.struct("shard", "n")))
    ends = F.aggregate(ends, F.array().cast("array<struct<shard:int,upto:bigint>>"), lambda a, x: F.concat(a, F.array(F.struct(x["shard"].alias("shard"), (F.coalesce(F.get(a, F.size(a) - 1)["upto"], F.lit(0)) + x["n"]).alias("upto")))))
    ends = state.groupBy("key").agg(ends.alias("ends"))
    one = rows.withColumn("one", F.lit(1).cast("long"))
    placed = running_total(one, ["key"], ["tick"], "one", "rank", digits, ends)
    place = F.get(F.filter("ends", lambda e: e["upto"] > F.col("rank")), F.lit(0))["shard"]
    placed = placed.select("id", "size", "crc", "tick", place.alias("shard"))

    # The others, by size class: each class raises the lowest shards.
    single = table(rows.join(linked.select("key"), "key", "left_anti").select("id", "size", "crc", "tick"), "single")
    loads = _loads(state.withColumn("bytes", F.col("n") * F.col("size")), shards, "bytes")
    parts, above = [placed], None
    for low in CLASSES:
        here = single.where((F.col("size") >= low) & (F.col("size") < above) if above else F.col("size") >= low)
        above = low
        count, more = here.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not count:
            continue
        quota = level(loads, int(more))
        here = running_total(here.withColumn("all", F.lit("all")), ["all"], ["tick", "size"], "size", "before", hex_digits(count))
        middle = F.col("before") + F.floor(F.col("size") / 2)
        here = table(here.select("id", "size", "crc", "tick", _by_interval(quota, middle).cast("int").alias("shard")), "placed")
        loads = [a + b for a, b in zip(loads, _loads(here, shards, "size"), strict=True)]
        parts.append(here)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = table(whole, "placed").withColumn("one", F.lit(1).cast("long"))
    out = running_total(whole, ["shard"], ["tick", "id"], "one", "slot", digits)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
