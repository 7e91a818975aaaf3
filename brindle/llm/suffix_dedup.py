"""Substring deduplication with suffix arrays, threshold-bounded.

A byte is removed if a ``length``-byte string that covers it also starts in a
document with a smaller identifier. Strings are judged on the input.

What must be compared is brought together by content. Every window of
``length`` bytes has an anchor: the smallest hash of its ``GRAM``-byte
substrings, so equal windows have equal anchors.

1. Anchors of each text are dealt out by hash, as packed arrays; those that
   occur in two texts or more are returned to their texts.
2. Texts with shared anchors give, for each run of windows of one shared
   anchor, the bytes that the run spans. Equal snippets of an anchor are
   pre-aggregated to one, with the smallest identifier.
3. The distinct snippets of a range of anchors that share a window with
   another, by its hash, form one string. Its
   Burrows-Wheeler transform is taken from the order of its suffixes by their
   first bytes, and intervals are expanded: breadth first, each interval of a
   prefix p is extended backward to the intervals of cp, and a boundary that
   appears in round l is given the common prefix l. Prefix values thus come in
   increasing order; the expansion stops at ``length``, and boundaries without
   a value separate nothing shorter than that. Between boundaries lie the equal
   windows, whose smallest identifier is taken.
4. Documents drop the windows whose smallest identifier is below their own.

Exact copies are recognised by their digest and take part once. No task holds
more than a slice of a text's hashes, a packed range of anchors or one range of
snippets, whose sizes follow from the number of ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import free_shuffles, likely, packed, range_bits, range_of, ranged, release, table, unpacked

GRAM = 28
#: Bytes of text hashed at once, of text behind one range of anchors, of snippets in one suffix array.
SLICE, RANGE, ARRAY = 1 << 20, 16 << 20, 2 << 20


def anchors(data: bytes, length: int) -> np.ndarray:
    """The anchor of each window; empty for a text that is shorter than ``length``."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    if len(data) > SLICE + length:
        return np.concatenate([anchors(data[at : at + SLICE + length - 1], length) for at in range(0, len(data) - length + 1, SLICE)])
    buf = np.frombuffer(data, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), (len(buf) - 7,), (1,))
    n = len(buf) - GRAM + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += eight[8 : n + 8]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += eight[16 : n + 16]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(30)
    # The last eight bytes, which overlap those before.
    h += eight[GRAM - 8 : n + GRAM - 8]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - width + span], h[width - span :]) if span < width else h


def tags(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Tags that sort by range. An anchor is a smallest hash, so it is mixed again (one to one) before its upper bits are taken."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ranged(h ^ (h >> np.uint64(32)), bits)


def owner_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _scan(batches: Iterator[pd.DataFrame], bits: int, length: int, owner_of: Callable[[bytes], int]) -> Iterator[pd.DataFrame]:
    """Distinct anchors of texts, packed by range: rows (part, number, gaps of the sorted keys, owner's number, owners)."""
    held: dict[bytes, np.ndarray] = {}
    size = 0

    def gathered() -> pd.DataFrame:
        owners = np.fromiter(map(owner_of, held), dtype=np.int64, count=len(held))
        keys = np.concatenate(list(held.values()))
        who = np.repeat(np.arange(len(owners), dtype=np.uint16), [len(v) for v in held.values()])
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        which, at = np.unique(range_of(keys, bits), return_index=True)
        rows = []
        for p, a, b in zip(which.tolist(), at, np.append(at, len(keys))[1:], strict=True):
            present, short = np.unique(who[a:b], return_inverse=True)
            gaps = np.diff(keys[a:b], prepend=keys[a])
            rows.append((p, int(b - a), int(keys[a : a + 1].view(np.int64)[0]), packed(gaps), packed(short), owners[present].tobytes()))
        return pd.DataFrame(rows, columns=["part", "n", "low", "keys", "who", "owners"])

    for b in batches:
        for text in b["text"]:
            data = text.encode("utf-8", "surrogatepass")
            if len(data) < length or (owner := hashlib.sha256(data).digest()) in held:
                continue
            found = anchors(data, length)
            found = found[np.flatnonzero(np.append(True, found[1:] != found[:-1]))]
            held[owner] = np.unique(tags(found, bits))
            size += len(held[owner])
            if size > 1 << 21 or len(held) >= 65_000:
                yield gathered()
                held, size = {}, 0
    if held:
        yield gathered()


def _shared(rows: pd.DataFrame, groups: int, clash: list[int]) -> pd.DataFrame:
    """Of one range: anchors of two texts or more, by group of texts. Owners in ``clash`` stand for several texts each."""
    keys = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) + np.int64(low).view(np.uint64) for x, n, low in zip(rows["keys"], rows["n"], rows["low"], strict=True)])
    who = np.concatenate([np.frombuffer(o, dtype=np.int64)[unpacked(w, n)] for w, o, n in zip(rows["who"], rows["owners"], rows["n"], strict=True)])
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    same = keys[1:] == keys[:-1]
    differ = np.append(same & (who[1:] != who[:-1]), False)
    if clash:
        differ |= np.isin(who, clash)
    begins = np.flatnonzero(np.append(True, ~same))
    many = np.logical_or.reduceat(differ, begins)
    keep = np.repeat(many, np.diff(np.append(begins, len(keys))))
    keys, who = keys[keep], who[keep]
    group = who.view(np.uint64) % np.uint64(groups)
    out = [(int(g), keys[m].tobytes(), who[m].tobytes()) for g in np.unique(group) for m in [group == g]]
    return pd.DataFrame(out, columns=["grp", "keys", "who"])


def _by_text(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["keys"]])
    who = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["who"]])
    order = np.lexsort((keys, who))
    keys, who = keys[order], who[order]
    again = np.append(False, (keys[1:] == keys[:-1]) & (who[1:] == who[:-1]))
    keys, who = keys[~again], who[~again]
    owners, at = np.unique(who, return_index=True)
    return pd.DataFrame({"owner": owners, "keys": [k.tobytes() for k in np.split(keys, at[1:])]})


def _snippets(batches: Iterator[pd.DataFrame], bits: int, length: int) -> Iterator[pd.DataFrame]:
    """The bytes that each run of windows with one shared anchor spans. A text's ``keys`` are its shared anchors in order."""
    names = ("tag", "id", "v", "start")
    for b in batches:
        runs: list[tuple[np.ndarray, ...]] = []
        content: list[bytes] = []

        def gathered() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, dtype=np.int64)] * len(names)
            return pd.DataFrame(dict(zip(names, columns, strict=True))).assign(content=content)  # noqa: B023

        for key, doc, text, shared in zip(b["id"], b["v"], b["text"], b["keys"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            found = anchors(data, length)
            # Tags are one to one but for their ranges: runs of a tag are runs of an anchor, or several.
            begins = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            tag = tags(found[begins], bits)
            new = np.append(True, tag[1:] != tag[:-1])
            begins, tag = begins[new], tag[new]
            ends = np.append(begins[1:], len(found)) + length - 1
            keys = np.frombuffer(shared, dtype=np.uint64)
            hit = keys[np.minimum(np.searchsorted(keys, tag), len(keys) - 1)] == tag
            begins, tag = begins[hit], tag[hit].view(np.int64)
            runs.append((tag, np.full(len(tag), key), np.full(len(tag), doc), begins))
            content += [data[a:z] for a, z in zip(begins.tolist(), ends[hit].tolist(), strict=True)]
            if len(content) > 200_000:
                yield gathered()
                runs, content = [], []
        yield gathered()


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, from packs of seven bytes; those that agree that far in any order.

    Ranks of two packs, or of three where they fit a word, make those of a longer one.
    """
    n, have = len(text), 7
    padded = np.append(text, np.zeros(have, dtype=np.uint8)).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for i in range(have):
        key = (key << 8) | padded[i : i + n]
    while have < depth:
        rank = np.unique(key, return_inverse=True)[1] + 1
        top = int(rank.max(initial=0)) + 1
        packs = 3 if top < 1 << 21 else 2
        key = rank
        for k in range(1, packs):
            tail = np.zeros(n, dtype=np.int64)
            tail[: max(0, n - k * have)] = rank[k * have :]
            key = key * top + tail
        have *= packs
    return np.argsort(key)


def boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Places in ``order`` where the common prefix with the place before is below ``length``; first and last included.

    Only the order by the first ``length`` symbols matters: an interval of a
    prefix p of fewer symbols is contiguous in it, and so is that of cp, whose
    ends are C[c] plus the number of c's before the ends of p's interval.
    """
    n = len(text)
    last = text[order - 1]
    by_symbol = np.argsort(last, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[by_symbol] = np.arange(n)
    symbols = last[by_symbol]
    # The next row with the same symbol: a row is its symbol's last in an interval if that is beyond it.
    after = np.full(n, n, dtype=np.int64)
    same = symbols[1:] == symbols[:-1]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    rows_of = symbols.astype(np.int64) * (n + 1) + by_symbol
    first_of = np.searchsorted(symbols, np.arange(257))
    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        width = hi - lo
        if not len(width):
            break
        row = np.arange(width.sum()) + np.repeat(lo - np.append(0, np.cumsum(width)[:-1]), width)
        which = np.repeat(np.arange(len(lo)), width)
        ends = after[row] >= hi[which]
        row, which = row[ends], which[ends]
        right = lf[row] + 1
        # The whole's right end is a boundary from the start, yet its prefixes are extended too.
        new = ~known[right] | (right == first_of[last[row].astype(np.int64) + 1]) if level == 0 else ~known[right]
        right, row, which = right[new], row[new], which[new]
        known[right] = True
        c = last[row].astype(np.int64)
        left = np.searchsorted(rows_of, c * (n + 1) + lo[which])
        lo, hi = left, right
    return np.flatnonzero(known)


def smallest(contents: list[bytes], firsts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each content the smallest of ``firsts`` over the contents that hold it."""
    text = np.frombuffer(b"\x00".join(contents) + b"\x00", dtype=np.uint8)
    sizes = np.array([len(c) for c in contents])
    begins = np.append(0, np.cumsum(sizes + 1)[:-1])
    windows = sizes - length + 1
    order = suffix_order(text, length + 1)
    edges = boundaries(text, order, length)
    at = np.arange(windows.sum()) + np.repeat(begins - np.append(0, np.cumsum(windows)[:-1]), windows)
    value = np.full(len(text), np.iinfo(np.int64).max)
    value[at] = np.repeat(firsts, windows)
    low = np.minimum.reduceat(value[order], edges[:-1])
    out = np.empty(len(text), dtype=np.int64)
    out[order] = np.repeat(low, np.diff(edges))
    return np.split(out[at], np.cumsum(windows)[:-1])


def recurring(contents: list[bytes], length: int) -> np.ndarray:
    """Which contents have a window whose hash occurs again; the windows of the others are unlike all."""
    text = np.frombuffer(b"".join(contents) + bytes(8), dtype=np.uint8)
    sizes = np.array([len(c) for c in contents])
    windows = sizes - length + 1
    at = np.arange(windows.sum()) + np.repeat(np.append(0, np.cumsum(sizes)[:-1]) - np.append(0, np.cumsum(windows)[:-1]), windows)
    eight = np.lib.stride_tricks.as_strided(text[:8].view(np.uint64), (len(text) - 7,), (1,))
    h = np.zeros(len(at), dtype=np.uint64)
    for i in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ eight[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    return np.logical_or.reduceat(times[inverse] > 1, np.append(0, np.cumsum(windows)[:-1]))


def _expanded(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of one range of anchors: the smallest identifier by window, where it is not the snippet's own.

    Snippets that share an anchor by chance alone, with no window of another's, stay out of the transform.
    """
    rows = rows[recurring(list(rows["content"]), length)]
    if not len(rows):
        return rows[["tag", "mark"]].assign(mins=None)
    firsts = rows["first"].to_numpy()
    low = smallest(list(rows["content"]), firsts, length)
    mins = [None if (v == f).all() else v.tobytes() for v, f in zip(low, firsts, strict=True)]
    out = rows[["tag", "mark"]].copy()
    out["mins"] = mins
    return out[out["mins"].notna()]


def _removed(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, v, text, starts, sizes, parts in zip(b["id"], b["v"], b["text"], b["starts"], b["sizes"], b["parts"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            gone = np.zeros(len(data) + 1, dtype=np.int64)
            # Runs that go whole, then windows of the others.
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + sizes, -1)
            if len(parts):
                hit = np.concatenate([np.flatnonzero(np.frombuffer(r["mins"], dtype=np.int64) < key) + r["start"] for r in parts])
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + length, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            rows.append((v, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(rows, columns=["v", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def owner_column(sha: Column) -> Column:
    """The first eight bytes of a digest as a signed long, big-endian."""
    return F.conv(F.hex(F.substring(sha, 1, 8)), 16, -10).cast("long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: id (long), n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes if
    ``with_bytes`` (null where nothing or all is removed).

    A null text is empty. Rows with a null id are left whole and cover nothing.
    Rows that repeat an id are not smaller than each other. A very long text is
    hashed by slices, in one task. An empty table gives an empty result. Other
    columns are not read. ``length`` is at least GRAM + 8.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = source.withColumn("sha", F.unhex(F.sha2("text", 256)))
    meta = table(named.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "sha").withColumn("owner", owner_column(F.col("sha"))), "texts")
    total = int(meta.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    bits = range_bits(total, RANGE)
    # The first document of each text, numbered. Owners that several texts share are expected n^2 / 2^65 times, two at 10^10 texts.
    first = meta.where("id is not null").groupBy("sha", "owner").agg(F.min("id").alias("id"))
    first = table(first.withColumn("v", F.monotonically_increasing_id()), "firsts")
    clash = [r[0] for r in first.groupBy("owner").count().where("count > 1").select("owner").collect()]

    # 1. Shared anchors, by text.
    known = source.where("id is not null").select("text")
    anchored = known.mapInPandas(lambda it: _scan(it, bits, length, owner_of), "part long, n long, low long, keys binary, who binary, owners binary")
    shared = anchored.groupBy("part").applyInPandas(lambda rows: _shared(rows, 1 << bits, clash), "grp long, keys binary, who binary")
    shared = table(shared.groupBy("grp").applyInPandas(_by_text, "owner long, keys binary"), "anchors")
    free_shuffles(spark)

    # 2. Snippets of the first document of each such text.
    wanted = shared.join(first, "owner").drop("owner")
    texts = named.join(wanted, ["id", "sha"]).select("id", "v", "text", "keys")
    found = texts.mapInPandas(lambda it: _snippets(it, bits, length), "tag long, id long, v long, start int, content binary")
    found = table(found.withColumns({"mark": F.xxhash64("content"), "size": F.octet_length("content")}), "snippets", codec="zstd")
    free_shuffles(spark)
    release(shared)

    # 3. Distinct snippets, told by anchor and digest (112 bits), of which one place of each is looked up. Those that are the
    # only one of their anchor have nothing to match; the others are expanded by ranges of anchors.
    distinct = found.groupBy("tag", "mark").agg(F.min("id").alias("first"), F.min(F.struct("v", "start")).alias("at"), F.count(F.lit(1)).alias("n"))
    distinct = table(distinct, "distinct")
    free_shuffles(spark)
    several = table(distinct.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag"), "several")
    place = F.xxhash64("v", "start").alias("place")
    chosen = table(likely(distinct, "tag", several).select("tag", "mark", "first", "at.v", "at.start"), "chosen")
    rivals = likely(found.select("v", "start", "content", place), "place", chosen.select(place)).drop("place").join(chosen, ["v", "start"]).drop("v", "start")
    rivals = table(rivals, "rivals", codec="zstd")
    keys = table(found.drop("content"), "places")
    release(found, several, chosen)
    free_shuffles(spark)
    volume = rivals.agg(F.coalesce(F.sum(F.octet_length("content") + 1), F.lit(0))).first()[0]
    ranges = max(8, -(-int(volume) // ARRAY))
    parted = rivals.withColumn("range", F.pmod(F.xxhash64("tag"), F.lit(ranges)))
    mins = parted.groupBy("range").applyInPandas(lambda rows: _expanded(rows, length), "tag long, mark long, mins binary")
    mins = table(mins, "smallest")
    free_shuffles(spark)

    # 4. What each document loses.
    said = distinct.select("tag", "mark", "first", "n").join(mins, ["tag", "mark"], "left").where("n > 1 or mins is not null").drop("n")
    runs = keys.join(said, ["tag", "mark"])
    runs = runs.where((F.col("first") < F.col("id")) | F.col("mins").isNotNull())
    whole = F.collect_list(F.when(F.col("mins").isNull(), F.struct("start", "size")))
    runs = runs.groupBy("v").agg(whole.alias("whole"), F.collect_list(F.when(F.col("mins").isNotNull(), F.struct("start", "mins"))).alias("parts"))
    runs = table(runs.select("v", F.transform("whole", lambda x: x["start"]).alias("starts"), F.transform("whole", lambda x: x["size"]).alias("sizes"), "parts"), "runs")
    release(keys, mins, distinct, rivals)
    free_shuffles(spark)
    texts = named.join(first.drop("owner").join(runs, "v"), ["id", "sha"]).select("id", "v", "text", "starts", "sizes", "parts")
    cut = texts.mapInPandas(lambda it: _removed(it, length), "v long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    cut = (cut if with_bytes else cut.drop("kept_bytes")).dropDuplicates(["v"])
    cut = table(cut.join(first.select("v", "id", "sha"), "v").drop("v"), "removed")
    release(runs)
    free_shuffles(spark)

    # Copies of a text: whole for the smallest id, nothing of the others. Salted, as one text may have a third of the rows.
    salts = 32
    low = first.select("sha", F.col("id").alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = meta.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(low, ["sha", "salt"], "left")
    out = out.join(cut.withColumnsRenamed({"n_removed": "r", "n_spans": "s", "kept_sha256": "k"}), ["id", "sha"], "left")
    copy = F.coalesce((F.col("id") > F.col("low")) & (F.col("n_bytes") >= length), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("k", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *(["kept_bytes"] if with_bytes else []),
    )
