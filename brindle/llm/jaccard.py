"""Jaccard join of word n-gram sets by a token-group matrix.

Similar documents form groups, and each group keeps the union of its members'
n-grams. A document can only be similar to a member if it shares enough with the
union; groups that fall short of that bound stay closed, and only members of
the others are compared. The join is exact.

Classes. Documents with equal word sequences are one class, found by partial
aggregation; only classes go on.

Order. N-grams are ordered by how common they are, then by hash. How common is
read off ``COUNTERS`` counters that all documents add to, so that the order takes
a megabyte at any size; collisions make an n-gram look more common, never lose
it. Two sets of the needed similarity share one of their first few n-grams in any
common order: of the smaller set the n - ceil(2tn / (100 + t)) + 1 first, of the
larger the n - ceil(tn / 100) + 1 first. Only these meet in joins.

Groups. Each class first meets one other: of the n-grams it shares, the member
with most company is that n-gram's pivot, and it takes the pivot it shares most
with. What that links, as components and in blocks of like size, are the groups;
every other class is a group of its own.

Matrix. Its rows are (n-gram, group) for the first n-grams of members. Groups
look theirs up there, so that members that are alike ask once, and meet all
groups but those they are linked with already: an n-gram's most common component
does not meet itself, so that copies of one template make no pairs. Pairs of
groups go on if parity bitmaps (a lower bound of the symmetric difference), then
the full unions, leave the bound open. What is left is opened: members that
share enough with the other group's union are compared on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import free_shuffles, growing, likely, packed, release, table, unpacked
from brindle.llm.components import components
from brindle.llm.minhash import common, shingles

#: Counters of n-grams, and counters to a page.
COUNTERS, PAGE = 1 << 20, 1 << 14
#: Members of a group, about, and bytes of their sets.
MEMBERS, BYTES = 32, 4 << 20
#: Largest ratio of sizes within a group.
ALIKE = 1.03
#: Tasks' counts that are added up at a time.
FAN_IN = 256


def _tally(batches: Iterator[pd.DataFrame], ngram: int) -> Iterator[pd.DataFrame]:
    """Pages of a task's counters: how many of its documents hold an n-gram of that counter."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for b in batches:
        for lo in range(0, len(b), 1000):
            prints = [shingles(t, ngram)[1] for t in b["text"].iloc[lo : lo + 1000]]
            counts += np.bincount((np.concatenate(prints) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
    if counts.any():
        pages = counts.reshape(-1, PAGE)
        yield pd.DataFrame({"page": np.arange(len(pages)), "counts": [packed(p) for p in pages]})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PAGE, dtype=np.uint64)
    for c in rows["counts"]:
        total += unpacked(c, PAGE)
    return pd.DataFrame({"page": rows["page"].iloc[:1], "counts": [packed(total)]})


def levels(texts: DataFrame, ngram: int) -> np.ndarray:
    """How common the n-grams of each counter are, as eighths of a binary logarithm; one byte each."""
    pages = table(texts.mapInPandas(lambda it: _tally(it, ngram), "page int, counts binary").withColumn("task", F.monotonically_increasing_id()), "tally")
    tasks = pages.where("page = 0").count()
    while tasks > 1:
        parts = -(-tasks // FAN_IN)
        added = pages.groupBy("page", F.pmod(F.xxhash64("task"), F.lit(parts)).alias("part")).applyInPandas(_added, "page int, counts binary")
        added = table(added.withColumn("task", F.monotonically_increasing_id()), "tally")
        release(pages)
        pages, tasks = added, parts
    out = np.zeros((COUNTERS // PAGE, PAGE), dtype=np.uint8)
    for r in pages.select("page", "counts").collect():  # COUNTERS numbers in all
        out[r.page] = np.minimum(255, np.round(8 * np.log2(1 + unpacked(r.counts, PAGE).astype(np.float64)))).astype(np.uint8)
    release(pages)
    return out.ravel()


def firsts(n: int, percent: int) -> tuple[int, int]:
    """How many of the first of n n-grams a set shows as the smaller and as the larger of a pair."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def parity(prints: np.ndarray) -> bytes:
    """A bitmap of at least as many bits as elements: each bit whether an odd number of them falls there."""
    size = max(64, 1 << int(len(prints)).bit_length())
    odd = np.bincount((prints & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At least so many elements are in one of two sets only. The larger bitmap is folded to the other's size."""
    u, v = (np.frombuffer(z, dtype=np.uint8) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    if len(v) > len(u):
        v = np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0)
    return int(np.bitwise_count(u ^ v).sum())


def _shown(batches: Iterator[pa.RecordBatch], ngram: int, percent: int, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, seq, n, tokens, bits): the digest of the words, the set's size, its first n-grams in the common order, its bitmap."""
    for batch in batches:
        seqs, sizes, tokens, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            seq, prints = shingles(text, ngram)
            n = len(prints)
            shown = firsts(n, percent)[1] if n else 0
            order = level[(prints >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | prints & np.uint64((1 << 56) - 1)
            first = np.sort(np.partition(order, shown - 1)[:shown]) if n else order
            seqs.append(seq)
            sizes.append(n)
            tokens.append(first.view(np.int64))
            bits.append(parity(prints) if n else None)
        at = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int32)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat)), pa.array(bits, pa.binary())], ["id", "seq", "n", "tokens", "bits"])


def _sets(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [shingles(t, ngram) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in done], pa.binary()), pa.array([p.tobytes() for _, p in done], pa.binary())], ["id", "seq", "prints"])


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows whose bitmaps leave open that a set of n shares enough with a union of ``size``, of a set of ``least`` or more."""
    for batch in batches:
        n, size, least = (batch.column(c).to_numpy() for c in ("n", "size", "least"))
        far = np.array([apart(x, y) for x, y in zip(batch.column("bits").to_pylist(), batch.column("union_bits").to_pylist(), strict=True)], dtype=np.int64)
        ok = (n + size - far) // 2 * (100 + percent) >= percent * (n + least)
        yield batch.filter(pa.array(ok)).drop_columns(["bits", "union_bits"])


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with 100 * intersection >= percent * union."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("prints_a").to_pylist(), batch.column("prints_b").to_pylist(), strict=True):
            u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            ok.append(100 * both >= percent * (len(u) + len(v) - both))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups with the union of their members' sets and its bitmap."""
    for batch in batches:
        every = [np.unique(np.frombuffer(b"".join(p), dtype=np.uint64)) for p in batch.column("prints").to_pylist()]
        columns = [pa.array([len(u) for u in every], pa.int64()), pa.array([parity(u) for u in every], pa.binary()), pa.array([u.tobytes() for u in every], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("g", "label", "least", "most")], *columns], ["g", "label", "least", "most", "size", "union_bits", "every"])


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of groups whose unions share enough for members whose sizes add up to ``least`` or more."""
    for batch in batches:
        ok = []
        for x, u, least in zip(batch.column("mine").to_pylist(), batch.column("every").to_pylist(), batch.column("least").to_pylist(), strict=True):
            both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(u, dtype=np.uint64), assume_unique=True))
            ok.append(both * (100 + percent) >= percent * least)
        yield batch.filter(pa.array(ok, pa.bool_())).select(["h", "g"])


def _members(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of groups of which any two members are linked: members that share enough with the other's union, on full sets."""
    for batch in batches:
        ok = []
        for left, right in zip(batch.column("mine").to_pylist(), batch.column("prints").to_pylist(), strict=True):
            n, m = (np.array([len(p) // 8 for p in side]) for side in (left, right))
            union = np.unique(np.frombuffer(b"".join(right), dtype=np.uint64)).tobytes()
            stay = np.flatnonzero(common(left, [union])[:, 0] * (100 + percent) >= percent * (n + m.min()))
            shared = common([left[i] for i in stay], right) if len(stay) else np.zeros((0, len(right)))
            ok.append(bool((100 * shared >= percent * (n[stay][:, None] + m[None, :] - shared)).any()))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["h", "g"])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id (long), n_shingles, component_id (the smallest id reachable over
    links of at least ``percent`` % similarity).

    Null and empty texts, and texts of white space, have empty sets and link
    with nothing. Rows with a null id have a null component. An id is one
    vertex: rows that repeat it share a component even if their texts differ. A
    very long text is one array of eight bytes a word in one task. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    level = levels(source.select("text"), ngram)
    shown = source.mapInArrow(lambda it: _shown(it, ngram, percent, level), "id long, seq binary, n long, tokens array<long>, bits binary")
    shown = table(shown, "shown")
    linkable = shown.where("n > 0 and id is not null")
    classes = linkable.groupBy("seq").agg(F.min_by(F.struct("id", "n", "tokens", "bits"), "id").alias("r"), F.count(F.lit(1)).alias("copies"))
    classes = table(classes.select(F.monotonically_increasing_id().alias("v"), "seq", "copies", "r.*"), "classes")
    free_shuffles(spark)

    # The first n-grams of each class that others show too; ``small``: whether it shows them as the smaller set.
    as_small = F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    entries = classes.select("v", "n", as_small.alias("as_small"), F.posexplode("tokens").alias("place", "token"))
    entries = entries.select("token", "v", "n", (F.col("place") < F.col("as_small")).alias("small"))
    several = entries.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = table(entries.join(growing(several), "token"), "entries")
    free_shuffles(spark)

    def sets(wanted: DataFrame) -> DataFrame:
        """(v, prints), written, of the classes in the one column of ``wanted``."""
        own = table(likely(classes.select("v", "id", "seq"), "v", wanted).join(growing(wanted), "v"), "wanted")
        ids = own.select("id").distinct()
        texts = likely(source, "id", ids).join(growing(ids), "id")
        found = texts.mapInArrow(lambda it: _sets(it, ngram), "id long, seq binary, prints binary")
        out = table(found.join(growing(own), ["id", "seq"]).groupBy("v").agg(F.first("prints").alias("prints")), "sets")
        release(own)
        free_shuffles(spark)
        return out

    def alike(pairs: DataFrame, prints: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are linked, written."""
        for s in ("a", "b"):
            pairs = pairs.join(growing(prints.toDF(s, f"prints_{s}")), s)
        return table(pairs.select("a", "b", "prints_a", "prints_b").mapInArrow(lambda it: _alike(it, percent), "a long, b long"), "links")

    def open_(pairs: DataFrame, *keys: str) -> DataFrame:
        kinds = ", ".join(f"{k} long" for k in [*keys, "n", "size", "least"])
        return table(pairs.select(*keys, "n", "size", "least", "bits", "union_bits").mapInArrow(lambda it: _open(it, percent), kinds), "open")

    # One meeting of each class, with the pivot that it shares most with.
    company = entries.groupBy("v").agg(F.sum("members").alias("company"))
    pivots = entries.join(growing(company), "v").groupBy("token").agg(F.max(F.struct("company", (-F.col("v")).alias("w"), "n")).alias("p"))
    met = entries.join(growing(pivots), "token").where("v <> -p.w").groupBy("v", "p").count().groupBy("v").agg(F.max(F.struct("count", "p")).alias("p"))
    met = met.select(F.greatest("v", -F.col("p.p.w")).alias("a"), F.least("v", -F.col("p.p.w")).alias("b")).distinct()
    side = classes.select("v", "n", "bits")
    met = met.join(growing(side.toDF("a", "n", "bits")), "a").join(growing(side.toDF("b", "size", "union_bits")), "b")
    near = open_(met.where(F.least("n", "size") * 100 >= F.greatest("n", "size") * percent).withColumn("least", F.col("size")), "a", "b")
    prints = sets(near.select(F.col("a").alias("v")).union(near.select("b")).distinct())
    links = alike(near, prints)
    twice = linkable.groupBy("id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).where("lo <> hi").select("id")
    edges = links
    if not twice.isEmpty():
        held = linkable.join(twice, "id").select("id", "seq").distinct().join(classes.select("v", "seq"), "seq")
        edges = links.unionByName(held.join(held.groupBy("id").agg(F.min("v").alias("b")), "id").where("v <> b").select(F.col("v").alias("a"), "b"))
    labels = table(components(edges), "labels")

    # Groups: classes of one component and like size. Numbers of groups of one are those of their classes.
    linked = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    members = linked.join(growing(labels), "v").join(growing(classes.select("v", "n")), "v").join(growing(prints), "v").withColumn("like", F.floor(F.log(F.col("n")) / F.log(F.lit(ALIKE))))
    sizes = members.groupBy("label", "like").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") * 8 / BYTES)).alias("parts"))
    members = members.join(growing(sizes), ["label", "like"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    heads = members.groupBy("label", "like", "part").agg((-1 - F.min("v")).alias("g"))
    members = table(members.join(growing(heads), ["label", "like", "part"]).select("g", "v", "n", "label", "prints"), "members")
    gathered = members.groupBy("g").agg(F.first("label").alias("label"), F.min("n").alias("least"), F.max("n").alias("most"), F.collect_list("prints").alias("prints"))
    groups = table(gathered.mapInArrow(_unions, "g long, label long, least long, most long, size long, union_bits binary, every binary"), "groups")

    # The matrix, and the documents that look their n-grams up in it.
    place = members.select("v", "g", F.col("label"))
    known = entries.join(growing(place), "v", "left").join(growing(labels.toDF("v", "own")), "v", "left")
    known = known.select("token", "v", "n", "small", F.coalesce("g", "v").alias("g"), F.coalesce("label", "own", "v").alias("label"))
    mixed = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    looked = table(known.join(growing(mixed), "token"), "looked")
    common = looked.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    known = looked.join(growing(common), "token").withColumn("top", F.col("label") == F.col("top"))
    spread = [F.min("n").alias("least"), F.max("n").alias("most")]
    matrix = known.groupBy("token", "g", "label", "top").agg(*spread)
    asking = known.where("small").groupBy("token", "g", "label", "top").agg(*spread).toDF("token", "h", "own", "mine", "low", "high")

    def looked_up(queries: DataFrame, rows: DataFrame) -> DataFrame:
        fits = (F.col("label") != F.col("own")) & (F.col("low") <= F.col("most")) & (F.col("high") * 100 >= F.col("least") * percent)
        return queries.join(growing(rows), "token").where(fits).select(F.least("g", "h").alias("h"), F.greatest("g", "h").alias("g"))

    met2 = looked_up(asking.where("not mine"), matrix).unionByName(looked_up(asking.where("mine"), matrix.where("not top"))).distinct()
    met2 = table(met2, "pairs")
    free_shuffles(spark)
    sized = groups.select("g", "least", "size", "union_bits").unionByName(classes.select(F.col("v").alias("g"), F.col("n").alias("least"), F.col("n").alias("size"), F.col("bits").alias("union_bits")))
    pairs = met2.join(growing(sized.toDF("h", "low", "n", "bits")), "h").join(growing(sized), "g")
    pairs = open_(pairs.withColumn("least", F.col("low") + F.col("least") - F.col("n")), "h", "g")
    ones = pairs.select("g").union(pairs.select("h")).where("g >= 0").distinct()
    more = sets(ones.select(F.col("g").alias("v")))
    # The full unions decide which groups are opened.
    every = groups.select("g", "every").unionByName(more.toDF("g", "every"))
    ask = pairs.select("h", "g", (F.col("least") + F.col("n")).alias("least")).join(growing(every.toDF("h", "mine")), "h").join(growing(every), "g")
    passed = table(ask.select("h", "g", "least", "mine", "every").mapInArrow(lambda it: _bounded(it, percent), "h long, g long"), "passed")
    lists = members.groupBy("g").agg(F.collect_list("prints").alias("prints")).unionByName(more.select(F.col("v").alias("g"), F.array("prints").alias("prints")))
    opened = passed.join(growing(lists.toDF("h", "mine")), "h").join(growing(lists), "g")
    found = table(opened.select("h", "g", "mine", "prints").mapInArrow(lambda it: _members(it, percent), "h long, g long"), "links")
    # A group's number tells its first member.
    member = lambda c: F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c))
    found_links = found.select(member("h").alias("a"), member("g").alias("b"))
    final = components(edges.unionByName(found_links))
    free_shuffles(spark)

    named = classes.select("v", "seq", "id", "copies").join(growing(final), "v", "left").withColumn("label", F.coalesce("label", "v"))
    lowest = named.groupBy("label").agg(F.min("id").alias("component"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    owner = table(named.join(growing(lowest), "label").select("seq", "component"), "owners")
    release(classes, entries, near, prints, links, labels, members, groups, looked, met2, pairs, more, passed, found)
    return owned(shown, owner, id_col)


def owned(shown: DataFrame, owner: DataFrame, id_col: str) -> DataFrame:
    """Rows with their class' component: a class may hold a third of all rows, so that it is spread over salted copies."""
    salts = 32
    owner = owner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = shown.select("id", "seq", "n").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(growing(owner), ["seq", "salt"], "left")
    component: Column = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
