"""Near-duplicate detection with HyperMinHash registers.

A document's set is its distinct word shingles. Of each of ``BANDS * ROWS``
hash buckets the smallest hash is kept as a register: its leading-zero count
and ``MANTISSA`` of the bits that follow. Registers are banded; documents that
agree in a band are candidates; a candidate's Jaccard similarity is estimated
from the share of equal registers, corrected for registers that agree by
chance; what may reach the threshold is verified on the full sets.

With 40 bands of 5 rows, a pair at the threshold of 0.8 shares no band with a
probability of 1e-7, whatever the size of its sets.

Skew. Documents with equal word sequences are one class, found by partial
aggregation, and only the class goes on. Buckets of equal members are one. Each
class is first compared with one pivot only, the member with most company in
the buckets that they share, which gathers large groups of near copies into
components without pairs. A second round covers what that can miss: the buckets
that still hold several components are cut into blocks of bounded size, in which
members of different components are verified on full sets where they meet (of
buckets with one most common component that fit a block, in one block). A
third compares the blocks of one bucket with each other, the most common
component's members not among themselves. Only a forest of joined labels leaves
a block, so that what is written does not grow with the pairs of a group. No
pair in a bucket is left out unless it is in one component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import free_shuffles, growing, key_of, likely, release, table
from brindle.llm.components import components

BANDS, ROWS = 40, 5
MANTISSA = 10
#: Members of a block, bytes of their sets, and fingerprints compared at a time.
BLOCK, BYTES, COLUMNS = 2048, 4 << 20, 4096
#: Standard deviations of the estimate at the threshold below which a pair is not verified.
MARGIN = 5.5


@lru_cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240101)
    odd = lambda: r.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    return odd(), odd()


def shingles(text: str, ngram: int) -> tuple[bytes, np.ndarray]:
    """The digest of the word sequence, and the sorted distinct 64-bit fingerprints of its shingles.

    Words are split at ASCII white space after A-Z are lower-cased, which is
    what ``bytes`` do. With fewer words than ``ngram`` the sequence is one shingle.
    """
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    digest = hashlib.blake2b(b" ".join(ws), digest_size=16).digest()
    if not ws:
        return digest, np.zeros(0, dtype=np.uint64)
    if len(ws) < ngram:
        return digest, np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    n = len(ws) - ngram + 1
    out = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for i in range(ngram):
        out ^= h[i : i + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return digest, np.unique(out)


def registers(prints: np.ndarray) -> np.ndarray:
    """(leading zeros << MANTISSA) + following bits, of the smallest hash of each bucket."""
    a, b = _multipliers()
    x = (prints ^ (prints >> np.uint64(29))).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * a
        h ^= h >> np.uint32(15)
        h *= b
        np.minimum(low, h.min(0), out=low)
    exponent = np.frexp(np.maximum(low, 1).astype(np.float64))[1]
    zeros = (32 - exponent).astype(np.uint32)
    bits = (low.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros << MANTISSA) + (bits >> np.uint64(32 - MANTISSA)).astype(np.uint32)).astype("<u2")


@lru_cache(maxsize=1 << 16)
def chance(n: int, m: int) -> float:
    """The probability that registers of unrelated sets of n and m elements agree, from the law of a minimum of n hashes."""
    zeros = np.arange(32)
    low = np.concatenate([np.linspace(2.0 ** -(z + 1), 2.0**-z, 65)[:-1] for z in zeros])
    width = np.repeat(2.0 ** -(zeros + 1.0) / 64, 64)
    inside = [(1 - low) ** k - (1 - low - width) ** k for k in (n, m)]
    # Each of 64 slices holds 2^MANTISSA / 64 registers, over which the law is nearly flat.
    return float((inside[0] * inside[1]).sum() / (2**MANTISSA / 64))


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from the share of equal registers; n, m: set sizes."""
    rough = lambda k: np.maximum(1, np.round(2 ** (np.round(np.log2(np.maximum(k, 1)) * 4) / 4))).astype(int)
    pairs, back = np.unique(np.stack([rough(n), rough(m)], 1), axis=0, return_inverse=True)
    c = np.array([chance(int(a), int(b)) for a, b in pairs])[back.ravel()]
    return (equal - c) / (1 - c)


def least(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def _sketch(batches: Iterator[pd.DataFrame], ngram: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        known: dict[bytes, tuple[int, bytes]] = {}
        rows = []
        for key, text in zip(b["id"], b["text"], strict=True):
            digest = text.encode("utf-8", "surrogatepass")
            short = xxhash.xxh3_128_digest(digest)
            if short not in known:
                seq, prints = shingles(text, ngram)
                known[short] = (seq, len(prints), registers(prints).tobytes() if len(prints) else None)
            rows.append((key, *known[short]))
        yield pd.DataFrame(rows, columns=["id", "seq", "n", "sig"])


def _sets(batches: Iterator[pd.DataFrame], ngram: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, s, p.tobytes()) for k, t in zip(b["id"], b["text"], strict=True) for s, p in [shingles(t, ngram)]]
        yield pd.DataFrame(rows, columns=["id", "seq", "prints"])


def _verified(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs with 100 * intersection >= percent * union, on full sets, whose registers do not exclude that."""
    t = percent / 100
    for b in batches:
        x, y = (np.frombuffer(b"".join(b[c]), dtype="<u2").reshape(len(b), -1) for c in ("sig_a", "sig_b"))
        n, m = b["n_a"].to_numpy(), b["n_b"].to_numpy()
        ok = np.minimum(n, m) >= t * np.maximum(n, m) * (1 - 1e-9)
        if len(b):
            ok &= estimate((x == y).mean(1), n, m) >= least(t)
        for i in np.flatnonzero(ok):
            u, v = (np.frombuffer(b[c].iat[i], dtype=np.uint64) for c in ("prints_a", "prints_b"))
            both = len(np.intersect1d(u, v, assume_unique=True))
            ok[i] = 100 * both >= percent * (len(u) + len(v) - both)
        yield b.loc[ok, ["a", "b"]]


def common(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many fingerprints each set of ``left`` shares with each of ``right``.

    Fingerprints that both sides hold become columns of two 0/1 matrices, whose
    product is taken ``COLUMNS`` at a time: memory is bounded by the number of sets.
    """
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        flat = np.frombuffer(b"".join(sets), dtype=np.uint64)
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for flat, row in sides:
        at = np.searchsorted(both, flat)
        hit = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(0, dtype=np.int64)
        order = hit[np.argsort(at[hit], kind="stable")]
        places.append((at[order], row[order]))
    for c in range(0, len(both), COLUMNS):
        m = []
        for (at, row), sets in zip(places, (left, right), strict=True):
            i, j = np.searchsorted(at, [c, c + COLUMNS])
            x = np.zeros((len(sets), min(COLUMNS, len(both) - c)), dtype=np.float32)
            x[row[i:j], at[i:j] - c] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def merged(labels: np.ndarray, rows: np.ndarray, hits: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """(label, smallest label) of each group of labels that ``hits`` of members ``rows`` and ``others`` join."""
    names, own = np.unique(labels, return_inverse=True)
    i, j = np.nonzero(hits)
    x, y = own[rows[i]], own[others[j]]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return [(int(names[k]), int(names[low[k]])) for k in np.flatnonzero(low != np.arange(len(low)))]


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Labels that links within a block join. A block has members ``b``, and ``a`` if it is one of two.

    A row's members are compared unless they have one label already: in a block
    of its own, those outside its most common label with all. What leaves a
    block is a forest of labels, however many pairs are alike.
    """
    for batch in batches:
        found: list[tuple[int, int]] = []
        for k in range(batch.num_rows):
            get = lambda c, k=k: batch.column(c)[k].values
            labels, n, sets = get("labels_b").to_numpy(), get("ns_b").to_numpy(), get("prints_b").to_pylist()
            if "labels_a" in batch.schema.names:
                split = len(batch.column("labels_a")[k].values)
                labels, n, sets = np.append(get("labels_a").to_numpy(), labels), np.append(get("ns_a").to_numpy(), n), get("prints_a").to_pylist() + sets
                rows, others = np.arange(split), np.arange(split, len(labels))
            else:
                names, times = np.unique(labels, return_counts=True)
                rows, others = np.flatnonzero(labels != names[times.argmax()]), np.arange(len(labels))
            if not len(rows):
                continue
            shared = common([sets[i] for i in rows], [sets[j] for j in others])
            hits = 100 * shared >= percent * (n[rows][:, None] + n[others][None, :] - shared)
            found += merged(labels, rows, hits, others)
        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["a", "b"], dtype="int64"), preserve_index=False)


def relabelled(labels: DataFrame, more: DataFrame, rows: int) -> DataFrame:
    """``labels`` (v, label), of at most ``rows`` rows, after the edges ``more`` between labels; vertices without a row are their own labels."""
    new = components(more)
    old = labels.join(growing(new.select(F.col("v").alias("label"), F.col("label").alias("_new"))), "label", "left").select("v", F.coalesce("_new", "label").alias("label"))
    return table(old.unionByName(new.join(growing(labels), "v", "left_anti")), "labels", rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id (long), n_shingles, component_id (the smallest id reachable over
    links of at least ``percent`` % similarity), kept (id = component_id).

    Null and empty texts, and texts of white space, have empty sets and link
    with nothing. Rows with a null id have a null component and are kept. An id
    is one vertex: rows that repeat it share a component even if their texts
    differ, and all that carry the component's id are kept. A very long text is
    one array of its shingles' fingerprints in one task, eight bytes a word. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The identifier travels as text: pandas would turn longs with a null into doubles.
    sent = source.withColumn("id", F.col("id").cast("string"))
    sketched = sent.mapInPandas(lambda it: _sketch(it, ngram), "id string, seq binary, n long, sig binary")
    sketched = table(sketched.withColumn("id", F.col("id").cast("long")), "registers")
    linkable = sketched.where("n > 0 and id is not null")
    classes = linkable.groupBy("seq").agg(F.min_by(F.struct("id", "n", "sig"), "id").alias("r"), F.count(F.lit(1)).alias("copies"))
    # A class is a vertex of its own, numbered as it is written.
    classes = table(classes.select(F.monotonically_increasing_id().alias("v"), "seq", F.col("r.id").alias("id"), "r.n", "r.sig", "copies"), "classes")

    band = lambda k: F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS))
    banded = classes.select("v", F.col("n").cast("int").alias("n"), F.explode(F.array(*[band(k) for k in range(BANDS)])).alias("key"))
    several = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    entries = table(banded.join(growing(several), "key"), "bands")
    free_shuffles(spark)
    # Buckets of equal members, told by their number and two sums over GF(2) of hashes, are one; the others' number is kept.
    same = [F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")]
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume"), *same)
    buckets = buckets.groupBy("members", "volume", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).drop("x", "y")
    n_entries = entries.count()
    shared = table(entries.join(growing(buckets), "key"), "buckets", n_entries)
    release(entries)

    # Full sets, and registers, of the classes that share a bucket.
    ours = table(shared.select("v").distinct(), "members", n_entries)
    wanted = likely(classes.select("v", "id", "seq", "sig"), "v", ours).join(growing(ours), "v")
    wanted = table(wanted, "wanted")
    ids = wanted.select("id").distinct()
    # Not a semi-join, which Spark would push below the filter.
    texts = likely(source, "id", ids).join(growing(ids), "id")
    sets = texts.mapInPandas(lambda it: _sets(it, ngram), "id long, seq binary, prints binary")
    # Rows may repeat an id, with this class's text or another.
    sets = sets.join(growing(wanted), ["id", "seq"]).groupBy("id", "seq", "v").agg(F.first("prints").alias("prints"), F.first("sig").alias("sig"))
    sets = table(sets.select("v", "sig", "prints"), "sets")
    release(wanted, ours)
    free_shuffles(spark)

    # First round. A bucket's pivot is its member with most company over all buckets: the text that near copies were
    # made from shares more buckets with them than they do with each other. Each class meets the pivot it shares most with.
    company = shared.groupBy("v").agg(F.sum(F.col("members") * F.col("times")).alias("company"))
    first = F.max(F.struct("company", (-F.col("v")).alias("w"), F.col("n").alias("m"))).alias("p")
    pivots = shared.join(growing(company), "v").groupBy("key").agg(first)
    met = shared.join(growing(pivots), "key").where("v <> -p.w").groupBy("v", "n", "p").agg(F.sum("times").alias("bands"))
    met = met.groupBy("v", "n").agg(F.max(F.struct("bands", "p")).alias("p")).select(F.struct("v", "n").alias("x"), F.struct((-F.col("p.p.w")).alias("v"), F.col("p.p.m").alias("n")).alias("y"))
    met = met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    met = table(met.select(F.col("x.v").alias("a"), F.col("x.n").alias("n_a"), F.col("y.v").alias("b"), F.col("y.n").alias("n_b")), "met", n_entries)
    pairs = met.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(percent / 100 * (1 - 1e-9)))
    for s in ("a", "b"):
        pairs = pairs.join(growing(sets.toDF(s, f"sig_{s}", f"prints_{s}")), s)
    links = table(pairs.mapInPandas(lambda it: _verified(it, percent), "a long, b long"), "links")
    # Classes that share an id are one vertex.
    twice = linkable.groupBy("id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).where("lo <> hi").select("id")
    if not twice.isEmpty():
        held = linkable.join(twice, "id").select("id", "seq").distinct().join(classes.select("v", "seq"), "seq")
        links = links.unionByName(held.join(held.groupBy("id").agg(F.min("v").alias("b")), "id").where("v <> b").select(F.col("v").alias("a"), "b"))
    labels = components(links, n_entries)
    free_shuffles(spark)

    def open_() -> DataFrame:
        """Members of the buckets that hold several components, but for pairs that have met, with ``most``, the bucket's most common label."""
        label = F.coalesce("label", "v").alias("label")
        named = shared.drop("times").join(growing(labels), "v", "left").select("v", "n", "key", "members", "volume", label)
        ends = named.groupBy("key", "members").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("v").alias("a"), F.min("v").alias("b"))
        ends = ends.where("lo <> hi").join(growing(met.select("a", "b", F.lit(2).cast("long").alias("members"))), ["members", "a", "b"], "left_anti")
        named = table(named.join(growing(ends.select("key")), "key"), "open", n_entries)
        counts = named.groupBy("key", "label").count()
        most = counts.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("top"))
        parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("volume") * 8 / BYTES)).cast("int")
        out = table(named.join(growing(most), "key").withColumn("parts", parts).drop("members", "volume"), "open", n_entries)
        release(named)
        return out

    def together(rows: DataFrame) -> DataFrame:
        """Buckets of one most common label as one, where its members fit a block: they are mostly the same."""
        groups = rows.select("most", "v", "n").distinct().groupBy("most").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"))
        groups = groups.where((F.col("size") <= BLOCK) & (F.col("volume") * 8 <= BYTES)).select("most", F.lit(True).alias("fits"))
        rows = rows.join(growing(groups), "most", "left").withColumn("fits", F.coalesce("fits", F.lit(False)))
        rows = rows.withColumns({"key": F.when(F.col("fits"), F.col("most")).otherwise(F.col("key")), "parts": F.when(F.col("fits"), 1).otherwise(F.col("parts"))})
        return rows.select("fits", "key", "v", "label", "parts").distinct()

    def dealt(parts: Column) -> Column:
        return F.pmod(F.xxhash64("v", "key"), parts).cast("int")

    def gathered(rows: DataFrame, side: str, *keys: str) -> DataFrame:
        one = rows.join(growing(sets.select("v", "prints")), "v").groupBy("key", *keys).agg(F.collect_list(F.struct("label", "prints")).alias("all"))
        size = lambda x: F.floor(F.octet_length(x["prints"]) / 8)
        return one.select("key", *keys, F.transform("all", lambda x: x["label"]).alias(f"labels_{side}"), F.transform("all", size).alias(f"ns_{side}"), F.transform("all", lambda x: x["prints"]).alias(f"prints_{side}"))

    # Second round: each block of a bucket that holds several components.
    rest = open_()
    if not rest.isEmpty():
        blocks = gathered(together(rest).withColumn("part", dealt(F.col("parts"))), "b", "fits", "part").where("size(labels_b) > 1").drop("key", "fits", "part")
        more = table(blocks.mapInArrow(lambda it: _blocks(it, percent), "a long, b long").distinct(), "joined")
        free_shuffles(spark)
        if not more.isEmpty():
            labels = relabelled(labels, more, n_entries)
        # Third round: blocks against each other, where a bucket has several. One side leaves out its most common component.
        if not rest.where("parts > 1").isEmpty():
            left = open_()
            share = (F.col("all") - F.col("top")) / F.col("all")
            many = left.where("parts > 1").withColumn("parts_a", F.greatest(F.lit(1), F.ceil(F.col("parts") * share)).cast("int"))
            few = many.where("label <> most").withColumn("part_a", dealt(F.col("parts_a")))
            few = few.withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            whole = many.withColumn("part_b", dealt(F.col("parts"))).withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
            both = gathered(few, "a", "part_a", "part_b").join(gathered(whole, "b", "part_a", "part_b"), ["key", "part_a", "part_b"]).drop("key", "part_a", "part_b")
            more = table(both.mapInArrow(lambda it: _blocks(it, percent), "a long, b long").distinct(), "joined")
            free_shuffles(spark)
            if not more.isEmpty():
                labels = relabelled(labels, more, n_entries)
            release(left)
    release(sets, shared, met, rest)

    # A component's smallest id. Classes of one row that link with nothing need no row here.
    named = classes.select("v", "seq", "id", "copies").join(growing(labels), "v", "left").withColumn("label", F.coalesce("label", "v"))
    lowest = named.groupBy("label").agg(F.min("id").alias("component"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    owner = table(named.join(growing(lowest), "label").select("seq", "component"), "owners")
    # A class may hold a third of all rows: its component is spread over salted copies of the class.
    salts = 32
    owner = owner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = sketched.select("id", "seq", "n").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    out = out.join(growing(owner), ["seq", "salt"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each group (that of the smallest id); all columns stay."""
    gone = near_duplicates(docs, id_col, **how).where("not kept").select(key_of(F.col(id_col)).alias("_near_id")).distinct()
    out = docs.withColumn("_near_id", key_of(F.col(id_col))).join(gone, "_near_id", "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
