"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` (set to a local folder only where it is unset, as in
tests), so that any executor, or a retried task, can read them again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

LOW48 = np.uint64((1 << 48) - 1)

_live: dict[str, SparkSession] = {}
#: The folder used where spark.checkpoint.dir is unset.
_unset: list[str] = []


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # A folder of this machine serves only tasks of this machine.
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _unset.append(tempfile.mkdtemp(prefix="brindle-checkpoints-")) if not _unset else None
        base = _unset[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{workspace(spark)}/brindle-{name}-{uuid.uuid4().hex[:12]}"
    _live[path] = spark
    return path


#: Narrow rows that one task of a small table writes.
PER_TASK = 250_000


def table(df: DataFrame, name: str, rows: int | None = None, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it reread: the lineage is cut.

    ``rows`` bounds the number of (narrow) rows, where that is known: no more tasks and files than it needs.
    """
    path = new_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // PER_TASK)))).write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._brindle_path = path  # type: ignore[attr-defined]
    return back


def release(*tables: DataFrame | str) -> None:
    """Deletes written tables that no later step reads."""
    for t in tables:
        path = t if isinstance(t, str) else t._brindle_path
        spark = _live.pop(path, None)
        if spark is not None:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage, so that shuffle files of finished steps go.

    Spark deletes a shuffle's files once its last reference is collected; on a
    driver with a quiet heap that may be long after the step has ended.
    """
    spark._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    for path in list(_live):
        try:
            release(path)
        except Exception:  # noqa: BLE001  the session has ended: nothing to delete with
            _live.pop(path, None)


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words: separators in the trimmed text, plus one."""
    core = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(core == "", F.lit(0).cast("long")).otherwise(F.size(F.split(core, SPACE)).cast("long"))


def key_of(col: Column) -> Column:
    """A never-null string for equi-joins and windows; null and "" stay apart."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def row_key(ident: Column, *cols: Column) -> Column:
    """A never-null string of an identifier and a digest of other columns: rows of null or repeated identifiers stay apart."""
    return F.concat(key_of(ident), F.sha2(F.concat(*[F.sha2(key_of(c), 256) for c in cols]), 256))


def hex_digits(rows: int, per_bucket: int = 16_384) -> int:
    """How many leading hex digits of a uniform key give buckets of about ``per_bucket`` rows."""
    digits = 1
    while digits < 8 and rows > per_bucket * 16**digits:
        digits += 1
    return digits


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, digits: int, attach: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come before.

    ``order[0]`` is a column of uniform hex digits. Rows are dealt by (keys,
    its leading digits), so that a key with a third of all rows is spread over
    16**digits tasks; a window over the buckets' totals gives each bucket its
    base. ``keys`` are never null. ``attach`` has one row per key; its columns
    are added at the buckets' level, which keeps hot keys apart in that join too.
    ``df`` is read twice: pass a written table.
    """
    b, t, base, own = "_bucket", "_total", "_base", "_own"
    df = df.withColumn(b, F.substring(order[0], 1, digits))
    before = Window.unboundedPreceding, -1
    totals = df.groupBy(*keys, b).agg(F.sum(value).alias(t))
    totals = totals.withColumn(base, F.coalesce(F.sum(t).over(Window.partitionBy(*keys).orderBy(b).rowsBetween(*before)), F.lit(0))).drop(t)
    if attach is not None:
        totals = totals.join(attach, keys)
    within = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(*before)
    placed = df.withColumn(own, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return placed.join(totals, [*keys, b]).withColumn(out, F.col(base) + F.col(own)).drop(b, base, own)


def packed(v: np.ndarray) -> bytes:
    """Numbers below 2^64, compressed by byte planes: the upper planes of small numbers are all zero."""
    planes = np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes[: max(1, int(planes.any(1).nonzero()[0].max(initial=0)) + 1)].tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: shuffled and merged at any size, never collected by the driver for a broadcast."""
    return df.hint("shuffle_merge")


#: Bits of the largest filter that is broadcast: 32 MB.
FILTER_BITS = 1 << 28


def likely(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``col`` may be in the one column of ``keys``: all that are, and about one in sixteen of the others.

    A bitmap of hashes goes to every task, so that a join with few keys need
    not shuffle all rows. It has at most ``FILTER_BITS`` bits: of very many keys
    it lets more rows pass, never fewer.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * keys.count() + 1).bit_length() - 1))

    def place(c: str) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(c), F.lit(bits))
        return F.floor(h / (1 << 15)).cast("int"), (h % (1 << 15)).cast("int")

    page, bit = place(keys.columns[0])
    maps = keys.select(page.alias("_page"), bit.cast("long").alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    page, bit = place(col)
    byte = F.conv(F.hex(F.substr("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("_page", page).join(F.broadcast(maps), "_page").where(F.getbit(byte, bit % 8) == 1).drop("_page", "_map")


def range_bits(size: int, per_range: int) -> int:
    """Bits of the number of a range, for ranges of about ``per_range`` of ``size`` bytes; three at least."""
    return max(3, (max(1, -(-size // per_range)) - 1).bit_length())


def ranged(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes as tags that sort by range, the upper ``bits`` of the hash; up to 16 bits, the range and the lower 48 bits."""
    return hashes if bits >= 16 else (hashes >> np.uint64(64 - bits) << np.uint64(48)) | (hashes & LOW48)


def range_of(tags: np.ndarray, bits: int) -> np.ndarray:
    return tags >> np.uint64(64 - bits if bits >= 16 else 48)
