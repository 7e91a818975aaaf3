"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition becomes a run: one entry per text it holds, sorted by
digest, with the smallest identifier and a count. In each round, groups of
``fan_in`` neighbouring runs (binomially numbered: run r goes to r div fan_in,
which is log2(fan_in) binomial rounds at once) exchange their entries and merge
them, keeping the smallest identifier, until one run is left.

A merged run is ``fan_in`` times as long as those before, so it is held in as
many segments, which are ranges of the digest: a task merges one segment of one
run, and tasks stay of one size up to the last round. Blocks arrive sorted, the
sort merges them, and the aggregate streams over equal neighbours in that order:
neither adds an exchange of its own. The winners then go back down the same
tree. A text that holds a third of all rows therefore has at most one entry per
run at every level, in either direction, and never meets in one task.

An entry is keyed by (SHA-256, byte length, XXH64): identifiers are merged
only where all three agree, which verifies the digest independently at every
level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, key_of, table

KEY = ["sha", "n_bytes", "check"]


def normalised(text):
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def merged(rows: DataFrame, runs: int, segments: int, *entry: Column) -> DataFrame:
    """One entry of each text of a run, sorted by digest within each of the run's ``segments``."""
    lead = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    dealt = rows.withColumn("segment", F.floor(lead * segments / F.lit(float(1 << 32))).cast("int")).repartition(runs * segments, "run", "segment")
    return dealt.sortWithinPartitions("run", "segment", *KEY).groupBy("run", "segment", *KEY).agg(*entry).drop("segment")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null or empty texts are one text. Among rows of one text the smallest
    identifier stays (null identifiers last); among rows that agree in
    identifier and text exactly one stays. A very long text is a digest after
    the first step. An empty table gives an empty result. Other columns of
    ``docs`` are not read, whatever their names.
    """
    text = normalised(F.col(text_col))
    entries = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    entries = table(entries.sortWithinPartitions(*KEY), "digests")
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    runs, segments = (entries.agg(F.max("run")).first()[0] or 0) + 1, 1
    levels = [merged(entries, runs, segments, F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))]
    leaves = runs
    while runs > 1:
        low = table(levels[-1], "run")
        levels[-1] = low
        runs, segments = -(-runs // fan_in), min(segments * fan_in, leaves)
        up = low.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        levels.append(merged(up, runs, segments, F.min("best").alias("best"), F.sum("n").alias("n")))
    won = levels.pop()
    while levels:
        low = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan_in).cast("int").alias("up"))
        won = low.join(won.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    out = entries.join(won, ["run", *KEY])
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` does not keep; all columns stay."""
    said = exact_duplicates(docs, id_col, text_col, fan_in)
    held = said.groupBy(key_of(F.col(id_col)).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).agg(F.max("kept").alias("_keep"), F.count(F.lit(1)).alias("_keep_n"))
    held = table(held.where("_keep").drop("_keep"), "kept")
    named = docs.withColumns({"_keep_id": key_of(F.col(id_col)), "_keep_sha": F.sha2(normalised(F.col(text_col)), 256)})
    if held.where("_keep_n > 1").isEmpty():
        kept = named.join(held.select("_keep_id", "_keep_sha"), ["_keep_id", "_keep_sha"], "left_semi")
    else:
        kept = named.join(held, ["_keep_id", "_keep_sha"])
        again = kept.where("_keep_n > 1").dropDuplicates(["_keep_id", "_keep_sha"])
        kept = kept.where("_keep_n = 1").unionByName(again)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


