"""Message views over the driver's tables, with their DuckDB twins.

A message has player_id, seq (order within a player), ts and raw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, where a scan has fewer: a row group is not split, however dear its rows are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per non-blank line of a document, 1.5 s apart; by position some are disguised or sent in a burst."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    seq = F.col("pos") + 1
    raw = (
        F.when(seq % 7 == 0, F.translate("line", "oeast", "034$7"))
        .when(seq % 11 == 0, F.concat("line", F.lit(" example"), F.col("doc_id").cast("string"), F.lit(" dot com")))
        .when(seq % 13 == 0, F.concat("line", F.lit(" shop[.]net")))
        .when(seq % 17 == 0, F.concat("line", F.lit("zzzzzzzzz")))
        .when(seq % 19 == 0, F.concat(F.substring("line", 1, 3), F.lit("​"), F.substr("line", F.lit(4))))
        .when(seq % 23 == 0, F.upper(F.replace("line", F.lit("ß"), F.lit("ss"))))
        .otherwise(F.col("line"))
    )
    millis = F.col("doc_id") * 3_600_000 + seq * 1_500 - F.when(seq % 5 == 0, 1_200).otherwise(0)
    ts = F.timestamp_millis(millis + F.lit(1_704_067_200_000))
    return docs.where(F.length(F.trim("line")) > 0).select(F.col("doc_id").alias("player_id"), seq.cast("long").alias("seq"), ts.alias("ts"), raw.alias("raw"))


#: The same in DuckDB, as the common table ``m``; ``ms`` is ts in milliseconds.
MESSAGES_SQL = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents),
m AS (
  SELECT doc_id AS player_id, seq::BIGINT AS seq,
    doc_id * 3600000 + seq * 1500 - CASE WHEN seq % 5 = 0 THEN 1200 ELSE 0 END + 1704067200000 AS ms,
    CASE WHEN seq % 7 = 0 THEN translate(line, 'oeast', '034$7')
         WHEN seq % 11 = 0 THEN line || ' example' || doc_id || ' dot com'
         WHEN seq % 13 = 0 THEN line || ' shop[.]net'
         WHEN seq % 17 = 0 THEN line || 'zzzzzzzzz'
         WHEN seq % 19 = 0 THEN line[1:3] || chr(8203) || line[4:]
         WHEN seq % 23 = 0 THEN upper(replace(line, 'ß', 'ss'))
         ELSE line END AS raw
  FROM l WHERE length(trim(line)) > 0)
"""


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per turn, 2 s apart, with its role."""
    ts = F.timestamp_millis(F.col("conv_id") * 3_600_000 + F.col("turn") * 2_000 + F.lit(1_704_067_200_000))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("player_id"), F.col("turn").alias("seq"), ts.alias("ts"), F.col("text").alias("raw"), "role")


CONVERSATIONS_SQL = """
m AS (SELECT conv_id AS player_id, turn AS seq, conv_id * 3600000 + turn * 2000 + 1704067200000 AS ms, text AS raw, role FROM conversations)
"""
