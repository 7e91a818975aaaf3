"""Sinks: daily audit files with retention, and state snapshots with a backup."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.plans.config import Config


def audit_rows(records: DataFrame) -> DataFrame:
    """Violation records with the UTC day that partitions the log, and the kind of event."""
    return records.withColumns({"event_type": F.lit("violation"), "event_date": F.to_date("ts")})


def action_rows(actions: DataFrame) -> DataFrame:
    """Staff actions (case_id, ts, player_id, player_name, action, duration_seconds, reason, rule_ids, moderator_source,
    moderator_id, moderator_name, success, result) as events of the same log."""
    clean = lambda c: text.sanitize_stored(F.coalesce(F.col(c).cast("string"), F.lit("")))
    said = {c: clean(c) for c in ("case_id", "player_name", "reason", "moderator_source", "moderator_id", "moderator_name", "result")}
    rules = F.transform(F.coalesce("rule_ids", F.array().cast("array<string>")), text.sanitize_stored)
    return actions.withColumns({**said, "rule_ids": rules, "event_type": F.lit("moderation_action"), "event_date": F.to_date("ts")})


def append_audit(records: DataFrame, path: str) -> None:
    """Appends JSON lines, one folder for each day. Nothing is dropped under load: a stream waits instead."""
    audit_rows(records).write.mode("append").partitionBy("event_date").json(path)


def stream_audit(records: DataFrame, path: str, checkpoint: str):
    """The same for a stream. A micro-batch has folders of its own, which a retry of it replaces: it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = audit_rows(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").json(path)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def delete_expired(spark: SparkSession, path: str, today: date, days: int) -> list[str]:
    """Deletes the folders of days before ``today`` - ``days`` (one at least); returns their names. Others are left alone."""
    fs, at = _files(spark, path)
    gone = []
    for status in fs.listStatus(at(path)) if fs.exists(at(path)) else []:
        name = status.getPath().getName()
        m = re.fullmatch(r"event_date=(\d{4}-\d{2}-\d{2})", name)
        if m and status.isDirectory() and date.fromisoformat(m[1]) < today - timedelta(days=max(1, days)):
            if not fs.delete(status.getPath(), True):
                raise OSError(f"cannot delete {status.getPath()}")
            gone.append(name)
    return sorted(gone)


def retained_days(log: DataFrame, today: Column, days: int) -> DataFrame:
    """Rows of days that are not before ``today`` - ``days``; a predicate on the partition alone."""
    return log.where(F.col("event_date") >= F.date_sub(today, days))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that all executors share; a local one only where none is named and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="brindle-")
    return f"{base.rstrip('/')}/brindle-{name}-{uuid.uuid4().hex[:12]}"


def write_snapshot(states: DataFrame, path: str, purge_backup: bool = False) -> None:
    """States by player id. The snapshot before becomes the backup; Spark's commit makes the new one whole or absent.

    ``purge_backup``: no older snapshot stays, as where messages are no longer to be kept.
    """
    spark = states.sparkSession
    fs, at = _files(spark, path)
    new, backup = at(f"{path}.new"), at(f"{path}.backup")

    def move(source, target) -> None:
        if not fs.rename(source, target):
            raise OSError(f"cannot rename {source} to {target}")

    states.orderBy("player_id").write.mode("overwrite").json(f"{path}.new")
    if fs.exists(at(path)):
        fs.delete(backup, True)
        move(at(path), backup)
    move(new, at(path))
    if purge_backup:
        fs.delete(backup, True)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot, else its backup, else none: whichever is there and reads whole.

    Only absence and damage lead to the next place. That a place cannot be
    reached is an error: an empty state would be written over what is there.
    """
    fs, at = _files(spark, path)
    damaged = []
    for place in (path, f"{path}.backup"):
        if not fs.exists(at(place)):
            continue
        found = spark.read.schema(schema).option("mode", "FAILFAST").json(place)
        try:
            found.agg(*[F.count(c) for c in found.columns]).collect()
            return found
        except (PySparkException, Py4JJavaError) as e:
            if "MALFORMED_RECORD" not in str(e) and "FAILED_READ_FILE" not in str(e):
                raise
            damaged.append(place)
    if damaged:
        warnings.warn(f"no snapshot reads whole: {', '.join(damaged)}", stacklevel=2)
    return spark.createDataFrame([], schema)


#: A player's state as it is kept, of the present version.
SNAPSHOT = (
    "player_id string, name string, mute struct<kind:string,muted_at:timestamp,muted_until:timestamp,reason:string,source:string,rule_id:string,moderator_id:string>, "
    "score_entries array<struct<points:bigint,rule_id:string,created_at:timestamp,expires_at:timestamp>>, crossed_thresholds array<bigint>, "
    "violations array<struct<ts:timestamp,seq:bigint,rule_ids:array<string>,categories:array<string>,severity:string,decision:string,points_added:bigint,score_after:bigint,actions:array<string>,original_message:string>>"
)


def kept(states: DataFrame, now: Column, config: Config) -> DataFrame:
    """``states`` (columns of SNAPSHOT) as they are kept: without expired scores, mutes and old records, the newest records
    only, originals only if configured; players of whom nothing is left, not even a name, are left out.

    More entries than the configured maximum are an error, as they cannot have been admitted.
    """
    most, days = config.history["maximum_entries_per_player"], config.history["retention_days"]
    scores = F.filter("score_entries", lambda e: e["expires_at"] > now)
    limit = config.state["maximum_score_entries_per_player"]
    scores = F.when(F.size(scores) > limit, F.raise_error(F.lit(f"more than {limit} score entries of a player"))).otherwise(scores)
    recent = F.filter("violations", lambda v: v["ts"] >= now - F.make_dt_interval(days=F.lit(days)))
    recent = F.slice(recent, F.greatest(F.size(recent) - most + 1, F.lit(1)), most)
    if not config.logging["store_original_messages"]:
        recent = F.transform(recent, lambda v: v.withField("original_message", F.lit(None).cast("string")))
    mute = F.when((F.col("mute.kind") == "PERMANENT") | (F.col("mute.muted_until") > now), F.col("mute"))
    out = states.withColumns({"score_entries": scores, "crossed_thresholds": F.array_sort("crossed_thresholds"), "mute": mute, "violations": recent})
    some = F.col("mute").isNotNull() | (F.size("score_entries") > 0) | (F.size("crossed_thresholds") > 0) | (F.size("violations") > 0) | (F.trim("name") != "")
    return out.where(some).select(*[f.name for f in out.schema]).orderBy("player_id")


def copied(states: DataFrame, schema: str) -> DataFrame:
    """``states`` through the text of a snapshot and back, as a file would hold them."""
    return states.select(F.to_json(F.struct("*")).alias("line")).select(F.from_json("line", schema).alias("s")).select("s.*")


def restored(spark: SparkSession, path: str, version: int, now: Column, saved_at: Column | None = None) -> DataFrame:
    """States of a kept file of version 1 or 2. Version 1 has timed mutes only (until, reason, source), begun when it was saved at the latest."""
    if version == 2:
        return read_snapshot(spark, path, SNAPSHOT)
    if version != 1:
        raise ValueError(f"unsupported version of kept states: {version}")
    old = SNAPSHOT.replace("mute struct<kind:string,muted_at:timestamp,muted_until:timestamp,reason:string,source:string,rule_id:string,moderator_id:string>", "mute struct<muted_until:timestamp,reason:string,source:string>")
    rows = read_snapshot(spark, path, old)
    begun = F.least(F.coalesce(saved_at, now) if saved_at is not None else now, now)
    mute = F.struct(F.lit("TEMPORARY").alias("kind"), begun.alias("muted_at"), F.col("mute.muted_until"), F.col("mute.reason"), F.col("mute.source"), F.lit("").alias("rule_id"), F.lit(None).cast("string").alias("moderator_id"))
    return rows.withColumn("mute", F.when(F.col("mute.muted_until") > now, mute))
