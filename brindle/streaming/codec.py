"""Between the engine's state and the snapshot that outlives it.

The engine keeps a player's state as JSON in Spark's state store. A snapshot
has what must survive a restart: scores, crossed thresholds, the mute and
violation records; buffers of recent messages start anew, as does the time of
the last notice. Both ways are SQL functions over rows of players.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.config import Config
from brindle.streaming import audit

#: A state of :mod:`brindle.plans.fold`; times are microseconds.
STATE = (
    "times array<bigint>, recent array<struct<ts:bigint,canonical:string,clear:string>>, entries array<struct<points:bigint,rule:string,created:bigint,expires:bigint>>, "
    "mute struct<until:bigint,at:bigint,reason:string,rule:string>, "
    "violations array<struct<ts:bigint,seq:bigint,rule_ids:array<string>,categories:array<string>,severity:string,decision:string,points_added:bigint,score_after:bigint,actions:array<string>>>, "
    "crossed array<bigint>, noticed bigint, active bigint"
)
#: Who muted: a rule, or staff.
RULE, STAFF = "automatic", "manual"


def from_checkpoint(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(player_id, state) as the last batch of a stream of :func:`brindle.streaming.processor.evaluate` left it."""
    stored = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    return stored.select(F.col("key.player_id").alias("player_id"), F.col("value.json").alias("state"))


def to_snapshot(states: DataFrame, now: Column, config: Config, names: DataFrame | None = None) -> DataFrame:
    """``states`` (player_id, state) in the columns of a snapshot, as they are kept at ``now``.

    ``names`` (player_id, name) are players' last known names, one each; players
    of whom only a name is known are kept too. Text that is no state is an error.
    """
    s = states.select(F.col("player_id").cast("string").alias("player_id"), F.from_json("state", STATE, {"mode": "FAILFAST"}).alias("s"))
    if names is not None:
        s = s.join(names.select(F.col("player_id").cast("string").alias("player_id"), "name"), "player_id", "full")
    else:
        s = s.withColumn("name", F.lit(""))
    at = F.timestamp_micros
    none = F.lit(None).cast("string")
    m = F.col("s.mute")
    mute = F.struct(
        F.when(m["until"].isNull(), "PERMANENT").otherwise("TEMPORARY").alias("kind"), at(m["at"]).alias("muted_at"), at(m["until"]).alias("muted_until"), m["reason"].alias("reason"),
        F.when(m["rule"].isNull(), STAFF).otherwise(RULE).alias("source"), F.coalesce(m["rule"], F.lit("")).alias("rule_id"), none.alias("moderator_id"),
    )
    entry = lambda e: F.struct(e["points"].alias("points"), e["rule"].alias("rule_id"), at(e["created"]).alias("created_at"), at(e["expires"]).alias("expires_at"))
    record = lambda v: F.struct(
        at(v["ts"]).alias("ts"), *[v[c].alias(c) for c in ("seq", "rule_ids", "categories", "severity", "decision", "points_added", "score_after", "actions")], none.alias("original_message")
    )
    list_ = lambda c, f: F.coalesce(F.transform(c, f), F.array()) if f else F.coalesce(c, F.array().cast("array<bigint>"))
    rows = s.select(
        "player_id", F.coalesce("name", F.lit("")).alias("name"), F.when(m.isNotNull(), mute).alias("mute"),
        list_("s.entries", entry).alias("score_entries"), list_("s.crossed", None).alias("crossed_thresholds"), list_("s.violations", record).alias("violations"),
    )
    return audit.kept(rows, now, config)


def from_snapshot(snapshot: DataFrame, now: Column) -> DataFrame:
    """(player_id, state) that players start from: ``initial`` of the engine. Scores and mutes that have expired by ``now`` are left out."""
    at = F.unix_micros
    m = F.col("mute")
    live = (m["kind"] == "PERMANENT") | (m["muted_until"] > now)
    rule = F.when(m["rule_id"] != "", m["rule_id"])
    mute = F.struct(F.when(m["kind"] != "PERMANENT", at(m["muted_until"])).alias("until"), at(m["muted_at"]).alias("at"), m["reason"].alias("reason"), rule.alias("rule"))
    entry = lambda e: F.struct(e["points"].alias("points"), e["rule_id"].alias("rule"), at(e["created_at"]).alias("created"), at(e["expires_at"]).alias("expires"))
    record = lambda v: F.struct(at(v["ts"]).alias("ts"), *[v[c].alias(c) for c in ("seq", "rule_ids", "categories", "severity", "decision", "points_added", "score_after", "actions")])
    none = F.lit(None).cast("bigint")
    state = F.struct(
        F.array().cast("array<bigint>").alias("times"), F.array().cast("array<bigint>").alias("recent"), F.transform(F.filter("score_entries", lambda e: e["expires_at"] > now), entry).alias("entries"),
        F.when(m.isNotNull() & live, mute).alias("mute"), F.transform("violations", record).alias("violations"), F.col("crossed_thresholds").alias("crossed"), none.alias("noticed"), at(now).alias("active"),
    )
    return snapshot.select("player_id", F.to_json(state, {"ignoreNullFields": "false"}).alias("state"))


def checked(snapshot: DataFrame, config: Config) -> DataFrame:
    """``snapshot``, if it has each player once, players and entries up to the configured maxima; else an error.

    An action looks at it first: restoring half of a snapshot would lose the rest at the next write.
    """
    most, entries, records = config.state["maximum_tracked_players"], config.state["maximum_score_entries_per_player"], config.history["maximum_entries_per_player"]
    by = snapshot.groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("score_entries")).alias("e"), F.max(F.size("violations")).alias("v"))
    players, n, e, v, lost = by.agg(F.count(F.lit(1)), F.max("n"), F.max("e"), F.max("v"), F.count_if(F.col("player_id").isNull())).first()
    problems = [("a player without id", lost), ("a player twice", players and n > 1), (f"more than {most} players", players > most)]
    problems += [(f"more than {entries} score entries of a player", players and e > entries), (f"more than {records} records of a player", players and v > records)]
    if found := [p for p, bad in problems if bad]:
        raise ValueError("the snapshot has " + ", ".join(found))
    return snapshot


def save(states: DataFrame, path: str, now: Column, config: Config, names: DataFrame | None = None) -> None:
    """Writes the snapshot of ``states``; the one before becomes the backup."""
    audit.write_snapshot(to_snapshot(states, now, config, names), path, purge_backup=not config.logging["store_original_messages"])


def restore(spark: SparkSession, path: str, now: Column, config: Config, version: int = 2) -> DataFrame:
    """(player_id, state) from a snapshot or its backup; none where there is neither."""
    return from_snapshot(checked(audit.restored(spark, path, version, now), config), now)
