"""Violations: records, history pages, active entries, retention, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.plans.windowed import severity


def violations(evaluated: DataFrame, store_original: bool = False) -> DataFrame:
    """A record for each message with a match, one of 0 points too; ids are derived, not drawn."""
    original = text.sanitize_stored(F.col("raw")) if store_original else F.lit(None).cast("string")
    return evaluated.where(F.size("matches") > 0).select(
        F.sha2(F.concat_ws(":", "player_id", "seq", F.unix_micros("ts")), 256).alias("event_id"),
        "player_id", "seq", "ts",
        F.transform("matches", lambda m: m["rule_id"]).alias("rule_ids"),
        F.array_distinct(F.transform("matches", lambda m: m["category"])).alias("categories"),
        severity(F.col("matches")).alias("severity"),
        "decision", "points_added", F.col("points_after").alias("score_after"),
        F.array_distinct(F.transform("actions", lambda a: a["type"])).alias("actions"),
        original.alias("original_message"),
    )


def retained(records: DataFrame, now: Column, days: int, most: int) -> DataFrame:
    """The newest ``most`` records of each player, of the last ``days`` (inclusive), newest first by ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.col("ts").desc(), F.col("seq").desc()))
    return records.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))).withColumn("place", place).where(F.col("place") <= most)


def page(retained_records: DataFrame, number: Column, size: int, clamp: bool) -> DataFrame:
    """One page of each player's records, with the player's totals.

    ``clamp``: a page past either end becomes the nearest one; otherwise it is empty.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy("player_id"))
    out = retained_records.withColumn("total_entries", total).withColumn("total_pages", F.greatest(F.ceil(F.col("total_entries") / size), F.lit(1)).cast("long"))
    at = F.least(F.greatest(number, F.lit(1)), F.col("total_pages")) if clamp else number
    out = out.withColumn("page", at.cast("long"))
    return out.where((F.col("place") > (F.col("page") - 1) * size) & (F.col("place") <= F.col("page") * size))


def active_entries(evaluated: DataFrame, now: Column, decay_seconds: int) -> DataFrame:
    """Score entries that have not expired at ``now``, newest first by ``place``, with each player's running total."""
    live = evaluated.where("points_added > 0").where((F.col("ts") <= now) & (F.col("ts") + F.make_dt_interval(secs=F.lit(decay_seconds)) > now))
    by = Window.partitionBy("player_id")
    return live.select("player_id", "seq", "ts", "points_added", F.least(F.sum("points_added").over(by), F.lit(2_147_483_647)).alias("active_score"), F.row_number().over(by.orderBy(F.col("ts").desc(), F.col("seq").desc())).alias("place"))


def most_entries(evaluated: DataFrame, now: Column, decay_seconds: int) -> DataFrame:
    """The most unexpired entries that a player has: the floor for a reloaded limit."""
    counts = active_entries(evaluated, now, decay_seconds).groupBy("player_id").count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0)).alias("most_entries"))


def active_page(entries: DataFrame, states: DataFrame, now: Column, number: Column, size: int = 6) -> DataFrame:
    """A page of each player's active score entries (player_id, rule_id, points, created, expires), newest first, with the
    total score, the mute that stands (muted_until: null for ever) and the thresholds crossed of ``states``."""
    by = Window.partitionBy("player_id")
    live = entries.where(F.col("expires") > now)
    place = F.row_number().over(by.orderBy(F.col("created").desc(), "rule_id"))
    out = page(live.withColumns({"place": place, "score": F.sum("points").over(by)}), number, size, clamp=True)
    out = out.join(states.select("player_id", "muted", "muted_until", "crossed"), "player_id", "left")
    stands = F.coalesce(F.col("muted") & (F.col("muted_until").isNull() | (F.col("muted_until") > now)), F.lit(False))
    return out.withColumns({"muted": stands, "muted_until": F.when(stands, F.col("muted_until")), "crossed": F.array_sort(F.coalesce("crossed", F.array().cast("array<bigint>")))})


def crossed(after: Column, thresholds) -> Column:
    """The thresholds that a score has reached, ascending."""
    return F.filter(F.array(*[F.lit(t) for t in sorted(thresholds)]).cast("array<bigint>"), lambda t: t <= after)


def preview(values: Column, most: int = 20) -> Column:
    """What a preview shows of matches, prevented matches or actions."""
    return F.slice(values, 1, most)


def status(players: DataFrame, config) -> DataFrame:
    """One row: players tracked, filters active."""
    return players.agg(F.count_distinct("player_id").alias("tracked_players")).withColumn("active_filters", F.lit(sum(f.rule.enabled for f in config.filters)))


def suggest_names(players: DataFrame, prefix: str) -> DataFrame:
    """Distinct non-blank names with a prefix, case aside, in case-free order."""
    names = players.select("name").where(F.trim("name") != "").distinct()
    return names.where(F.startswith(F.lower("name"), F.lit(prefix.lower()))).orderBy(F.lower("name"), "name")


def evict_oldest(players: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` players to evict: not durable, longest idle, then by id as text."""
    return players.where("not durable").orderBy("last_activity", F.col("player_id").cast("string")).limit(n)


def admitted(players: DataFrame, arriving: DataFrame, most: int) -> DataFrame:
    """Which of ``arriving`` (player_id, ts) are admitted where at most ``most`` players (player_id, last_activity, durable) are tracked.

    Known players are. New ones take the free places in order of arrival, then
    those of players that may be evicted; the others are refused, which blocks
    their message. What is ranked is as many new players as there are places.
    """
    tracked, spare = players.agg(F.count(F.lit(1)), F.count_if(~F.col("durable"))).first()
    new = arriving.groupBy("player_id").agg(F.min("ts").alias("ts")).join(players.select("player_id"), "player_id", "left_anti")
    won = new.orderBy("ts", F.col("player_id").cast("string")).limit(max(most - tracked, 0) + spare).select("player_id", F.lit(True).alias("admitted"))
    new = new.join(won, "player_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    known = arriving.select("player_id").distinct().join(players.select("player_id"), "player_id", "left_semi")
    return known.withColumn("admitted", F.lit(True)).unionByName(new.select("player_id", "admitted"))
