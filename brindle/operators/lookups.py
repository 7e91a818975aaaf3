"""Lookups of related data, as joins.

Small sides are left to Spark, which broadcasts what it knows to be small and
otherwise shuffles both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Permission node: categories that it lets pass.
BYPASS = {
    "bypass.spam": ("SPAM", "DUPLICATE", "SIMILARITY", "FLOODING"),
    "bypass.filters": ("FILTERED_CONTENT",),
    "bypass.advertising": ("ADVERTISING",),
    "bypass.security": ("SECURITY",),
}


def permission(requests: DataFrame, explicit: DataFrame, level: int, fallback: bool = True) -> DataFrame:
    """(player_id, node, operator_level) requests: an explicit value, else the operator's level, else denied; and why."""
    out = requests.join(explicit.select("player_id", "node", F.col("value").alias("explicit")), ["player_id", "node"], "left")
    op = F.lit(fallback) & (F.coalesce("operator_level", F.lit(0)) >= level)
    return out.withColumns({"allowed": F.coalesce("explicit", op), "origin": F.when(F.col("explicit").isNotNull(), "PROVIDER").when(op, "OPERATOR").otherwise("DENIED")}).drop("explicit")


def bypass(players: DataFrame, explicit: DataFrame, level: int = 4, operators: bool = False) -> DataFrame:
    """(player_id, operator_level) and explicit (player_id, node, value) to (player_id, bypass_all, bypass).

    A node holds by its explicit value (of several a denial wins), else for
    operators of the level, if they bypass at all. ``bypass`` is empty where
    everything is bypassed.
    """
    nodes = ("bypass.all", *BYPASS)
    said = explicit.groupBy("player_id").agg(*[F.min(F.when(F.col("node") == n, F.col("value"))).alias(n) for n in nodes])
    out = players.join(said, "player_id", "left")
    op = F.lit(operators) & (F.coalesce("operator_level", F.lit(0)) >= level)
    holds = lambda n: F.coalesce(F.col(f"`{n}`"), op)
    none = F.array().cast("array<string>")
    cats = F.flatten(F.array(*[F.when(holds(n), F.array(*[F.lit(c) for c in c_])).otherwise(none) for n, c_ in BYPASS.items()]))
    return out.select("player_id", holds("bypass.all").alias("bypass_all"), F.when(holds("bypass.all"), none).otherwise(F.array_sort(cats)).alias("bypass"))


#: How an identifier is written.
UUID = r"(?i)^[0-9a-f]{1,8}(-[0-9a-f]{1,4}){3}-[0-9a-f]{1,12}$"


def target(queries: DataFrame, online: DataFrame, known: DataFrame, id_pattern: str = UUID) -> DataFrame:
    """(q): a player by online name, else by id, known or not, else by the last known name, case aside; and their name."""
    first = lambda rows, key, as_: rows.groupBy(key.alias("_k")).agg(F.min(F.struct("player_id", "name")).alias(as_))
    out = queries.withColumn("_k", F.col("q")).join(first(online, F.col("name"), "live"), "_k", "left")
    out = out.join(first(known, F.col("player_id").cast("string"), "stored"), "_k", "left").withColumn("_k", F.lower("q")).join(first(known, F.lower("name"), "last"), "_k", "left")
    is_id = F.rlike("q", F.lit(id_pattern))
    player = F.coalesce(F.col("live.player_id").cast("string"), F.when(is_id, F.col("q")), F.col("last.player_id").cast("string"))
    stored = F.when(F.trim("stored.name") != "", F.col("stored.name"))
    name = F.coalesce(F.col("live.name"), F.when(is_id, F.coalesce(stored, F.col("q"))), F.col("last.name"))
    return out.select("q", player.alias("player_id"), name.alias("name"))


def muted(messages: DataFrame, mutes: DataFrame, how: str = "left_anti") -> DataFrame:
    """Messages outside (``left_anti``) or inside (``left_semi``) of their player's mutes: muted_at <= ts < muted_until,
    without an end for ever.

    A message is muted if the latest end of the mutes that have begun is after
    it, so one window over messages and mutes in order of time does, and no
    message meets every mute of its player.
    """
    begun = mutes.select("player_id", F.col("muted_at").alias("_at"), F.coalesce("muted_until", F.lit("9999-12-31 00:00:00").cast("timestamp")).alias("_until"), F.lit(False).alias("_said"))
    said = messages.withColumns({"_at": F.col("ts"), "_said": F.lit(True)})
    by = Window.partitionBy("player_id").orderBy("_at", "_said").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = said.unionByName(begun, allowMissingColumns=True).withColumn("_end", F.max("_until").over(by)).where("_said")
    inside = F.coalesce(F.col("_end") > F.col("ts"), F.lit(False))
    return out.where(inside if how == "left_semi" else ~inside).select(*messages.columns)


def alert_recipients(alerts: DataFrame, staff: DataFrame, most: int = 10_000) -> DataFrame:
    """Every alert to everyone online who may see alerts; the original only to those who may inspect, if configured.

    What comes out is a row per alert and recipient by nature. The recipients
    are one array, of checked size, that goes along with the alerts.
    """
    to = staff.where("online and alerts").select("player_id", "inspect")
    n = to.count()
    if n > most:
        raise ValueError(f"{n} recipients of alerts, where {most} are the most")
    who = to.agg(F.array_sort(F.collect_list(F.struct(F.col("player_id").alias("recipient"), "inspect"))).alias("_who"))
    out = alerts.join(F.broadcast(who)).select("*", F.explode("_who").alias("_to")).select(*alerts.columns, "_to.recipient", "_to.inspect")
    return out.withColumn("original", F.when(F.col("inspect") & F.col("show_original"), F.col("original"))).drop("inspect", "show_original")


def authorised(user: Column, roles: Column, users: Iterable[str], allowed_roles: Iterable[str]) -> Column:
    """The user is named, or has one of the roles."""
    names = F.array(*[F.lit(u) for u in users]).cast("array<string>")
    return F.coalesce(F.array_contains(names, user), F.lit(False)) | F.coalesce(F.arrays_overlap(roles, F.array(*[F.lit(r) for r in allowed_roles]).cast("array<string>")), F.lit(False))
