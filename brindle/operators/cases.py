"""Alert cases: opened, claimed once, resolved, expired; and the routing of clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text

#: Actions of a click by its code. Fixed values.
CLICKS = {"m10": "MUTE_10_MINUTES", "m60": "MUTE_1_HOUR", "ban": "BAN", "dismiss": "DISMISS"}


def lifecycle(cases: DataFrame, clicks: DataFrame, now: Column) -> DataFrame:
    """The state of each case (case_id, opened_at, expires_at) after its clicks (case_id, ts, seq, user_id, action, outcome).

    The first click, by (ts, seq), on an open case that has not expired claims
    it. A claim whose action fails in a way that may be retried reopens the
    case, so the next click claims it. Outcomes: ok, retry, failed, and null
    while the action runs, when the case is PROCESSING.
    """
    c = clicks.join(cases.select("case_id", "opened_at", "expires_at"), "case_id").where((F.col("ts") >= F.col("opened_at")) & (F.col("ts") < F.col("expires_at")))
    # All clicks before the first one that settles, or still runs, have been retried.
    settling = c.where("outcome is null or outcome <> 'retry'")
    first = settling.groupBy("case_id").agg(F.min(F.struct("ts", "seq", "user_id", "action", "outcome")).alias("w"))
    tried = c.join(first, "case_id", "left").where(F.col("w").isNull() | (F.struct("ts", "seq") <= F.struct("w.ts", "w.seq"))).groupBy("case_id").agg(F.count(F.lit(1)).alias("attempts"))
    out = cases.join(first, "case_id", "left").join(tried, "case_id", "left")
    status = (
        F.when(F.col("w").isNotNull() & F.col("w.outcome").isNull(), "PROCESSING")
        .when(F.col("w.outcome") == "failed", "FAILED")
        .when(F.col("w.action") == "DISMISS", "DISMISSED")
        .when(F.col("w").isNotNull(), "RESOLVED")
        .when(F.col("expires_at") <= now, "EXPIRED")
        .otherwise("OPEN")
    )
    closed = F.when(F.col("w.outcome").isNotNull(), F.col("w.ts"))
    return out.select("case_id", status.alias("status"), F.col("w.user_id").alias("claimed_by"), closed.alias("closed_at"), "expires_at", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def purged(states: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cases without those that were closed, or expired, more than ``days`` ago."""
    running = F.col("status").isin("OPEN", "PROCESSING")
    return states.where(running | (F.coalesce("closed_at", "expires_at") >= now - F.make_dt_interval(days=F.lit(days))))


def open_count(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("status").isin("OPEN", "PROCESSING")).alias("open_cases"))


def route(clicks: DataFrame, guild: str, channel: str, allowed: Column, enabled: tuple[str, ...] = tuple(CLICKS)) -> DataFrame:
    """What happens to a click, by the first check that it fails, in a column ``outcome``.

    Columns: ready, guild_id, channel_id, custom_id, message_id, and of the case that it names case_status (null: unknown)
    and case_message_id. ``enabled`` are the codes of actions that are switched on.
    """
    parts = F.split("custom_id", ":")
    code = F.get(parts, F.lit(2))
    known = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "cam") & F.rlike(F.get(parts, F.lit(1)), F.lit("^[A-Za-z0-9_-]{8,64}$")) & code.isin(*CLICKS)
    sure = lambda c: F.coalesce(c, F.lit(False))
    outcome = (
        F.when(~sure(F.col("ready")), "NOT_READY")
        .when(~sure(F.col("guild_id") == guild), "WRONG_GUILD")
        .when(~sure(F.col("channel_id") == channel), "WRONG_CHANNEL")
        .when(~sure(F.startswith("custom_id", F.lit("cam:"))), "IGNORED")
        .when(~sure(known), "MALFORMED")
        .when(~sure(allowed), "UNAUTHORISED")
        .when(~code.isin(*enabled), "ACTION_DISABLED")
        .when(F.col("case_status").isNull(), "UNKNOWN_CASE")
        .when(F.col("case_status") == "EXPIRED", "EXPIRED")
        .when(F.col("case_status") != "OPEN", "NOT_OPEN")
        .when(~sure(F.col("case_message_id") == F.col("message_id")), "MESSAGE_MISMATCH")
        .otherwise("CLAIMED")
    )
    return clicks.withColumn("outcome", outcome)


def banned(bans: DataFrame, requests: DataFrame) -> DataFrame:
    """``bans`` (player_id, banned_at, source, reason) and those of ``requests`` (player_id, ts, seq, moderator, moderator_id,
    reason): a player who is banned already stays so, of several requests the first counts."""
    one = F.min(F.struct("ts", "seq", "moderator", "moderator_id", "reason")).alias("r")
    new = requests.join(bans.select("player_id"), "player_id", "left_anti").groupBy("player_id").agg(one)
    source = text.bounded(F.concat("r.moderator", F.lit(" (Discord "), F.col("r.moderator_id").cast("string"), F.lit(")")), 256)
    return bans.unionByName(new.select("player_id", F.col("r.ts").alias("banned_at"), source.alias("source"), text.bounded(F.col("r.reason"), 256).alias("reason")))


def first_claims(events: DataFrame) -> DataFrame:
    """The winning claim of each case, by (ts, seq)."""
    w = Window.partitionBy("case_id").orderBy("ts", "seq")
    return events.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
