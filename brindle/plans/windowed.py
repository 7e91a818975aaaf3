"""The windowed tier: every message judged by SQL functions and windows alone.

Detection depends on earlier messages, never on scores, unless an action mutes.
Without mutes all state is a window over (player, ts, seq): one exchange and one
sort serve every frame. Configurations that mute need the stateful tier.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import detectors, filters
from brindle.operators.detectors import ACTION, MATCH, actions_literal
from brindle.plans.config import SEVERITIES, Config

INT_MAX = 2_147_483_647


def mutes(config: Config) -> bool:
    rules = [*config.rules.values(), *(f.rule for f in config.filters)]
    everything = [a for r in rules if r.enabled for a in r.actions] + [a for _, actions in config.thresholds for a in actions]
    return any(a.type == "MUTE" for a in everything)


def stateless(messages: DataFrame, config: Config) -> DataFrame:
    """Text forms and the matches of detectors that look at one message."""
    out = filters.with_filters(detectors.with_forms(messages, config), config)
    out = out.withColumns({"m_length": detectors.message_length(config), "m_caps": detectors.caps(config), "m_runs": detectors.repeated_characters(config)})
    return detectors.with_advertising(out, config)


def dedupe(matches: Column) -> Column:
    """The first match of each rule, order kept."""
    empty = F.array().cast(f"array<{MATCH}>")
    return F.aggregate(matches, empty, lambda a, m: F.when(F.exists(a, lambda x: x["rule_id"] == m["rule_id"]), a).otherwise(F.concat(a, F.array(m))))


def with_matches(messages: DataFrame, config: Config) -> DataFrame:
    """Adds ``matches``, in the detectors' fixed order, less what a ``bypass`` column (array of categories) lets pass."""
    out = detectors.similar_recent(detectors.with_history(stateless(messages, config), config), config)
    return joined(out, detectors.duplicate(config), detectors.rapid(config), detectors.similarity_match(config))


def joined(out: DataFrame, duplicate: Column, rapid: Column, similarity: Column) -> DataFrame:
    """Adds ``matches`` to rows with stateless matches, from those and the three that look back."""
    one = lambda m: F.array(m)
    parts = [one(F.col("m_length")), one(F.col("m_caps")), one(F.col("m_runs")), one(duplicate), one(rapid), one(similarity), F.col("filtered"), F.col("m_ads")]
    found = F.array_compact(F.concat(*parts))
    if "bypass" in out.columns:
        found = F.filter(found, lambda m: ~F.array_contains("bypass", m["category"]))
        shown = ~F.array_contains("bypass", "FILTERED_CONTENT")
        out = out.withColumn("prevented", F.when(shown, F.col("prevented")).otherwise(F.array().cast(out.schema["prevented"].dataType)))
        found = F.filter(found, lambda m: shown | ~F.startswith(m["evidence"], F.lit("filtered ")))
    return out.withColumn("matches", dedupe(found)).drop("m_length", "m_caps", "m_runs", "m_ads", "filtered", "similar", "last_ts")


def contributions(matches: Column, cap: int | Column) -> Column:
    """What each match is awarded: its points, as far as the message's cap allows."""
    start = F.struct(F.array().cast("array<bigint>").alias("got"), F.lit(cap).cast("long").alias("left"))

    def add(state: Column, m: Column) -> Column:
        award = F.least(m["points"], state["left"])
        return F.struct(F.when(award > 0, F.concat(state["got"], F.array(award))).otherwise(state["got"]).alias("got"), (state["left"] - award).alias("left"))

    return F.aggregate(matches, start, add, lambda s: s["got"])


def with_score(messages: DataFrame, config: Config) -> DataFrame:
    """Adds points_added, points_before, points_after: entries count until ``decay`` after their message, exclusively.

    A RANGE frame would take later rows of the same instant too, so it ends
    before the instant, and a second frame adds the instant's earlier rows.
    """
    decay = config.decay_seconds * 1_000_000
    out = messages.withColumns({"points_added": F.aggregate(contributions(F.col("matches"), config.cap), F.lit(0).cast("long"), lambda a, x: a + x), "_us": F.unix_micros("ts")})
    older = Window.partitionBy(*detectors.player(messages)).orderBy("_us").rangeBetween(-(decay - 1), -1)
    same = Window.partitionBy(*detectors.player(messages), "_us").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("points_added").over(older), F.lit(0)) + F.coalesce(F.sum("points_added").over(same), F.lit(0))
    out = out.withColumn("points_before", F.least(before, F.lit(INT_MAX)))
    return out.withColumn("points_after", F.least(F.col("points_before") + F.col("points_added"), F.lit(INT_MAX))).drop("_us")


def crossing(before: Column, after: Column, thresholds: Iterable[int]) -> Column:
    """The highest threshold with before < threshold <= after."""
    every = F.array(*[F.lit(t) for t in thresholds]).cast("array<bigint>")
    return F.array_max(F.filter(every, lambda t: (before < t) & (t <= after)))


def severity(matches: Column) -> Column:
    rank = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.get(rank, F.coalesce(F.array_max(F.transform(matches, lambda m: (F.array_position(rank, m["severity"]) - 1).cast("int"))), F.lit(0)))


def planned(matches: Column, threshold_actions: Column) -> Column:
    """Actions of matches, then of the threshold, without repeats: warnings, kicks and commands as configured, the
    strongest mute (permanent, else longest), one staff notice."""
    every = F.array_distinct(F.concat(F.flatten(F.transform(matches, lambda m: m["actions"])), threshold_actions))
    plain_ = F.filter(every, lambda a: F.array_contains(F.array(F.lit("WARN"), F.lit("KICK"), F.lit("EXECUTE_COMMAND")), a["type"]))
    mute = F.filter(every, lambda a: a["type"] == "MUTE")
    permanent = F.filter(mute, lambda a: a["seconds"].isNull())
    longest = F.array_max(F.transform(mute, lambda a: a["seconds"]))
    timed = F.filter(mute, lambda a: a["seconds"] == longest)
    # The last permanent one replaces those before it; of equal mutes the first stays.
    strongest = F.when(F.size(permanent) > 0, F.slice(permanent, -1, 1)).when(F.size(timed) > 0, F.slice(timed, 1, 1)).otherwise(F.array().cast(f"array<{ACTION}>"))
    notice = F.filter(every, lambda a: a["type"] == "NOTIFY_STAFF")
    return F.concat(plain_, strongest, F.slice(notice, 1, 1))


def with_actions(messages: DataFrame, config: Config) -> DataFrame:
    """Adds threshold_crossed, decision, severity and actions."""
    out = messages.withColumn("threshold_crossed", crossing(F.col("points_before"), F.col("points_after"), [t for t, _ in config.thresholds]))
    of = F.array().cast(f"array<{ACTION}>")
    for t, actions in config.thresholds:
        of = F.when(F.col("threshold_crossed") == t, actions_literal(actions)).otherwise(of)
    decision = F.when(F.exists("matches", lambda m: m["block"]), F.lit("BLOCK")).otherwise(F.lit("ALLOW"))
    return out.withColumns({"decision": decision, "severity": severity(F.col("matches")), "actions": planned(F.col("matches"), of)})


def lookback(config: Config) -> int:
    """The seconds that rules look back."""
    dup, sim, rapid = (config.rules[k] for k in ("duplicate_spam", "similarity_spam", "rapid_spam"))
    return max(dup.duplicate_window_seconds, sim.window_seconds, rapid.window_seconds, -(-rapid.minimum_interval_ms // 1000))


def sliced(messages: DataFrame, reach: int, seconds: int) -> DataFrame:
    """``messages`` by slices of time: each row in its own, and once more (``_carried``) in those that it reaches into.

    No rule looks further back than its window, and no score than the decay,
    before which a row's points need its own windows. A row is thus carried
    over ``reach``, decay and window; with slices of some multiple of that a
    player with very many messages is as many tasks as slices, for few rows more.
    """
    reach = (reach + 1) * 1_000_000
    us, size = F.unix_micros("ts"), seconds * 1_000_000
    own = F.floor(us / F.lit(size))
    out = messages.withColumn(detectors.SLICE, F.explode(F.sequence(own, F.floor((us + F.lit(reach)) / F.lit(size)))))
    return out.withColumn("_carried", F.col(detectors.SLICE) > own)


def evaluate(messages: DataFrame, config: Config, slice_seconds: int | None = None) -> DataFrame:
    """The report of every message (player_id, seq, ts, raw): forms, matches, scores, crossing, decision, actions.

    A disabled engine allows everything and remembers nothing. Optional columns:
    ``bypass`` (array of categories) and ``bypass_all`` (such rows are allowed
    and are not remembered). Configurations that mute are refused.
    ``slice_seconds`` cuts each player's time into slices (:func:`sliced`), for
    accounts that hold a large share of all messages; the result is the same.
    """
    if mutes(config):
        raise ValueError("actions that mute feed back into detection: use the stateful tier")
    if not config.enabled:
        return messages.withColumns({"matches": F.array().cast(f"array<{MATCH}>"), "decision": F.lit("ALLOW"), "points_added": F.lit(0).cast("long")})
    passed = None
    if "bypass_all" in messages.columns:
        passed, messages = messages.where("bypass_all"), messages.where("not bypass_all")
    if slice_seconds is not None:
        messages = sliced(messages, config.decay_seconds + lookback(config), slice_seconds)
    out = with_score(with_matches(messages, config), config)
    if slice_seconds is not None:
        out = out.where("not _carried").drop("_carried", detectors.SLICE)
    out = with_actions(out, config).drop("recent", "unicode")
    return out if passed is None else out.unionByName(passed.withColumn("decision", F.lit("ALLOW")), allowMissingColumns=True)
