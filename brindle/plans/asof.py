"""Reloaded configurations: each message is judged by the version in force at its time.

A :class:`Timeline` holds the versions that reloads brought about; a reload
with any problem brings none. Versions are few and lie on the driver, as plans
are compiled from them, so the as-of join is a comparison of ``ts`` with
literals. Text forms and stateless matches are worked out per version, over
that version's stretch of time only (the bounds reach the scan); the versions'
rows then share their exchanges, which are as many as without versions.

What a player said before a reload counts after it as far as it was still
remembered: every message drops entries by the window and the number of its own
version, so a reload to longer windows brings nothing back. Points keep the
decay under which they were given.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import detectors
from brindle.operators.detectors import ACTION, HISTORY, MATCH, actions_literal
from brindle.plans import config as C
from brindle.plans import windowed
from brindle.plans.config import Config, Problem, Rule

VERSION = "_version"


@dataclass(frozen=True)
class Timeline:
    """``configs[0]`` from ever, ``configs[k]`` from ``since[k - 1]`` on (microseconds, ascending)."""

    configs: tuple[Config, ...]
    since: tuple[int, ...] = ()

    def __post_init__(self):
        if len(self.configs) != len(self.since) + 1 or any(a >= b for a, b in zip(self.since, self.since[1:], strict=False)):
            raise ValueError("a timeline has ascending times, one less than configurations")

    def at(self, us: int) -> Config:
        """The configuration in force at an instant; a reload counts from its own instant on."""
        return self.configs[bisect_right(self.since, us)]

    def within(self, version: int) -> Column:
        """Whether ``ts`` lies in a version's time. Rows without a time belong to the first."""
        ts, bound = F.col("ts"), lambda k: F.timestamp_micros(F.lit(self.since[k]))
        if version == 0:
            return F.lit(True) if not self.since else ts.isNull() | (ts < bound(0))
        return (ts >= bound(version - 1)) & (ts < bound(version)) if version < len(self.since) else ts >= bound(version - 1)


@dataclass(frozen=True)
class Attempt:
    """A reload at an instant: the texts as they were, and what the engine held (players, most score entries of one)."""

    at: int
    main: str
    packs: dict[str, str] = field(default_factory=dict)
    exceptions: str | None = None
    tracked_players: int = 0
    score_entries: int = 0


def timeline(first: Config, attempts: Iterable[Attempt]) -> tuple[Timeline, list[tuple[int, list[Problem]]]]:
    """The versions that ``attempts`` lead to, in order of time, and the problems of those that were refused.

    A refused attempt leaves the active version in force; one that brings the
    active version again adds none. Of several at one instant the last valid
    one counts.
    """
    configs, since, refused = [first], [], []
    for a in sorted(attempts, key=lambda a: a.at):
        new, problems = C.reload(configs[-1], a.main, a.packs, a.exceptions, a.tracked_players, a.score_entries)
        if problems:
            refused.append((a.at, problems))
        elif since and since[-1] == a.at:
            configs[-1] = new
        elif new != configs[-1]:
            configs.append(new)
            since.append(a.at)
    return Timeline(tuple(configs), tuple(since)), refused


def in_force(config: Config | Timeline, us: int) -> Config:
    return config.at(us) if isinstance(config, Timeline) else config


def versions(config: Config | Timeline, rows: DataFrame) -> list[tuple[Config, DataFrame]]:
    """Each configuration with the rows (``ts``) that it is in force for."""
    if isinstance(config, Config):
        return [(config, rows)]
    return [(c, rows.where(config.within(v))) for v, c in enumerate(config.configs)]


def _pick(configs: tuple[Config, ...], of: Callable[[Config], Column]) -> Column:
    """``of`` the row's version; the branches of other versions are not evaluated."""
    return F.coalesce(*[F.when(F.col(VERSION) == v, of(c)) for v, c in enumerate(configs)])


def _table(configs: tuple[Config, ...], of: Callable[[Config], Any]) -> Column:
    """A value of each version, as an array literal."""
    return F.array(*[F.lit(of(c)) for c in configs])


def _by_version(configs: tuple[Config, ...], *names: str) -> Config:
    """A configuration whose settings of the named rules are columns: those of the row's version."""
    look = lambda of: F.get(_table(configs, of), F.col(VERSION))
    rules = {}
    for name in names:
        settings = {k: look(lambda c, k=k: c.rules[name].settings[k]) for k in configs[0].rules[name].settings}  # noqa: B023
        rules[name] = Rule(0, enabled=look(lambda c: c.rules[name].enabled), settings=settings)  # noqa: B023
    return replace(configs[0], rules=rules)


def _remembered(rows: DataFrame, name: str, limit: Column, seconds: Column) -> DataFrame:
    """Adds ``name``: what is left of ``_all`` (a player's messages before, oldest first) after each of them dropped others.

    A message keeps the newest ``limit``, itself included, and nothing older
    than ``seconds`` before it. Both drop from the oldest end, so the tightest
    bounds decide: running maxima over the window that is there anyhow.
    """
    before = Window.partitionBy(*detectors.player(rows)).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    oldest = F.unix_micros("ts") - seconds.cast("long") * 1_000_000
    out = rows.withColumns({"_first": F.max(F.col("_n") + 1 - limit).over(before), "_oldest": F.max(oldest).over(before)})
    place = F.col("_first") - F.col("_n") + F.size("_all")
    return out.withColumn(name, F.filter("_all", lambda x, i: (i >= place) & (F.unix_micros(x["ts"]) >= F.col("_oldest")))).drop("_first", "_oldest")


def _matched(rows: DataFrame, configs: tuple[Config, ...]) -> DataFrame:
    """Adds ``matches`` to rows with stateless matches, ``_version`` and ``_clear``."""
    rule = lambda c, name: c.rules[name]
    dup, sim, rapid = "duplicate_spam", "similarity_spam", "rapid_spam"
    most = max(max(rule(c, dup).history_size, rule(c, sim).history_size, rule(c, rapid).maximum_messages_in_window) for c in configs if c.enabled)
    by = Window.partitionBy(*detectors.player(rows)).orderBy("ts", "seq")
    entry = F.struct("ts", "canonical", F.col("_clear").alias("clear"), F.col(VERSION).alias("version"))
    out = rows.withColumns({"_all": F.collect_list(entry).over(by.rowsBetween(-most, -1)), "last_ts": F.lag("ts").over(by), "_n": F.row_number().over(by)})
    limit, seconds = (F.get(_table(configs, of), F.col(VERSION)) for of in (lambda c: rule(c, rapid).maximum_messages_in_window, lambda c: rule(c, rapid).window_seconds))
    out = _remembered(out, HISTORY, limit, seconds).withColumn("_rapid", _pick(configs, detectors.rapid))
    limit, seconds = (F.get(_table(configs, of), F.col(VERSION)) for of in (lambda c: max(rule(c, dup).history_size, rule(c, sim).history_size), lambda c: max(rule(c, dup).duplicate_window_seconds, rule(c, sim).window_seconds)))
    out = _remembered(out, HISTORY, limit, seconds)
    if any(rule(c, sim).enabled for c in configs if c.enabled):
        length = F.get(_table(configs, lambda c: rule(c, sim).maximum_processed_length), F.col(VERSION))
        out = out.withColumn(HISTORY, F.transform(HISTORY, lambda x: F.struct(x["ts"].alias("ts"), x["canonical"].alias("canonical"), text.truncate(x["clear"], length).alias("clear"))))
        out = detectors.similar_recent(out, _by_version(configs, dup, sim))
    else:
        out = out.withColumn("similar", F.lit(None).cast("string"))
    history = (_pick(configs, detectors.duplicate), F.col("_rapid"), _pick(configs, detectors.similarity_match))
    return windowed.joined(out, *history).drop("_all", "_n", "_rapid", "_clear")


def _scored(rows: DataFrame, configs: tuple[Config, ...]) -> DataFrame:
    """Adds points_added, points_before, points_after: points live as long as the version that gave them says."""
    cap = F.get(_table(configs, lambda c: c.cap), F.col(VERSION))
    out = rows.withColumns({"points_added": F.aggregate(windowed.contributions(F.col("matches"), cap), F.lit(0).cast("long"), lambda a, x: a + x), "_us": F.unix_micros("ts")})
    by = Window.partitionBy(*detectors.player(rows)).orderBy("_us")
    before = F.coalesce(F.sum("points_added").over(Window.partitionBy(*detectors.player(rows), "_us").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for decay in {c.decay_seconds for c in configs if c.enabled}:
        given = F.when(F.col(VERSION).isin([v for v, c in enumerate(configs) if c.decay_seconds == decay]), F.col("points_added"))
        before = before + F.coalesce(F.sum(given).over(by.rangeBetween(-(decay * 1_000_000 - 1), -1)), F.lit(0))
    out = out.withColumn("points_before", F.least(before, F.lit(windowed.INT_MAX)))
    return out.withColumn("points_after", F.least(F.col("points_before") + F.col("points_added"), F.lit(windowed.INT_MAX))).drop("_us")


def _acted(rows: DataFrame, configs: tuple[Config, ...]) -> DataFrame:
    """Adds threshold_crossed, decision, severity and actions by the thresholds of the row's version."""
    crossed = _pick(configs, lambda c: windowed.crossing(F.col("points_before"), F.col("points_after"), [t for t, _ in c.thresholds]))
    out = rows.withColumn("threshold_crossed", crossed)
    of = F.array().cast(f"array<{ACTION}>")
    for v, c in enumerate(configs):
        for t, actions in c.thresholds:
            of = F.when((F.col(VERSION) == v) & (F.col("threshold_crossed") == t), actions_literal(actions)).otherwise(of)
    decision = F.when(F.exists("matches", lambda m: m["block"]), F.lit("BLOCK")).otherwise(F.lit("ALLOW"))
    return out.withColumns({"decision": decision, "severity": windowed.severity(F.col("matches")), "actions": windowed.planned(F.col("matches"), of)})


def evaluate(messages: DataFrame, over: Timeline, slice_seconds: int | None = None) -> DataFrame:
    """As :func:`brindle.plans.windowed.evaluate`, each message by the version in force at its ``ts``.

    Messages under a version that is disabled are allowed, without a score, and
    are not remembered. Versions that mute are refused: the stateful tier takes
    a timeline too. ``slice_seconds`` cuts hot accounts into slices of time. An
    empty table gives an empty result; messages without a time come first.
    """
    configs = over.configs
    if any(windowed.mutes(c) for c in configs):
        raise ValueError("actions that mute feed back into detection: use the stateful tier")
    passed, parts = [], []
    longest = max(c.rules["similarity_spam"].maximum_processed_length for c in configs)
    if "bypass_all" in messages.columns:
        passed, messages = [messages.where("bypass_all")], messages.where("not bypass_all")
    for v, (c, rows) in enumerate(versions(over, messages)):
        if c.enabled:
            clear = text.truncate(F.col("deobfuscated"), longest)
            parts.append(windowed.stateless(rows, c).withColumns({VERSION: F.lit(v), "_clear": clear}))
        else:
            passed.append(rows)
    blank = [p.withColumns({"matches": F.array().cast(f"array<{MATCH}>"), "decision": F.lit("ALLOW"), "points_added": F.lit(0).cast("long"), "threshold_crossed": F.lit(None).cast("long")}) for p in passed]
    if not parts:
        return reduce(DataFrame.unionByName, blank)
    out = reduce(DataFrame.unionByName, parts)
    if slice_seconds is not None:
        reach = max(c.decay_seconds + windowed.lookback(c) for c in configs if c.enabled)
        out = windowed.sliced(out, reach, slice_seconds)
    out = _scored(_matched(out, configs), configs)
    if slice_seconds is not None:
        out = out.where("not _carried").drop("_carried", detectors.SLICE)
    out = _acted(out, configs).drop(HISTORY, "unicode", VERSION)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blank, out)
