"""The stateful tier on Spark: the fold of :mod:`brindle.plans.fold` per player, in batch or in a stream.

Text forms and stateless matches are SQL expressions, computed before the
state; the processor sees one row per message. State is one JSON value per
player in Spark's state store, bounded by the configuration's limits, and is
recovered from the checkpoint. Within a batch a player's rows are taken in
order of (ts, seq); a stream must deliver them so across batches.

Where a configuration is asked for, a timeline of reloads may stand: each row is
then taken by the version in force at its time. A stream that is started again
from its checkpoint with a longer timeline goes on with the state that it had.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from brindle.operators.detectors import MATCH
from brindle.plans import asof, fold, windowed
from brindle.plans.asof import Timeline, in_force
from brindle.plans.config import Action, Config

REPORT = "player_id string, seq long, ts_us long, decision string, rule_ids array<string>, points_before long, points_added long, points_after long, threshold_crossed long, actions array<string>"


def _matches(text: str | None) -> list[dict[str, Any]]:
    out = []
    for m in json.loads(text or "[]"):
        actions = tuple(Action(a["type"], a.get("message", ""), a.get("seconds"), a.get("reason", ""), a.get("command")) for a in m.get("actions", []))
        out.append({"rule_id": m["rule_id"], "category": m["category"], "severity": m["severity"], "points": m["points"], "block": m["block"], "actions": actions})
    return out


def _report(player: str, got: dict) -> tuple:
    return (player, got["seq"], got["ts"], got["decision"], got["rule_ids"], got["points_before"], got["points_added"], got["points_after"], got["threshold_crossed"], got["actions"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
    frame["threshold_crossed"] = frame["threshold_crossed"].astype("Int64")
    return frame


def _message(r: Any) -> dict[str, Any]:
    return {"ts": int(r.ts_us), "seq": int(r.seq), "canonical": r.canonical, "deobfuscated": r.deobfuscated, "first": _matches(r.first), "last": _matches(r.last)}


def _step(state: dict, r: Any, over: Config | Timeline) -> tuple[dict, dict | None]:
    """The state after a row, and the report of a message.

    A control event that is not valid changes nothing: it must not stop the others.
    """
    config = in_force(over, int(r.ts_us))
    if r.control:
        try:
            state = fold.control(state, {"ts": int(r.ts_us), "seq": int(r.seq), **json.loads(r.control)}, config)
        except (ValueError, KeyError, TypeError) as e:
            logging.getLogger(__name__).warning("control event %s of player left out: %s", r.seq, e)
        return state, None
    return fold.evaluate(state, _message(r), config)


def folded(state: dict, todo: pd.DataFrame, over: Config | Timeline) -> tuple[dict, list[dict]]:
    """The state after rows in the order of (ts, seq), and the reports of the messages among them."""
    out = []
    for r in todo.sort_values(["ts_us", "seq"], kind="stable").itertuples(index=False):
        state, got = _step(state, r, over)
        if got is not None:
            out.append(got)
    return state, out


def _started(player: str, state: str) -> dict:
    """An initial state, checked."""
    out = json.loads(state)
    if not isinstance(out, dict) or set(out) != set(fold.new_state()):
        raise ValueError(f"the initial state of player {player} is not a state")
    return out


def _in_order(rows: DataFrame) -> DataFrame:
    """A batch's rows by player, each player's in the order of (ts, seq), after initial states: one sort for all players of a task."""
    start = [F.col("state").isNull()] if "state" in rows.columns else []
    return rows.repartition("player_id").sortWithinPartitions("player_id", *start, "ts_us", "seq")


def _reports(batches: Iterator[pd.DataFrame], over: Config | Timeline) -> Iterator[pd.DataFrame]:
    """Reports of rows that :func:`_in_order` dealt; a row with a ``state`` is where its player starts."""
    player, state = ..., fold.new_state()
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            started = isinstance(r.state, str)
            if r.player_id != player:
                player, state = r.player_id, _started(r.player_id, r.state) if started else fold.new_state()
            if started:
                continue
            state, got = _step(state, r, over)
            if got is not None:
                out.append(_report(player, got))
        yield _frame(out)


def _lasts(batches: Iterator[pd.DataFrame], over: Config | Timeline) -> Iterator[pd.DataFrame]:
    """(player_id, state) after rows that :func:`_in_order` dealt."""
    player, state = None, None
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if state is None or r.player_id != player:
                if state is not None:
                    out.append((player, json.dumps(state, ensure_ascii=False)))
                player, state = r.player_id, fold.new_state()
            state, _ = _step(state, r, over)
        yield pd.DataFrame(out, columns=["player_id", "state"])
    if state is not None:
        yield pd.DataFrame([(player, json.dumps(state, ensure_ascii=False))], columns=["player_id", "state"])


class Moderator(StatefulProcessor):
    """Folds a player's messages and control events into reports; with timers, forgets players after their idle time."""

    def __init__(self, config: Config | Timeline, timers: bool = False):
        self.config, self.timers = config, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else fold.new_state()

    def _keep(self, state: dict) -> None:
        self.state.update((json.dumps(state, ensure_ascii=False),))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._keep(_started(key[0], initialState["state"].iloc[0]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, out = folded(self._load(), pd.concat(list(rows)), self.config)
        self._keep(state)
        if self.timers and state["active"] is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer((state["active"] + fold.idle(in_force(self.config, state["active"]))) // 1_000 + 1)
        yield _frame([_report(key[0], got) for got in out])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        state = fold.pruned(self._load(), now, in_force(self.config, now)) if self.state.exists() else None
        if state is None:
            self.state.clear()
        else:
            self._keep(state)
        yield _frame([])

    def close(self) -> None:
        pass


def _judged(messages: DataFrame, config: Config) -> DataFrame:
    """Adds ``judged``, the forms and stateless matches of ``raw``; the columns of ``messages`` stay."""
    out = windowed.stateless(messages, config)
    first = F.array_compact(F.array("m_length", "m_caps", "m_runs")).cast(f"array<{MATCH}>")
    judged = F.struct("canonical", "deobfuscated", F.to_json(first).alias("first"), F.to_json(F.concat("filtered", "m_ads")).alias("last"))
    return out.select(*messages.columns, judged.alias("judged"))


def prepared(messages: DataFrame, config: Config | Timeline, with_time: bool = False) -> DataFrame:
    """Messages (player_id, seq, ts, raw, optional control: JSON of a staff event) with forms and stateless matches.

    A timeline's versions are branches over their own time in a batch. A stream
    must read its source once, however many versions there are, to go on from a
    checkpoint: there every version sees each row, but the text of its own alone.
    """
    control = F.col("control") if "control" in messages.columns else F.lit(None).cast("string")
    out = messages.select(F.col("player_id").cast("string").alias("player_id"), F.col("seq").cast("long").alias("seq"), "ts", F.coalesce("raw", F.lit("")).alias("raw"), control.alias("control"))
    if messages.isStreaming and isinstance(config, Timeline):
        rest, parts = [c for c in out.columns if c != "raw"], []
        out = out.withColumnRenamed("raw", "said")
        for v, c in enumerate(config.configs):
            seen = out.withColumn("raw", F.when(config.within(v), F.col("said")).otherwise(""))
            out = _judged(seen, c).drop("raw").withColumnRenamed("judged", f"judged_{v}")
            parts.append(F.when(config.within(v), F.col(f"judged_{v}")))
        out = out.select(*rest, F.coalesce(*parts).alias("judged"))
    else:
        out = reduce(DataFrame.unionByName, [_judged(rows, c) for c, rows in asof.versions(config, out)])
    return out.select("player_id", "seq", F.unix_micros("ts").alias("ts_us"), "judged.canonical", "judged.deobfuscated", "judged.first", "judged.last", "control", *(["ts"] if with_time else []))


def evaluate(messages: DataFrame, config: Config | Timeline, initial: DataFrame | None = None, timers: bool = False) -> DataFrame:
    """Reports of all messages, batch or streaming, by the state that earlier ones left.

    ``initial`` (player_id, state: JSON) is where players start, as from a
    snapshot. With ``timers``, for streams whose ``ts`` has a watermark, a player
    is pruned once the watermark passes the end of the idle time; without them
    state grows with the number of players ever seen. A stream's session must
    keep state in RocksDB (:func:`stateful`). A batch keeps none: its rows are
    sorted by player and folded one after the other.
    """
    rows = prepared(messages, config, timers)
    first = None if initial is None else initial.select(F.col("player_id").cast("string").alias("player_id"), "state")
    if not messages.isStreaming and not timers:
        rows = rows.withColumn("state", F.lit(None).cast("string"))
        if first is not None:
            rows = rows.unionByName(first.withColumns({"ts_us": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")}), allowMissingColumns=True)
        return _in_order(rows).mapInPandas(lambda it: _reports(it, config), REPORT)
    stateful(messages.sparkSession)
    first = None if first is None else first.groupBy("player_id")
    return rows.groupBy("player_id").transformWithStateInPandas(Moderator(config, timers), outputStructType=REPORT, outputMode="Update", timeMode="EventTime" if timers else "None", initialState=first)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Sets the session up for keyed state, where it does not name another provider than Spark's default."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKS)
    _ = spark.streams.active  # starts the coordinator of state stores, which batch queries need too


def states(messages: DataFrame, config: Config | Timeline) -> DataFrame:
    """(player_id, state: JSON) after all messages, in one batch: a player's rows are folded in one task."""
    return _in_order(prepared(messages, config)).mapInPandas(lambda it: _lasts(it, config), "player_id string, state string")


def preview(messages: DataFrame, kept: DataFrame, config: Config | Timeline) -> DataFrame:
    """Reports that messages would have, each by its player's state in ``kept`` (player_id, state); nothing is written back."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([_report(r.player_id, fold.preview(json.loads(r.state) if isinstance(r.state, str) else None, _message(r), in_force(config, int(r.ts_us)))) for r in b.itertuples(index=False)])

    return prepared(messages, config).join(kept.select("player_id", "state"), "player_id", "left").mapInPandas(look, REPORT)


def prune(kept: DataFrame, now_us: int, config: Config | Timeline) -> DataFrame:
    """States (player_id, state) without what has expired by ``now_us``, and without players of whom nothing is left."""

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left = [(p, fold.pruned(json.loads(s), now_us, in_force(config, now_us))) for p, s in zip(b["player_id"], b["state"], strict=True)]
            yield pd.DataFrame([(p, json.dumps(s, ensure_ascii=False)) for p, s in left if s is not None], columns=["player_id", "state"])

    return kept.select("player_id", "state").mapInPandas(rest, "player_id string, state string")
