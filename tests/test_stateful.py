"""The stateful tier: equal to the windowed one without mutes; mutes, control events, streams, sinks."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from brindle.operators import detectors, history
from brindle.plans import config as C
from brindle.plans import fold, queries, windowed
from brindle.sources.messages import document_messages
from brindle.streaming import audit, processor

BASE = C.default_config()
S = 1_000_000


def said(ts, text="hello there", seq=None, first=()):
    return {"ts": ts * S, "seq": ts if seq is None else seq, "canonical": text, "deobfuscated": text, "first": list(first), "last": []}


def run(config, events):
    state, out = fold.new_state(), []
    for e in events:
        if "kind" in e:
            state = fold.control(state, e, config)
        else:
            state, r = fold.evaluate(state, e, config)
            out.append(r)
    return state, out


def test_mute_feeds_back():
    config = replace(BASE, thresholds=((2, (C.Action("MUTE", seconds=60),)),))
    state, out = run(config, [said(t) for t in (0, 1, 2, 4, 7, 30, 61, 70)])
    assert [r["decision"] for r in out] == ["ALLOW", "BLOCK", "BLOCK", "BLOCK", "BLOCK", "BLOCK", "ALLOW", "BLOCK"]
    assert [r["actions"] for r in out[2:6]] == [["WARN"], [], ["WARN"], ["WARN"]] and out[6]["points_before"] == 2
    assert len(state["violations"]) == 2


def test_controls():
    mute = {"kind": "mute", "ts": 0, "seconds": 100}
    state, out = run(BASE, [mute, said(1), {"kind": "unmute", "ts": 2 * S, "seq": 2}, said(3)])
    assert [r["decision"] for r in out] == ["BLOCK", "ALLOW"] and state["violations"][0]["rule_ids"] == ["manual.unmute"]
    state, _ = run(BASE, [{"kind": "mute", "ts": 0}, {"kind": "mute", "ts": 1, "seconds": 5}])
    assert state["mute"]["until"] is None
    with pytest.raises(ValueError, match="mute"):
        fold.control(fold.new_state(), {"kind": "mute", "ts": 0, "seconds": 10**9}, BASE)
    for scope, empty in (("score", "entries"), ("history", "violations"), ("spam", "recent")):
        full, _ = run(BASE, [said(0), said(1)])
        state = fold.control(full, {"kind": "clear", "ts": 2 * S, "scope": scope}, BASE)
        assert fold.cleared(full, state, scope) and fold.cleared(full, state, "all") and not fold.cleared(state, fold.control(state, {"kind": "clear", "ts": 3 * S, "scope": scope}, BASE), scope)
        assert not state[empty] and any(state[k] for k in ("entries", "violations", "recent"))


def test_capacity_and_pruning():
    config = replace(BASE, state={**BASE.state, "maximum_score_entries_per_player": 1})
    state, out = run(config, [said(0), said(1), said(2)])
    assert "security.state_capacity" in out[2]["rule_ids"] and out[2]["points_added"] == 0 and len(state["entries"]) == 1
    idle, _ = run(BASE, [said(0)])
    assert fold.pruned(idle, 3_600 * S, BASE) is None and fold.pruned(idle, 60 * S, BASE) == idle
    kept = fold.pruned(state, 7_200 * S, BASE)
    assert kept["recent"] == [] and kept["violations"]


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def test_tiers_agree_and_streams_do(rocks, tmp_path):
    messages = document_messages(rocks, "/root/testdata/sf0.001").where("player_id < 12")
    config = replace(BASE, thresholds=queries.THRESHOLDS)
    cols = ["player_id", "seq", "decision", "points_before", "points_added", "threshold_crossed"]
    key = lambda df: sorted(map(str, df.select(F.col("player_id").cast("string").alias("player_id"), *cols[1:]).collect()))
    want = key(windowed.evaluate(messages, config))
    assert key(processor.evaluate(messages, config)) == want
    messages.orderBy("player_id", "seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    q = processor.evaluate(stream, config).writeStream.format("memory").queryName("reports").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert key(rocks.table("reports")) == want


def test_initial_state_and_broken_control_events(rocks):
    said_ = [("p", 1, "2024-01-01 00:00:10", "hello there", None), ("p", 2, "2024-01-01 00:00:11", "hello there", '{"kind": "mute", "seconds": -5}'), ("p", 3, "2024-01-01 00:00:12", "x", "{broken"), ("p", 4, "2024-01-01 00:00:13", "hello there", None)]
    m = rocks.createDataFrame(said_, "player_id string, seq long, t string, raw string, control string").selectExpr("player_id", "seq", "timestamp(t) ts", "raw", "control")
    got = [(r.seq, r.rule_ids, r.points_before) for r in processor.evaluate(m, BASE).orderBy("seq").collect()]
    assert got == [(1, [], 0), (4, ["spam.duplicate"], 0)]
    now = 1_704_067_200 * S
    state = fold.new_state() | {"entries": [{"points": 7, "rule": "r", "created": now, "expires": now + 3_600 * S}]}
    first = rocks.createDataFrame([("p", json.dumps(state)), ("q", json.dumps(state))], "player_id string, state string")
    got = [(r.seq, r.points_before) for r in processor.evaluate(m, BASE, initial=first).orderBy("seq").collect()]
    assert got == [(1, 7), (4, 7)]


def test_timers_forget_idle_players(rocks, tmp_path):
    """A player who said nothing against the rules starts anew after the idle time; state does not keep the others' buffers."""
    config = replace(BASE, state={**BASE.state, "inactive_player_minutes": 1})
    days = lambda rows, n: rocks.createDataFrame(rows, "player_id string, seq long, t string, raw string").selectExpr("player_id", "seq", "timestamp(t) ts", "raw").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    days([("a", 1, "2024-01-01 00:00:00", "hello there"), ("b", 1, "2024-01-01 00:00:00", "hello there"), ("b", 2, "2024-01-01 00:00:01", "hello there")], 1)
    schema = "player_id string, seq long, ts timestamp, raw string"

    def run_() -> None:
        stream = rocks.readStream.schema(schema).parquet(str(tmp_path / "in/*")).withWatermark("ts", "0 seconds")
        q = processor.evaluate(stream, config, timers=True).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    def kept() -> dict:
        rows = rocks.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "state").load().select("key.player_id", "value.json").collect()
        return {r.player_id: json.loads(r.json) for r in rows}

    run_()
    assert set(kept()) <= {"a", "b"}
    days([("z", 1, "2024-01-01 02:00:00", "hi")], 2)
    run_()
    days([("z", 2, "2024-01-01 02:00:01", "ho")], 3)
    run_()
    left = kept()
    assert "a" not in left and left["b"]["recent"] == [] and left["b"]["violations"] and "z" in left


def test_stream_audit_writes_a_batch_once(spark, tmp_path):
    """A query that lost its commit log runs its last batch again: the log holds it once."""
    e = windowed.evaluate(document_messages(spark, "/root/testdata/sf0.001").where("player_id < 30"), queries.SLICE)
    history.violations(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = audit.stream_audit(stream, str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for f in (tmp_path / "c" / "commits").iterdir():
            f.unlink()
    assert spark.read.json(str(tmp_path / "log")).count() == rows.count() > 0


def test_expired_days_are_deleted(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-09", "2024-01-10"):
        (tmp_path / f"event_date={day}").mkdir()
    (tmp_path / "event_date=old").mkdir()
    from datetime import date

    assert audit.delete_expired(spark, str(tmp_path), date(2024, 1, 11), 2) == ["event_date=2024-01-01"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["event_date=2024-01-09", "event_date=2024-01-10", "event_date=old"]
    assert audit.delete_expired(spark, str(tmp_path / "none"), date(2024, 1, 11), 2) == []


def test_kept_states_of_both_versions(spark, tmp_path):
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    old = '{"player_id": "p", "name": "n", "mute": {"muted_until": "2024-01-10T00:00:05Z", "reason": "r", "source": "s"}, "score_entries": [], "crossed_thresholds": [2], "violations": []}'
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "part-0.json").write_text(old + "\n" + old.replace('"p"', '"q"').replace("00:00:05Z", "00:00:00Z"))
    got = {r.player_id: r.mute for r in audit.restored(spark, str(tmp_path / "s"), 1, at).collect()}
    assert got["p"].kind == "TEMPORARY" and got["p"].moderator_id is None and str(got["p"].muted_at) == "2024-01-10 00:00:00" and got["q"] is None
    audit.write_snapshot(audit.kept(audit.restored(spark, str(tmp_path / "s"), 1, at), at, BASE), str(tmp_path / "t"))
    again = audit.restored(spark, str(tmp_path / "t"), 2, at)
    assert [(r.player_id, r.mute is None, r.crossed_thresholds) for r in again.orderBy("player_id").collect()] == [("p", False, [2]), ("q", True, [2])]
    audit.write_snapshot(again, str(tmp_path / "t2"))
    audit.write_snapshot(spark.read.schema(audit.SNAPSHOT).json(str(tmp_path / "t2")), str(tmp_path / "t"), purge_backup=True)
    assert not (tmp_path / "t.backup").exists()
    with pytest.raises(ValueError, match="version"):
        audit.restored(spark, str(tmp_path / "t"), 3, at)
    many = replace(BASE, state={**BASE.state, "maximum_score_entries_per_player": 0})
    entry = spark.sql("SELECT 'p' player_id, '' name, null mute, array(named_struct('points', 1L, 'rule_id', 'r', 'created_at', timestamp'2024-01-01', 'expires_at', timestamp'2025-01-01')) score_entries, array() crossed_thresholds, array() violations")
    with pytest.raises(Exception, match="score entries"):
        audit.kept(audit.copied(entry, audit.SNAPSHOT), at, many).collect()


def test_muted_messages_are_neither_judged_nor_remembered(rocks):
    """The registered query against a simulation of length, capitals, duplicates and mutes, written apart from the fold."""
    said_ = document_messages(rocks, "/root/testdata/sf0.001").where("player_id < 25").orderBy("player_id", "ts", "seq").collect()
    forms = {(r.player_id, r.seq): r.canonical for r in detectors.with_forms(document_messages(rocks, "/root/testdata/sf0.001").where("player_id < 25"), BASE).select("player_id", "seq", "canonical").collect()}
    want, by = {}, {}
    for m in said_:
        heard, scores, until = by.setdefault(m.player_id, ([], [], [None]))
        now, low = m.ts.timestamp(), forms[m.player_id, m.seq]
        if until[0] is not None and now < until[0]:
            want[m.player_id, m.seq] = ("BLOCK", 0)
            continue
        letters = [c for c in m.raw if c.isalpha()]
        points = (len(m.raw) > 220) + (len(letters) >= 8 and sum(c.isupper() for c in letters) > 0.75 * len(letters)) + 2 * (len(low) >= 3 and any(t >= now - 45 and x == low for t, x in heard[-8:]))
        before = sum(p for t, p in scores if t + 1800 > now)
        want[m.player_id, m.seq] = ("BLOCK" if points else "ALLOW", points)
        scores.append((now, points))
        heard.append((now, low))
        if before < 2 <= before + points:
            until[0] = now + 5
    mute = replace(queries.SLICE, thresholds=((2, (C.Action("MUTE", seconds=5, reason="Repeated chat violations."),)),))
    out = processor.evaluate(document_messages(rocks, "/root/testdata/sf0.001").where("player_id < 25"), mute).collect()
    assert {(int(r.player_id), r.seq): (r.decision, r.points_added) for r in out} == want
    assert sum("MUTE" in r.actions for r in out) > 0


def test_sinks(spark, tmp_path):
    e = windowed.evaluate(document_messages(spark, "/root/testdata/sf0.001").where("player_id < 30"), queries.SLICE)
    records = history.violations(e)
    audit.append_audit(records, str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == records.count() and audit.retained_days(log, F.lit("2024-02-15").cast("date"), 30).count() == 0
    states = spark.createDataFrame([("b", json.dumps(fold.new_state())), ("a", "{}")], "player_id string, state string")
    for _ in range(2):
        audit.write_snapshot(states, str(tmp_path / "s"))
    assert [r.player_id for r in audit.read_snapshot(spark, str(tmp_path / "s"), "player_id string, state string").orderBy("player_id").collect()] == ["a", "b"]
    for part in (tmp_path / "s").glob("part-*"):
        part.write_text("{broken")
    for crc in (tmp_path / "s").glob(".*.crc"):
        crc.unlink()
    assert audit.read_snapshot(spark, str(tmp_path / "s"), "player_id string, state string").count() == 2
    assert audit.read_snapshot(spark, str(tmp_path / "none"), "player_id string, state string").count() == 0


def test_a_batch_folds_all_players_of_a_task_in_one_pass(spark):
    """Players that span Arrow batches, and no grouping by player, each group of which costs milliseconds."""
    lines = "WARNING SHOUTING HERE", "same words again", "same words again", "fine"
    rows = [(p, i, 1_700_000_000 + i, lines[i % 4]) for p in range(40) for i in range(9)] + [(None, i, 1_700_000_000 + i, "null player") for i in range(3)]
    m = spark.createDataFrame(rows, "player_id long, seq long, t long, raw string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    half = processor.states(m.where("seq < 5"), queries.SLICE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        whole = processor.evaluate(m, queries.SLICE)
        plan = whole._jdf.queryExecution().toString() + half._jdf.queryExecution().toString()
        assert "TransformWithState" not in plan and "FlatMapGroups" not in plan
        late = processor.evaluate(m.where("seq >= 5"), queries.SLICE, initial=half)
        key = lambda r: (str(r.player_id), r.seq)
        got = sorted(whole.collect(), key=key)
        assert len(got) == len(rows) and half.count() == 41
        assert sorted(late.collect(), key=key) == [r for r in got if r.seq >= 5]
        state = {r.player_id: r.state for r in processor.states(m, queries.SLICE).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(state) == 41 and all(s == state["0"] for p, s in state.items() if p is not None)
