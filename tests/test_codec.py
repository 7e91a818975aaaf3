"""State to snapshot and back."""

import json
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from brindle.plans import fold
from brindle.plans.config import Action
from brindle.plans.queries import BASE, KEPT, SLICE
from brindle.sources.messages import document_messages
from brindle.streaming import audit, codec, processor

S = 1_000_000
NOW = 1_704_067_200 * S
SF = "/root/testdata/sf0.001"


def full():
    record = {"ts": NOW - 5 * S, "seq": 3, "rule_ids": ["a", "b"], "categories": ["FLOODING"], "severity": "HIGH", "decision": "BLOCK", "points_added": 2, "score_after": 4, "actions": ["WARN"]}
    return fold.new_state() | {
        "times": [NOW], "recent": [{"ts": NOW, "canonical": "x", "clear": "x"}], "violations": [record, record | {"seq": None}], "crossed": [5, 2], "noticed": NOW, "active": NOW - 9 * S,
        "entries": [{"points": 2, "rule": "a", "created": NOW - S, "expires": NOW + S}, {"points": 9, "rule": "b", "created": NOW - 9 * S, "expires": NOW}],
    }


def test_round_trip(spark, tmp_path):
    permanent = {"until": None, "at": NOW - S, "reason": "r", "rule": None}
    timed = {"until": NOW + 7 * S, "at": NOW - S, "reason": 'a "b"\n', "rule": "a"}
    made = {"b": full() | {"mute": permanent}, "a": full() | {"mute": timed}, "c": full() | {"mute": timed | {"until": NOW}}, "d": fold.new_state(), "e": fold.new_state()}
    states = spark.createDataFrame([(k, json.dumps(v)) for k, v in made.items()], "player_id string, state string")
    names = spark.createDataFrame([("e", "Eve"), ("f", "Finn"), ("g", " ")], "player_id string, name string")
    at, path = F.timestamp_micros(F.lit(NOW)), str(tmp_path / "s")
    codec.save(states, path, at, BASE, names)
    snapshot = audit.read_snapshot(spark, path, audit.SNAPSHOT).collect()
    assert [r.player_id for r in snapshot] == ["a", "b", "c", "e", "f"]
    assert [(r.mute.kind, r.mute.source, r.mute.rule_id) if r.mute else None for r in snapshot] == [("TEMPORARY", codec.RULE, "a"), ("PERMANENT", codec.STAFF, ""), None, None, None]
    back = {r.player_id: json.loads(r.state) for r in codec.restore(spark, path, at, BASE).collect()}
    for k in "abc":
        want = made[k] | {"times": [], "recent": [], "noticed": None, "active": NOW, "entries": made[k]["entries"][:1], "crossed": [2, 5]}
        assert back[k] == (want | {"mute": None} if k == "c" else want)
    assert back["f"] == fold.new_state() | {"active": NOW}
    assert codec.restore(spark, str(tmp_path / "none"), at, BASE).count() == 0


def test_wrong_snapshots_and_states_are_errors(spark, tmp_path):
    at = F.timestamp_micros(F.lit(NOW))
    twice = spark.createDataFrame([("a", json.dumps(full()))] * 2, "player_id string, state string")
    codec.save(twice, str(tmp_path / "s"), at, BASE)
    with pytest.raises(ValueError, match="a player twice"):
        codec.restore(spark, str(tmp_path / "s"), at, BASE)
    few = replace(BASE, state={**BASE.state, "maximum_tracked_players": 0})
    codec.save(twice.limit(1), str(tmp_path / "t"), at, BASE)
    with pytest.raises(ValueError, match="more than 0 players"):
        codec.restore(spark, str(tmp_path / "t"), at, few)
    wrong = spark.createDataFrame([("a", "{"), ("b", '{"times": 5}')], "player_id string, state string")
    for row in ("a", "b"):
        with pytest.raises(Exception, match="(?i)malformed|cannot be parsed"):
            codec.to_snapshot(wrong.where(F.col("player_id") == row), at, BASE).collect()


def test_stream_restarts_from_its_snapshot(spark, tmp_path):
    """A stream's state, read from its checkpoint, written, restored: the rest of the messages give the reports of one run.

    Duplicates and rapid posts look at buffers, which no snapshot keeps; mutes, scores and thresholds go on.
    """
    processor.stateful(spark)
    mute = (Action("MUTE", seconds=40, reason="r"),)
    config = replace(SLICE.only("message_length", "caps"), thresholds=((2, mute), (5, ())), state=KEPT.state)
    m = document_messages(spark, SF).withColumn("raw", F.when(F.col("seq") % 3 == 0, F.upper("raw")).otherwise(F.col("raw")))
    m = m.select(F.col("player_id").cast("string").alias("player_id"), "seq", "ts", "raw")
    key = lambda df: {(r.player_id, r.seq): (r.decision, r.points_before, r.points_added, r.points_after, r.threshold_crossed) for r in df.collect()}
    whole = key(processor.evaluate(m, config))
    m.where("seq <= 8").orderBy("player_id", "seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    checkpoint = str(tmp_path / "c")
    q = processor.evaluate(stream, config).writeStream.format("memory").queryName("before_restart").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    first = key(spark.table("before_restart"))
    at, path = F.timestamp_micros(F.lit(NOW)), str(tmp_path / "s")
    codec.save(codec.from_checkpoint(spark, checkpoint), path, at, config)
    rest = key(processor.evaluate(m.where("seq > 8"), config, initial=codec.restore(spark, path, at, config)))
    assert first | rest == whole
    assert any(d == "BLOCK" and added == 0 for d, _, added, _, _ in rest.values())
    alone = key(processor.evaluate(m.where("seq > 8"), config))
    assert alone != rest


def test_wrong_initial_state_is_an_error(spark):
    processor.stateful(spark)
    m = document_messages(spark, SF).where("player_id = 1")
    with pytest.raises(Exception, match="is not a state"):
        processor.evaluate(m, KEPT, initial=spark.createDataFrame([("1", '{"times": []}')], "player_id string, state string")).collect()


def test_query_matches_its_sql(spark):
    processor.stateful(spark)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = __spark_entry__.queries()["snapshot_from_state"](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(__spark_entry__.oracle_sql()["snapshot_from_state"])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    rows = sorted(str([r[i] for i in at]) for r in want.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == rows
    assert any("'BLOCK'" in r for r in rows)
