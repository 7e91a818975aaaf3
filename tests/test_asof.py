"""Reloads: timelines, both tiers over them against a fold message by message, streams that go on under a longer timeline."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from brindle.plans import asof, fold, windowed
from brindle.plans import config as C
from brindle.streaming import processor

BASE = C.default_config()
S = 1_000_000
T0 = 1_704_067_200
TEXTS = ["hello there friend", "hello there frend", "HELLO THERE FRIEND", "ok", "what is going on here", "what is going on her", "zzzzzzzzzz", "x" * 30, "the word"]


def text_of(**sections):
    return json.dumps(sections)


def rules(**own):
    return {"rules": own}


def said(spark, rows):
    return spark.createDataFrame(rows, "player_id string, seq long, s double, raw string").select("player_id", "seq", F.timestamp_micros((F.col("s") * S).cast("long") + T0 * S).alias("ts"), "raw")


def chatter(seed, n=400):
    """Three players, one of them talkative; some messages at the same instant."""
    r, at, rows = random.Random(seed), {}, []
    for k in range(n):
        p = r.choice("aaab") if k % 9 else "c"
        at[p] = at.get(p, 0) + r.choice([0, 0.3, 1, 1, 2, 5, 20])
        rows.append((p, k, float(at[p]), r.choice(TEXTS)))
    return rows


#: Longer and shorter windows and numbers in turn, other decays, caps and points, one version switched off.
VERSIONS = [
    text_of(score={"point_decay_minutes": 1, "thresholds": [{"points": 3, "actions": ["WARN"]}]}, **rules(duplicate_spam={"history_size": 2, "duplicate_window_seconds": 5})),
    text_of(score={"point_decay_minutes": 3, "maximum_points_per_message": 2, "thresholds": [{"points": 4, "actions": ["KICK"]}, {"points": 9, "actions": ["WARN"]}]}, **rules(duplicate_spam={"history_size": 50, "duplicate_window_seconds": 600}, similarity_spam={"history_size": 40, "window_seconds": 300}, rapid_spam={"window_seconds": 60, "maximum_messages_in_window": 20})),
    text_of(enabled=False),
    text_of(**rules(similarity_spam={"enabled": False}, rapid_spam={"window_seconds": 30, "maximum_messages_in_window": 3}, caps={"minimum_letters": 3, "points": 7}, message_length={"maximum_length": 12})),
    text_of(filters=[{"id": "f.word", "match_mode": "WORD", "terms": ["word"], "actions": ["BLOCK"]}], **rules(similarity_spam={"similarity_threshold": 0.5, "minimum_length": 2, "maximum_processed_length": 12})),
]


def over(times, texts=VERSIONS):
    got, refused = asof.timeline(C.load(texts[0]), [asof.Attempt((T0 + t) * S, x) for t, x in zip(times, texts[1:], strict=True)])
    assert not refused
    return got


COLS = ["player_id", "seq", "decision", "rule_ids", "points_added", "threshold_crossed"]


def reports(frame):
    if "matches" in frame.columns:
        frame = frame.withColumn("rule_ids", F.transform("matches", lambda m: m["rule_id"]))
    return {(r.player_id, r.seq): (r.decision, tuple(r.rule_ids), r.points_added, r.threshold_crossed) for r in frame.select(*COLS).collect()}


def by_fold(m, line):
    """The plain truth: stateless matches by each version, then one fold per player in order, no Spark state."""
    rows = [r for v, c in enumerate(line.configs) for r in processor.prepared(m.where(line.within(v)), c).collect()]
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts_us, r.seq)):
        state[r.player_id], got = fold.evaluate(state.get(r.player_id, fold.new_state()), processor._message(r), line.at(r.ts_us))
        out[r.player_id, r.seq] = (got["decision"], tuple(got["rule_ids"]), got["points_added"], got["threshold_crossed"])
    return out


def test_timeline():
    mine = text_of(**rules(caps={"points": 3}))
    tries = [asof.Attempt(50, mine), asof.Attempt(10, "{"), asof.Attempt(20, mine), asof.Attempt(30, text_of(state={"maximum_tracked_players": 5}), tracked_players=6), asof.Attempt(60, text_of(enabled=False)), asof.Attempt(60, text_of(**rules(caps={"points": 4})))]
    line, refused = asof.timeline(BASE, tries)
    assert line.since == (20, 60) and [c.rules["caps"].points for c in line.configs] == [1, 3, 4]
    assert [at for at, _ in refused] == [10, 30] and refused[1][1][0].path == "$.state.maximum_tracked_players"
    assert [line.at(t).rules["caps"].points for t in (-1, 19, 20, 59, 60, 10**9)] == [1, 1, 3, 3, 4, 4]
    assert asof.timeline(BASE, []) == (asof.Timeline((BASE,)), [])
    for since in ((1, 1), (2, 1), (1,)):
        with pytest.raises(ValueError, match="ascending"):
            asof.Timeline((BASE,) * 3, since)


@pytest.mark.parametrize("seed, times", [(1, (60, 150, 260, 330)), (2, (20, 21, 22, 400)), (3, (100, 200, 201, 203))])
def test_windowed_tier_equals_a_fold(spark, seed, times):
    m, line = said(spark, chatter(seed)), over(times)
    want = by_fold(m, line)
    got = reports(asof.evaluate(m, line))
    assert len(want) == 400 and got == want
    assert sum(bool(w[1]) for w in want.values()) > 100
    assert len({w[3] for w in want.values()}) >= 2


def test_slices_change_nothing(spark):
    m, line = said(spark, chatter(4)), over((60, 150, 260, 330))
    assert reports(asof.evaluate(m, line, slice_seconds=120)) == by_fold(m, line)


def test_windows_that_grow_bring_nothing_back(spark):
    """What the first version dropped at the second message stays dropped under the second's long window."""
    rows = [("p", 1, 0.0, "hello there"), ("p", 2, 10.0, "other words"), ("p", 3, 20.0, "hello there"), ("q", 1, 0.0, "hello there"), ("q", 2, 20.0, "hello there")]
    short, long_ = ({"duplicate_spam": {"duplicate_window_seconds": w, "history_size": 9}, "similarity_spam": {"window_seconds": 1, "enabled": False}} for w in (5, 600))
    line = over((15,), [text_of(**rules(**short)), text_of(**rules(**long_))])
    got = reports(asof.evaluate(said(spark, rows), line))
    assert got["p", 3][1] == () and got["q", 2][1] == ("spam.duplicate",)


def test_one_version_is_no_timeline(spark):
    m = said(spark, chatter(5, 100))
    config = replace(BASE, thresholds=((2, (C.Action("WARN"),)),))
    assert reports(asof.evaluate(m, asof.Timeline((config,)))) == reports(windowed.evaluate(m, config))


def test_edges(spark):
    line = over((60, 150, 260, 330))
    assert asof.evaluate(said(spark, []), line).count() == 0
    off = asof.Timeline((replace(BASE, enabled=False),))
    assert reports(asof.evaluate(said(spark, chatter(1, 5)), off)).keys() == {(p, s) for p, s, *_ in chatter(1, 5)}
    odd = said(spark, [("p", 1, 0.0, None), ("p", 1, 0.0, None), (None, 2, 70.0, "hello there"), (None, 3, 71.0, "hello there")]).withColumn("seconds", F.lit("extra"))
    got = asof.evaluate(odd.unionByName(odd.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))), line)
    assert got.count() == 5 and got.where("seconds = 'extra'").count() == 5 and got.where("size(matches) > 0").count() == 2
    mute = replace(BASE, thresholds=((2, (C.Action("MUTE", seconds=60),)),))
    with pytest.raises(ValueError, match="stateful"):
        asof.evaluate(odd, asof.Timeline((BASE, mute), (5,)))


def test_passes(spark):
    """Bypassed rows are allowed and are not remembered, under every version."""
    m = said(spark, chatter(6, 120)).withColumn("bypass_all", F.col("seq") % 4 == 0)
    line = over((30, 60, 61, 90))
    got = reports(asof.evaluate(m, line))
    want = by_fold(m.where("not bypass_all"), line)
    assert {k: v for k, v in got.items() if k in want} == want and len(got) == 120
    assert all(v == ("ALLOW", (), 0, None) for k, v in got.items() if k not in want)


def test_the_scan_gets_the_bounds_and_versions_add_no_exchange(spark, tmp_path):
    said(spark, chatter(1)).write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    plan = asof.evaluate(m, over((60, 150, 260, 330)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(ts,2024-01-01 00:0") == 4 and plan.count("LessThan(ts,2024-01-01 00:0") == 4
    # As many as without versions: Python for similarity does not keep the partitioning.
    exchanges = lambda p: p.count("Exchange hashpartitioning(player_id")
    assert exchanges(plan) == exchanges(windowed.evaluate(m, BASE)._jdf.queryExecution().executedPlan().toString()) == 2


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processor.ROCKS)
    return spark


def test_stateful_tier_with_mutes(rocks):
    m, line = said(rocks, chatter(7, 150)), over((30, 60, 70, 110))
    mute = replace(line.configs[1], thresholds=((2, (C.Action("MUTE", seconds=4),)),))
    line = replace(line, configs=(line.configs[0], mute, *line.configs[2:]))
    want = by_fold(m, line)
    assert reports(processor.evaluate(m, line)) == want
    states = {r.player_id: json.loads(r.state) for r in processor.states(m, line).collect()}
    assert states.keys() == {"a", "b", "c"} and states["a"]["recent"]


def test_stream_goes_on_under_a_longer_timeline(rocks, tmp_path):
    """The first run knows two versions; the second, from its checkpoint, all of them."""
    rows, line = chatter(8, 160), over((30, 60, 70, 110))
    first = asof.Timeline(line.configs[:2], line.since[:1])
    m = said(rocks, rows)
    early = m.where(F.col("ts") < F.timestamp_micros(F.lit(line.since[1])))

    def run(part, known, name):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = rocks.readStream.schema(m.schema).parquet(str(tmp_path / "in/*"))
        out = processor.evaluate(stream, known).writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")))
        out.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run(early, first, "1")
    run(m.join(early, "seq", "left_anti").select(*m.columns), line, "2")
    assert reports(rocks.read.parquet(str(tmp_path / "out"))) == by_fold(m, line)
