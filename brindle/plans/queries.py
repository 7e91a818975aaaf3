"""The registered queries over message tables, and their SQL."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import plain, similarity, text
from brindle.operators import detectors, filters, history, lookups
from brindle.plans import windowed
from brindle.plans.config import FILTER_LEET, LEET, LOOKALIKE, Action, Config, Filter, Rule, default_config, normal_term
from brindle.sources.messages import MESSAGES_SQL, conversation_messages, document_messages, read
from brindle.streaming import audit, codec, processor

BASE = default_config()
WARN = (Action("WARN", message="Please follow the server chat rules."),)
KICK = (Action("KICK", reason="Repeated chat violations."),)
COMMAND = (Action("EXECUTE_COMMAND", command="tempban {player} 1d {rule} {points}"),)
THRESHOLDS = ((2, WARN), (5, WARN + KICK), (10, KICK), (20, COMMAND))
#: The benign pack: id, mode, terms, exceptions, points.
PACK = (
    ("fx.word", "WORD", ("the",), (), 2),
    ("fx.phrase", "PHRASE", ("of the",), (), 1),
    ("fx.substring", "SUBSTRING", ("tion",), (), 1),
    ("fx.compact", "COMPACT", ("andthe",), (), 1),
    ("fx.nword", "NORMALIZED_WORD", ("that",), (), 2),
    ("fx.nphrase", "NORMALIZED_PHRASE", ("und die",), (), 2),
    ("fx.cword", "COMPACT_WORD", ("ofthe",), (), 1),
    ("fx.cphrase", "COMPACT_PHRASE", ("for the",), (), 1),
    ("fx.except", "WORD", ("and",), ("and the",), 1),
)


def pack_filter(name: str, mode: str, terms: tuple, exceptions: tuple, points: int) -> Filter:
    value = lambda t: normal_term(t, mode, BASE.normalization)
    return Filter(name, mode, tuple(map(value, terms)), Rule(points, (Action("NOTIFY_STAFF"),)), exceptions=tuple(map(value, exceptions)))


FILTERS = tuple(pack_filter(*f) for f in PACK)
#: The flagship slice: length, capitals, duplicates, scores, thresholds.
SLICE = replace(BASE.only("message_length", "caps", "duplicate_spam"), thresholds=THRESHOLDS)


def forms(spark: SparkSession, sf_dir: str, config: Config = BASE) -> DataFrame:
    return detectors.with_forms(document_messages(spark, sf_dir), config)


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed.evaluate(document_messages(spark, sf_dir), SLICE)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# --- text -------------------------------------------------------------------------------------------------------------

CANONICAL = r"lower(trim(regexp_replace(regexp_replace(raw, '[\p{Cf}\p{Co}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F]', '', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')))"


def _translate(sql: str, table: dict[str, str]) -> str:
    quote = lambda s: s.replace("'", "''")
    return f"translate({sql}, '{quote(''.join(table))}', '{quote(''.join(table.values()))}')"


FORMS_SQL = f"""
WITH {MESSAGES_SQL},
n AS (SELECT *, {CANONICAL} AS canonical FROM m),
f AS (SELECT *, {_translate(_translate("canonical", LOOKALIKE), LEET)} AS deobfuscated FROM n),
c AS (SELECT *, regexp_replace(deobfuscated, '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS compact FROM f)
"""
COLLAPSE = "array_to_string(list_filter({0}, lambda x, i: i <= 2 OR {1} NOT (x = {0}[i - 1] AND x = {0}[i - 2])), '')"
FILTER_SQL = f"""
WITH {MESSAGES_SQL},
k AS (SELECT *, lower(regexp_replace(raw, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g')) AS clean FROM m),
s AS (SELECT *, string_split(trim(regexp_replace(replace({_translate(_translate("clean", LOOKALIKE), FILTER_LEET)}, 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), '') AS ch,
             string_split(trim(regexp_replace(replace({_translate(_translate("clean", LOOKALIKE), {k: v for k, v in FILTER_LEET.items() if k.isdigit()})}, 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), '') AS cp FROM k),
v AS (SELECT *, {COLLAPSE.format("ch", "x = ' ' OR")} AS ft, {COLLAPSE.format("cp", "x = ' ' OR")} AS fp FROM s)
"""


def each(rows: DataFrame, found: str) -> DataFrame:
    """A row per element ``m`` of the array ``found``. A filter that Spark infers for an inner explode, or pushes below a
    projection, would compute the whole chain of forms again, for each name in it; it stops at an outer one."""
    return rows.select("*", F.explode_outer(found).alias("m")).where("m is not null")


def hits(rows: DataFrame, value) -> DataFrame:
    """Rows where ``value`` (as ``m``) is not null, for the same reason."""
    return each(rows.withColumn("_found", F.array(value)), "_found").drop("_found")


def normalize_forms(spark, sf_dir):
    return forms(spark, sf_dir).select("player_id", "seq", "canonical", "deobfuscated", "compact", "collapsed")


def filter_text_forms(spark, sf_dir):
    m = document_messages(spark, sf_dir)
    one = text.filter_text(F.col("raw"), LOOKALIKE, FILTER_LEET)
    two = text.filter_text(F.col("raw"), LOOKALIKE, FILTER_LEET, punctuation=True)
    return m.select("player_id", "seq", one.alias("normalized"), two.alias("punctuated"), F.size(text.tokens(one)).alias("n_tokens"))


def link_forms(spark, sf_dir):
    return advertised(spark, sf_dir).select("player_id", "seq", "link_normalized", F.array_join("flags", ",").alias("flags"))


def text_bounds(spark, sf_dir):
    m = document_messages(spark, sf_dir)
    return m.select("player_id", "seq", text.bounded(F.col("raw"), 160).alias("bounded"), text.sanitize_stored(F.col("raw")).alias("stored"), text.escape_markup(F.col("raw"), 512).alias("escaped"))


def duration_formats(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", (F.col("event_id") * 37 % 200_000).alias("s"))
    return e.select("event_id", text.format_short(F.col("s")).alias("short"), text.format_compact(F.col("s")).alias("full"), text.parse_duration(text.format_short(F.col("s"))).alias("parsed"))


# --- detectors --------------------------------------------------------------------------------------------------------


def detect_length(spark, sf_dir):
    return hits(document_messages(spark, sf_dir), detectors.message_length(BASE)).select("player_id", "seq", "m.rule_id", "m.points", F.col("m.value").cast("long").alias("n"))


def detect_caps(spark, sf_dir):
    return hits(document_messages(spark, sf_dir), detectors.caps(BASE)).select("player_id", "seq", "m.rule_id", "m.points")


RUNS = BASE.with_rule("repeated_characters", maximum_repeated_letters=2, maximum_repeated_symbols=2)


def detect_repeated_characters(spark, sf_dir):
    """At the default limits, over lines to which some add runs of symbols at the limit and beyond."""
    m = document_messages(spark, sf_dir)
    m = m.withColumn("raw", F.when(F.col("seq") % 6 == 1, F.concat("raw", F.lit(" ========"))).when(F.col("seq") % 6 == 2, F.concat("raw", F.lit(" ==========!"))).otherwise(F.col("raw")))
    return hits(m, detectors.repeated_characters(BASE)).select("player_id", "seq", "m.value")


def detect_short_runs(spark, sf_dir):
    """At limits of two."""
    return hits(document_messages(spark, sf_dir), detectors.repeated_characters(RUNS)).select("player_id", "seq", "m.value")


def advertised(spark, sf_dir):
    """Lines with a host, an address or an invite in front of some: known, country and unknown domains, allowed and excluded ones."""
    m = document_messages(spark, sf_dir)
    fronts = F.array(*[F.lit(x) for x in FRONTS])
    m = m.withColumn("raw", F.concat(F.coalesce(F.get(fronts, (F.pmod(F.col("seq") * 5 + F.col("player_id"), F.lit(3 * len(FRONTS)))).cast("int")), F.lit("")), "raw"))
    return detectors.with_forms(m, BASE)


#: Fronts of lines, each of one in ``3 * len(FRONTS)``.
FRONTS = (
    "foo.it ", "shop.example.jp/a ", "file.zip ", "http://host.zip ", "www.own.zzz ", "example.org ", "sub.example.org x.example.org.evil.com ", "see (foo [.] com) ", "a dot net ", "b dot nothing ",
    "1 . 2 . 3 . 4 : 65535 ", "1.2.3.4:70000 ", "300.1.1.1 ", "9.9.9.9.9 ", "x1.2.3.4 ", "discord.gg/abc-1 ", "https://www.discord.com/invite/zz ", "discord . gg / q7 ", "xdiscord.gg/abc ", "discord.gg/a ", "xn--a.xn--p1ai ", "a . b . c . de ", "e x a m p l e . com ",
)


def detect_advertising(spark, sf_dir):
    m = detectors.with_advertising(advertised(spark, sf_dir), BASE)
    return each(m, "m_ads").select("player_id", "seq", "m.rule_id", "m.points", "m.value")


def detect_ip(spark, sf_dir):
    return hits(advertised(spark, sf_dir), detectors.address(F.col("canonical"))).select("player_id", "seq", F.col("m").alias("value"))


def detect_domain(spark, sf_dir):
    return hits(advertised(spark, sf_dir), detectors.domain(F.col("link_normalized"), ["example.org"])).select("player_id", "seq", F.col("m").alias("value"))


def detect_invite(spark, sf_dir):
    return hits(advertised(spark, sf_dir), detectors.invite(F.col("link_normalized"))).select("player_id", "seq", F.col("m").alias("value"))


def host_allowlist(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), detectors.host_allowed(host, ["example.org", "example.net"]).alias("allowed"))


def duplicate_spam(spark, sf_dir):
    return hits(detectors.with_history(forms(spark, sf_dir), BASE), detectors.duplicate(BASE)).select("player_id", "seq", "m.rule_id", "m.value")


def rapid_spam(spark, sf_dir):
    return hits(detectors.with_history(forms(spark, sf_dir), BASE), detectors.rapid(BASE)).select("player_id", "seq", "m.evidence", F.col("m.value").cast("long").alias("n"))


def similarity_containment(spark, sf_dir):
    """Word containment of each line with the one before."""
    m = detectors.with_history(forms(spark, sf_dir), BASE).withColumn("p", F.try_element_at("recent", F.lit(-1))["clear"]).where("p is not null")
    now = text.truncate(F.col("deobfuscated"), 512)
    return m.select("player_id", "seq", F.round(similarity.token_containment(now, F.col("p")), 6).alias("containment"))


def similarity_spam(spark, sf_dir):
    m = detectors.similar_recent(detectors.with_history(forms(spark, sf_dir), BASE), BASE)
    return hits(m, F.col("similar")).select("player_id", "seq", "similar")


# --- filters ----------------------------------------------------------------------------------------------------------


def _filtered(*chosen: Filter):
    def query(spark, sf_dir):
        m = filters.with_filters(forms(spark, sf_dir), replace(BASE, filters=chosen))
        return each(m, "filtered").select("player_id", "seq", "m.rule_id", "m.value")

    return query


PATTERN = Filter("fx.pattern", "BUILT_IN_PATTERN", (), Rule(1), patterns=("badword_family",))


def filter_builtin_pattern(spark, sf_dir):
    """Over lines to which every fifth adds a disguised word of the family."""
    m = document_messages(spark, sf_dir)
    m = m.withColumn("raw", F.when(F.col("seq") % 5 == 0, F.concat("raw", F.lit(" B.4.d w0rdz"), F.lit(" baddw0rds"))).otherwise(F.col("raw")))
    m = filters.with_filters(detectors.with_forms(m, BASE), replace(BASE, filters=(PATTERN,)))
    return each(m, "filtered").select("player_id", "seq", "m.value")


#: 10,000 terms of four syllables of the test data's prose.
SYLLABLES = "th an ti er on ha st nd en ed".split()
MANY_TERMS = tuple(map("".join, itertools.product(SYLLABLES, repeat=4)))


def filter_many_words(spark, sf_dir):
    """The first of 10,000 terms that is a word of a message."""
    return _filtered(Filter("fx.many", "WORD", MANY_TERMS, Rule(1)))(spark, sf_dir)


def filter_many_substrings(spark, sf_dir):
    """The first of 10,000 terms that a message holds anywhere."""
    return _filtered(Filter("fx.many", "SUBSTRING", MANY_TERMS, Rule(1)))(spark, sf_dir)


def filter_exceptions(spark, sf_dir):
    m = filters.with_filters(forms(spark, sf_dir), replace(BASE, filters=(FILTERS[8],)))
    return each(m, "prevented").select("player_id", "seq", "m.rule_id", "m.exception")


# --- scores, actions, history -----------------------------------------------------------------------------------------


def match_union(spark, sf_dir):
    return sliced(spark, sf_dir).select("player_id", "seq", F.posexplode("matches").alias("pos", "m")).select("player_id", "seq", "pos", "m.rule_id", "m.category", "m.severity", "m.points")


def rule_counts(spark, sf_dir):
    return match_union(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


def category_severity_rollup(spark, sf_dir):
    m = match_union(spark, sf_dir).rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    return m.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


def score_transition(spark, sf_dir):
    return sliced(spark, sf_dir).select("player_id", "seq", "points_before", "points_added", "points_after")


def threshold_crossing(spark, sf_dir):
    return sliced(spark, sf_dir).where("threshold_crossed is not null").select("player_id", "seq", F.col("threshold_crossed"))


def moderate_slice(spark, sf_dir):
    return sliced(spark, sf_dir).select("player_id", "seq", F.size("matches").alias("n_matches"), "points_after", "threshold_crossed", "decision")


POINTS = {"view": 0, "click": 1, "signup": 1, "purchase": 2, "error": 5}


def _event_scores(spark, sf_dir):
    """Events as messages of one match each, scored with a decay of a day."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("player_id"), F.col("event_id").alias("seq"), "ts", "event_type")
    points = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in POINTS.items()]).cast("long")
    one = F.transform(F.array(points, points), lambda p: F.struct(F.col("event_type").alias("rule_id"), p.alias("points")))
    return windowed.with_score(e.withColumn("matches", one), replace(BASE, decay_seconds=86_400, cap=6))


def point_cap(spark, sf_dir):
    return _event_scores(spark, sf_dir).select("player_id", "seq", "points_before", "points_added", "points_after")


def action_plan(spark, sf_dir):
    e = sliced(spark, sf_dir)
    return e.select("player_id", "seq", "decision", "severity", F.array_join(F.transform("actions", lambda a: a["type"]), ",").alias("actions"))


def decision_summary(spark, sf_dir):
    e = sliced(spark, sf_dir)
    return e.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("points_added").alias("points"), F.count("threshold_crossed").alias("crossings"))


def template_expand(spark, sf_dir):
    e = sliced(spark, sf_dir).where("threshold_crossed = 20")
    rule = F.get("matches", F.lit(0))["rule_id"]
    return e.select("player_id", "seq", text.template(COMMAND[0].command, player=F.concat(F.lit("{rule}"), "player_id"), points=F.col("points_after"), rule=rule, uuid=F.col("player_id")).alias("command"))


def now():
    """A minute after a player's first hour begins."""
    return F.timestamp_millis(F.col("player_id") * 3_600_000 + F.lit(1_704_067_200_000 + 60_000))


def violation_history(spark, sf_dir):
    v = history.violations(sliced(spark, sf_dir), store_original=True)
    return v.select("player_id", "seq", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join("categories", ",").alias("categories"), "severity", "decision", "points_added", "score_after", "original_message")


def history_page(spark, sf_dir):
    v = history.retained(history.violations(sliced(spark, sf_dir)), now(), 30, 100)
    return history.page(v, F.lit(2), 6, clamp=True).select("player_id", "seq", "place", "page", "total_entries", "total_pages")


def history_page_core(spark, sf_dir):
    v = history.retained(history.violations(sliced(spark, sf_dir)), now(), 30, 100)
    return history.page(v, F.lit(2), 10, clamp=False).select("player_id", "seq", "place", "total_entries", "total_pages")


def history_retention(spark, sf_dir):
    v = history.retained(history.violations(sliced(spark, sf_dir)), now() + F.make_dt_interval(days=F.lit(30)), 30, 5)
    return v.groupBy("player_id").agg(F.count(F.lit(1)).alias("kept"), F.max("seq").alias("newest"))


def active_violations(spark, sf_dir):
    return history.active_entries(sliced(spark, sf_dir), now(), 60).select("player_id", "seq", "points_added", "active_score", "place")


def max_score_entries(spark, sf_dir):
    return history.most_entries(sliced(spark, sf_dir), now(), 60)


# --- lookups, cases ---------------------------------------------------------------------------------------------------


def mute_gate(spark, sf_dir):
    """Events outside of 12-hour mutes that errors open."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("player_id"), F.col("event_id").alias("seq"), "ts", "event_type")
    opened = e.where("event_type = 'error'").select("player_id", (F.col("ts") + F.make_dt_interval(secs=F.lit(1))).alias("muted_at"), (F.col("ts") + F.make_dt_interval(hours=F.lit(12))).alias("muted_until"))
    return lookups.muted(e, opened).select("player_id", "seq")


def bypass_filter(spark, sf_dir):
    """System turns pass unseen; assistants bypass what floods."""
    m = conversation_messages(spark, sf_dir)
    m = m.withColumns({"bypass_all": F.col("role") == "system", "bypass": F.when(F.col("role") == "assistant", F.array(F.lit("FLOODING"))).otherwise(F.array().cast("array<string>"))})
    e = windowed.evaluate(m, SLICE)
    return e.select("player_id", "seq", "decision", F.coalesce("points_added", F.lit(0)).alias("points_added"))


def _players(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))


def suggest_names(spark, sf_dir):
    return history.suggest_names(_players(spark, sf_dir), "cust").select("name")


def lookup_permission(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("player_id")).distinct()
    asked = e.withColumns({"node": F.lit("alerts"), "operator_level": (F.col("player_id") % 5).cast("int")})
    given = e.where("player_id % 3 = 0").select("player_id", F.lit("alerts").alias("node"), (F.col("player_id") % 2 == 0).alias("value"))
    return lookups.permission(asked, given, 3).select("player_id", "allowed", "origin")


def tier_s_evaluate(spark, sf_dir):
    """The flagship slice by the stateful tier."""
    e = processor.evaluate(document_messages(spark, sf_dir), SLICE)
    return e.select(F.col("player_id").cast("long").alias("player_id"), "seq", "decision", "points_before", "points_added", "threshold_crossed")


def auto_mute_feedback(spark, sf_dir):
    """With a threshold that mutes for five seconds: muted messages are neither judged nor remembered."""
    mute = replace(SLICE, thresholds=((2, (Action("MUTE", seconds=5, reason="Repeated chat violations."),)),))
    e = processor.evaluate(document_messages(spark, sf_dir), mute)
    return e.select("player_id", "seq", "decision", "points_added", F.array_join("actions", ",").alias("actions"))


#: Length and capitals, scores and thresholds: what a snapshot keeps of the rules.
KEPT = replace(BASE.only("message_length", "caps"), thresholds=THRESHOLDS, state={**BASE.state, "maximum_tracked_players": 1_000_000})
RESTART = 10


def snapshot_from_state(spark, sf_dir):
    """Messages up to the tenth by one engine, its state written as a snapshot, the rest by an engine that starts from it."""
    m, at = document_messages(spark, sf_dir), F.timestamp_millis(F.lit(1_704_067_200_000))
    path = audit.shared_path(spark, "snapshot")
    codec.save(processor.states(m.where(F.col("seq") <= RESTART), KEPT), path, at, KEPT)
    e = processor.evaluate(m.where(F.col("seq") > RESTART), KEPT, initial=codec.restore(spark, path, at, KEPT))
    return e.select(F.col("player_id").cast("long").alias("player_id"), "seq", "decision", "points_before", "points_added", "points_after", "threshold_crossed")


def audit_daily_counts(spark, sf_dir):
    rows = audit.audit_rows(history.violations(sliced(spark, sf_dir)))
    return rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("points_added").alias("points"))


QUERIES = {
    q.__name__: q
    for q in (
        moderate_slice, normalize_forms, filter_text_forms, link_forms, text_bounds, duration_formats, detect_length, detect_caps, detect_repeated_characters, detect_short_runs, detect_advertising, detect_ip, detect_domain, detect_invite,
        host_allowlist, duplicate_spam, rapid_spam, similarity_containment, similarity_spam, filter_builtin_pattern, filter_many_words, filter_many_substrings, filter_exceptions, match_union, rule_counts, category_severity_rollup, score_transition,
        threshold_crossing, point_cap, action_plan, decision_summary, template_expand, violation_history, history_page, history_page_core, history_retention, active_violations, max_score_entries, mute_gate, bypass_filter,
        suggest_names, lookup_permission, tier_s_evaluate, auto_mute_feedback, snapshot_from_state, audit_daily_counts,
    )
}
QUERIES |= {f"filter_{f.mode.lower()}": _filtered(f) for f in FILTERS[:8]}
