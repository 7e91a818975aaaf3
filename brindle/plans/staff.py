"""Registered queries of staff operations, state and limits, each beside its SQL."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import similarity
from brindle.operators import actions, alerts, cases, detectors, history, lookups
from brindle.plans import asof, oracles, windowed
from brindle.plans import config as C
from brindle.plans import queries as q
from brindle.sources.messages import document_messages, read
from brindle.streaming import audit, processor

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str | None):
    """Registers a query under its name, with SQL where there is any."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.events(spark, sf_dir).groupBy(F.col("user_id").alias("player_id")).agg(F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("n"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))


# --- lookups ----------------------------------------------------------------------------------------------------------

CATS = "list_sort(list_concat(CASE WHEN s THEN ['SPAM', 'DUPLICATE', 'SIMILARITY', 'FLOODING'] ELSE [] END, CASE WHEN f THEN ['FILTERED_CONTENT'] ELSE [] END, CASE WHEN d THEN ['ADVERTISING'] ELSE [] END, CASE WHEN x THEN ['SECURITY'] ELSE [] END))"


@registered(f"""WITH u AS (SELECT DISTINCT user_id AS player_id, user_id % 5 >= 4 AS op FROM events),
  p AS (SELECT player_id, CASE WHEN player_id % 11 = 0 THEN player_id % 2 = 0 ELSE op END AS a, CASE WHEN player_id % 3 = 0 THEN true ELSE op END AS s, CASE WHEN player_id % 4 = 0 THEN player_id % 8 = 0 ELSE op END AS f,
    CASE WHEN player_id % 6 = 0 THEN true ELSE op END AS d, CASE WHEN player_id % 10 = 4 THEN false WHEN player_id % 7 = 0 THEN true ELSE op END AS x FROM u)
  SELECT player_id, a AS bypass_all, CASE WHEN a THEN '' ELSE array_to_string({CATS}, ',') END AS bypass FROM p""")
def lookup_bypass(spark, sf_dir):
    """Five nodes, granted or denied to some; operators of level 4 bypass."""
    u = users(spark, sf_dir).select("player_id", (F.col("player_id") % 5).cast("int").alias("operator_level"))
    p = F.col("player_id")
    said = F.array(*[F.when(test, F.struct(F.lit(node).alias("node"), value.alias("value"))) for node, test, value in (
        ("bypass.all", p % 11 == 0, p % 2 == 0), ("bypass.spam", p % 3 == 0, F.lit(True)), ("bypass.filters", p % 4 == 0, p % 8 == 0), ("bypass.advertising", p % 6 == 0, F.lit(True)),
        ("bypass.security", p % 10 == 4, F.lit(False)), ("bypass.security", p % 7 == 0, F.lit(True)),
    )])
    explicit = u.select("player_id", F.explode_outer(F.array_compact(said)).alias("e")).where("e is not null").select("player_id", "e.node", "e.value")
    return lookups.bypass(u, explicit, 4, True).select("player_id", "bypass_all", F.array_join("bypass", ",").alias("bypass"))


@registered("""WITH k AS (SELECT c_custkey AS id, c_name AS name FROM customer),
  a AS (SELECT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN CAST(c_custkey * 2 AS VARCHAR) ELSE 'nobody ' || c_custkey END AS q FROM customer)
  SELECT a.q, CASE WHEN o.id IS NOT NULL THEN CAST(o.id AS VARCHAR) WHEN regexp_full_match(a.q, '[0-9]+') THEN a.q ELSE CAST(l.id AS VARCHAR) END AS player_id,
    CASE WHEN o.id IS NOT NULL THEN o.name WHEN regexp_full_match(a.q, '[0-9]+') THEN coalesce(s.name, a.q) ELSE l.name END AS name
  FROM a LEFT JOIN k o ON o.name = a.q AND o.id % 8 = 0 LEFT JOIN k s ON CAST(s.id AS VARCHAR) = a.q LEFT JOIN k l ON lower(l.name) = lower(a.q)""")
def lookup_target(spark, sf_dir):
    """Names as they are, in capitals, numbers of which half are nobody's, and unknown names."""
    k = names(spark, sf_dir)
    key = F.col("player_id")
    asked = k.select(F.when(key % 4 == 0, F.col("name")).when(key % 4 == 1, F.upper("name")).when(key % 4 == 2, (key * 2).cast("string")).otherwise(F.concat(F.lit("nobody "), key.cast("string"))).alias("q"))
    return lookups.target(asked, k.where("player_id % 8 = 0"), k, r"^[0-9]+$")


@registered("""SELECT event_id, user_id IN (3, 5, 8) OR user_id % 4 = 2 OR user_id % 9 = 0 AS allowed FROM events""")
def lookup_authorised(spark, sf_dir):
    """Three users by name, others by one of their roles; some have none."""
    e = q.events(spark, sf_dir)
    u = F.col("user_id")
    roles = F.when(u % 5 != 1, F.array_compact(F.array(F.when(u % 4 == 2, F.lit("staff")), F.when(u % 9 == 0, F.lit("admin")), F.lit("user"))))
    roles = F.when((u % 4 == 2) | (u % 9 == 0), F.coalesce(roles, F.array(F.lit("staff")))).otherwise(roles)
    return e.select("event_id", lookups.authorised(u.cast("string"), roles, ["3", "5", "8"], ["staff", "admin"]).alias("allowed"))


@registered("""WITH s AS (SELECT c_custkey AS recipient, c_custkey % 2 = 0 AS inspect FROM customer WHERE c_custkey <= 20 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0),
  a AS (SELECT event_id, event_id % 4 <> 0 AS shown, 'said ' || event_id AS original FROM events WHERE event_type = 'error')
  SELECT event_id, recipient, CASE WHEN inspect AND shown THEN original END AS original FROM a, s""")
def alert_recipients(spark, sf_dir):
    """Errors to the staff who are online and may see alerts."""
    k = F.col("player_id")
    staff = names(spark, sf_dir).where("player_id <= 20").select("player_id", (k % 3 != 0).alias("online"), (k % 5 != 0).alias("alerts"), (k % 2 == 0).alias("inspect"))
    a = q.events(spark, sf_dir).where("event_type = 'error'").select("event_id", (F.col("event_id") % 4 != 0).alias("show_original"), F.concat(F.lit("said "), F.col("event_id").cast("string")).alias("original"))
    return lookups.alert_recipients(a, staff)


@registered(r"""WITH x AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN repeat('ab', 200) ELSE '@every*one_' || user_id END AS name, user_id, event_type, event_id % 9 AS points, event_id % 3 AS k FROM events)
  SELECT event_id, CASE WHEN name = '' THEN 'unknown' WHEN length(name) > 256 THEN name[1:255] || '…' ELSE '@' || chr(8203) || 'every\*one\_' || user_id END AS player,
    CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'spam.rapid' ELSE 'spam.rapid, fx.a\_b' END AS rules, event_type AS decision, 6 + CASE WHEN k > 0 THEN 1 ELSE 0 END AS n_fields,
    CASE WHEN k = 2 THEN '' ELSE 'cam:case-' || event_id || ':m10,cam:case-' || event_id || ':ban,cam:case-' || event_id || ':dismiss' END AS buttons FROM x""")
def alert_embed(spark, sf_dir):
    """Events as alerts: names empty, too long, or with markup; some without a case or an original."""
    n, u = F.col("event_id"), F.col("user_id")
    name = F.when(n % 6 == 0, "").when(n % 6 == 1, F.lit("ab" * 200)).otherwise(F.concat(F.lit("@every*one_"), u.cast("string")))
    rules = F.array_compact(F.array(F.when(n % 3 > 0, "spam.rapid"), F.when(n % 3 == 2, "fx.a_b")))
    a = q.events(spark, sf_dir).select(
        "event_id", u.alias("player_id"), name.alias("player_name"), rules.alias("rule_ids"), F.upper("event_type").alias("decision"), (n % 9).alias("points_added"), n.alias("score_after"),
        F.when(n % 3 == 0, "").otherwise("said").alias("original"), F.when(n % 3 != 2, F.concat(F.lit("case-"), n.cast("string"))).alias("case_id"), "ts",
    )
    out = alerts.embedded(a, include_original=True, mention="7", enabled=("m10", "ban"))
    value = lambda i: F.get("fields", F.lit(i))["value"]
    return out.select("event_id", value(0).alias("player"), value(2).alias("rules"), value(3).alias("decision"), F.size("fields").alias("n_fields"), F.array_join(F.transform("buttons", lambda b: b["custom_id"]), ",").alias("buttons"))


# --- cases ------------------------------------------------------------------------------------------------------------

CLICKS = """c AS (SELECT user_id AS case_id, min(ts) AS opened_at FROM events WHERE event_type = 'signup' GROUP BY user_id),
  k AS (SELECT c.case_id, e.ts, e.event_id, CASE WHEN e.event_type = 'purchase' AND e.event_id % 2 = 0 THEN 'BAN' ELSE 'DISMISS' END AS action,
      CASE WHEN e.event_type = 'click' AND e.event_id % 3 = 0 THEN NULL WHEN e.event_type = 'click' THEN 'retry' WHEN e.event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome,
      row_number() OVER (PARTITION BY c.case_id ORDER BY e.ts, e.event_id) AS i
    FROM c JOIN events e ON e.user_id = c.case_id WHERE e.event_type IN ('click', 'error', 'purchase') AND e.ts >= c.opened_at AND e.ts < c.opened_at + INTERVAL 3 DAY),
  f AS (SELECT case_id, min(i) FILTER (outcome IS NULL OR outcome <> 'retry') AS i, max(i) AS n FROM k GROUP BY case_id),
  s AS (SELECT c.case_id, c.opened_at + INTERVAL 3 DAY AS expires_at, CASE WHEN k.case_id IS NOT NULL AND k.outcome IS NULL THEN 'PROCESSING' WHEN k.outcome = 'failed' THEN 'FAILED' WHEN k.action = 'DISMISS' THEN 'DISMISSED'
      WHEN k.case_id IS NOT NULL THEN 'RESOLVED' WHEN c.opened_at + INTERVAL 3 DAY <= TIMESTAMP '{now}' THEN 'EXPIRED' ELSE 'OPEN' END AS status,
      k.event_id AS claimed_by, CASE WHEN k.outcome IS NOT NULL THEN k.ts END AS closed_at, coalesce(f.i, f.n, 0) AS attempts
    FROM c LEFT JOIN f USING (case_id) LEFT JOIN k ON k.case_id = f.case_id AND k.i = f.i)"""
NOW = "2024-01-20 00:00:00"


def _cases(spark, sf_dir, now: str):
    e = q.events(spark, sf_dir)
    opened = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("case_id")).agg(F.min("ts").alias("opened_at"))
    opened = opened.withColumn("expires_at", F.col("opened_at") + F.make_dt_interval(days=F.lit(3)))
    kind, n = F.col("event_type"), F.col("event_id")
    clicks = e.where(kind.isin("click", "error", "purchase")).select(
        F.col("user_id").alias("case_id"), "ts", n.alias("seq"), n.alias("user_id"),
        F.when((kind == "purchase") & (n % 2 == 0), "BAN").otherwise("DISMISS").alias("action"),
        F.when((kind == "click") & (n % 3 == 0), F.lit(None)).when(kind == "click", "retry").when(kind == "error", "failed").otherwise("ok").alias("outcome"),
    )
    return cases.lifecycle(opened, clicks, F.lit(now).cast("timestamp"))


@registered(f"WITH {CLICKS.format(now='2030-01-01 00:00:00')} SELECT case_id, status, claimed_by, attempts FROM s")
def case_lifecycle(spark, sf_dir):
    """Each user's first signup opens a case for three days, on which later events click."""
    return _cases(spark, sf_dir, "2030-01-01 00:00:00").select("case_id", "status", "claimed_by", "attempts")


@registered(f"WITH {CLICKS.format(now=NOW)} SELECT count(*) FILTER (status IN ('OPEN', 'PROCESSING')) AS open_cases FROM s")
def open_cases(spark, sf_dir):
    return cases.open_count(_cases(spark, sf_dir, NOW))


@registered(f"WITH {CLICKS.format(now=NOW)} SELECT case_id, status FROM s WHERE status IN ('OPEN', 'PROCESSING') OR coalesce(closed_at, expires_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def purged_cases(spark, sf_dir):
    """Without those that ended more than seven days before."""
    return cases.purged(_cases(spark, sf_dir, NOW), F.lit(NOW).cast("timestamp")).select("case_id", "status")


STATUSES = ("OPEN", "PROCESSING", "EXPIRED", "RESOLVED")


@registered("""WITH e AS (SELECT event_id AS n, CASE event_id % 13 WHEN 0 THEN 'other:1' WHEN 1 THEN 'cam:short:ban' WHEN 2 THEN 'cam:case-0001:nothing' WHEN 3 THEN 'cam:case-0001:m60:x' WHEN 4 THEN 'cam:case-0001:m60' ELSE 'cam:case-0001:ban' END AS c FROM events)
  SELECT n AS event_id, CASE WHEN n % 17 = 0 THEN 'NOT_READY' WHEN n % 19 = 0 THEN 'WRONG_GUILD' WHEN n % 23 = 0 THEN 'WRONG_CHANNEL' WHEN n % 13 = 0 THEN 'IGNORED' WHEN n % 13 IN (1, 2, 3) THEN 'MALFORMED'
    WHEN n % 5 = 0 THEN 'UNAUTHORISED' WHEN n % 13 = 4 THEN 'ACTION_DISABLED' WHEN n % 7 = 0 THEN 'UNKNOWN_CASE' WHEN n % 4 = 2 THEN 'EXPIRED' WHEN n % 4 <> 0 THEN 'NOT_OPEN' WHEN n % 3 = 0 THEN 'MESSAGE_MISMATCH' ELSE 'CLAIMED' END AS outcome FROM e""")
def click_routing(spark, sf_dir):
    """Events as clicks that fail each of the checks in turn."""
    n = F.col("event_id")
    custom = F.when(n % 13 == 0, "other:1").when(n % 13 == 1, "cam:short:ban").when(n % 13 == 2, "cam:case-0001:nothing").when(n % 13 == 3, "cam:case-0001:m60:x").when(n % 13 == 4, "cam:case-0001:m60").otherwise("cam:case-0001:ban")
    clicks = q.events(spark, sf_dir).select(
        "event_id", (n % 17 != 0).alias("ready"), F.when(n % 19 != 0, "g").alias("guild_id"), F.when(n % 23 == 0, "x").otherwise("c").alias("channel_id"), custom.alias("custom_id"), F.lit("m1").alias("message_id"),
        F.when(n % 7 != 0, F.get(F.array(*[F.lit(s) for s in STATUSES]), (n % 4).cast("int"))).alias("case_status"), F.when(n % 3 == 0, F.when(n % 2 == 0, "m2")).otherwise("m1").alias("case_message_id"),
    )
    return cases.route(clicks, "g", "c", n % 5 != 0, ("m10", "ban", "dismiss")).select("event_id", "outcome")


@registered("""WITH r AS (SELECT user_id AS player_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error' AND user_id % 10 <> 0)
  SELECT player_id, ts AS banned_at, 'mod' || (event_id % 3) || ' (Discord ' || event_id || ')' AS source, 'because of ' || event_id AS reason FROM r WHERE i = 1
  UNION ALL SELECT DISTINCT user_id, TIMESTAMP '2023-01-01 00:00:00', 'before', 'old' FROM events WHERE user_id % 10 = 0""")
def punish_ban(spark, sf_dir):
    """Errors ask for bans; every tenth user is banned already."""
    e = q.events(spark, sf_dir)
    held = e.where("user_id % 10 = 0").select(F.col("user_id").alias("player_id")).distinct()
    held = held.select("player_id", F.lit("2023-01-01 00:00:00").cast("timestamp").alias("banned_at"), F.lit("before").alias("source"), F.lit("old").alias("reason"))
    n = F.col("event_id")
    asked = e.where("event_type = 'error'").select(F.col("user_id").alias("player_id"), "ts", n.alias("seq"), F.concat(F.lit("mod"), (n % 3).cast("string")).alias("moderator"), n.alias("moderator_id"), F.concat(F.lit("because of "), n.cast("string")).alias("reason"))
    return cases.banned(held, asked)


@registered("""SELECT event_id, 'moderation_action' AS event_type, ts::DATE AS event_date, 'case ' || user_id AS case_id, 'line one line two' AS reason, '' AS result FROM events WHERE event_type = 'purchase'""")
def audit_actions(spark, sf_dir):
    """Purchases as staff actions, with reasons of two lines."""
    text_ = lambda s: F.lit(s).cast("string")
    a = q.events(spark, sf_dir).where("event_type = 'purchase'").select(
        "event_id", F.concat(F.lit("case "), F.col("user_id").cast("string")).alias("case_id"), "ts", F.col("user_id").alias("player_id"), text_("p").alias("player_name"), text_("BAN").alias("action"), F.lit(None).cast("long").alias("duration_seconds"),
        text_("line one\nline \x07two").alias("reason"), F.array(F.lit("r")).alias("rule_ids"), text_("s").alias("moderator_source"), text_("i").alias("moderator_id"), text_("n").alias("moderator_name"), F.lit(True).alias("success"), text_(None).alias("result"),
    )
    return audit.action_rows(a).select("event_id", "event_type", "event_date", "case_id", "reason", "result")


@registered(f"""WITH r AS (SELECT ts::DATE AS d FROM events) SELECT d AS event_date, count(*) AS n FROM r WHERE d >= DATE '{NOW[:10]}' - 5 GROUP BY d""")
def audit_retention(spark, sf_dir):
    """The log's days that a retention of five days keeps."""
    log = q.events(spark, sf_dir).withColumn("event_date", F.to_date("ts"))
    return audit.retained_days(log, F.lit(NOW[:10]).cast("date"), 5).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


# --- state ------------------------------------------------------------------------------------------------------------

E = oracles.E
LAST = f"{E}, w AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ms DESC, seq DESC) AS r, max(ms) OVER (PARTITION BY player_id) AS active FROM e)"


@registered(f"{LAST} SELECT player_id, seq, decision, points_before, points_added, threshold_crossed FROM w WHERE r = 1")
def preview(spark, sf_dir):
    """Each player's last message, previewed by the state that those before it left."""
    m = document_messages(spark, sf_dir)
    newest = m.groupBy("player_id").agg(F.max(F.struct("ts", "seq")).alias("x")).select("player_id", "x.ts", "x.seq")
    kept = processor.states(m.join(newest, ["player_id", "ts", "seq"], "left_anti"), q.SLICE)
    out = processor.preview(m.join(newest, ["player_id", "ts", "seq"], "left_semi"), kept, q.SLICE)
    return out.select(F.col("player_id").cast("long").alias("player_id"), "seq", "decision", "points_before", "points_added", "threshold_crossed")


#: An instant at which some players are idle, some hold scores still, and some are yet to come.
PRUNED_AT = 1_704_067_200_000 + 500 * 3_600_000


@registered(f"""{LAST}, g AS (SELECT player_id, max(active) AS active, count(*) FILTER (hit AND ms >= {PRUNED_AT} - 2592000000) AS records, coalesce(sum(points_added) FILTER (ms > {PRUNED_AT} - 1800000), 0)::BIGINT AS score,
    max(points_after) FILTER (r = 1) >= 2 AS crossed, least(count(*) FILTER (ms >= active - 45000), 8) AS seen FROM w GROUP BY player_id)
  SELECT player_id, records, score, CASE WHEN active < {PRUNED_AT} - 1800000 THEN 0 ELSE seen END AS buffered FROM g WHERE active >= {PRUNED_AT} - 1800000 OR records > 0 OR score > 0 OR crossed""")
def prune(spark, sf_dir):
    """States pruned: idle players go unless something durable is left, and their buffers go."""
    kept = processor.prune(processor.states(document_messages(spark, sf_dir), ROOMY), PRUNED_AT * 1_000, ROOMY)
    s = F.from_json("state", "entries array<struct<points:bigint>>, violations array<struct<ts:bigint>>, recent array<struct<ts:bigint>>")
    return kept.withColumn("s", s).select(F.col("player_id").cast("long").alias("player_id"), F.size("s.violations").cast("long").alias("records"), F.aggregate("s.entries", F.lit(0).cast("long"), lambda a, x: a + x["points"]).alias("score"), F.size("s.recent").cast("long").alias("buffered"))


#: The slice with room for all records of a player.
ROOMY = replace(q.SLICE, history={**q.SLICE.history, "maximum_entries_per_player": 10_000})


@registered(f"""{E}, g AS (SELECT player_id, count(*) FILTER (points_added > 0 AND ms > {PRUNED_AT} - 1800000) AS scores, coalesce(sum(points_added) FILTER (ms > {PRUNED_AT} - 1800000), 0)::BIGINT AS points,
    least(count(*) FILTER (hit AND ms >= {PRUNED_AT} - 10 * 86400000), 5) AS records, max(seq) FILTER (hit AND ms >= {PRUNED_AT} - 10 * 86400000) AS newest FROM e GROUP BY player_id)
  SELECT player_id, CASE WHEN player_id % 9 = 0 THEN 'PERMANENT' WHEN player_id % 7 = 0 AND player_id % 2 = 0 THEN 'TEMPORARY' END AS mute, scores, points, records, newest FROM g
  WHERE player_id % 9 = 0 OR player_id % 7 = 0 AND player_id % 2 = 0 OR scores > 0 OR records > 0 OR player_id % 3 = 0""")
def snapshot_round_trip(spark, sf_dir):
    """Players' states as they are kept (ten days, five records), written and read again."""
    m = windowed.evaluate(document_messages(spark, sf_dir), q.SLICE)
    key, at = F.col("player_id"), F.timestamp_millis(F.lit(PRUNED_AT))
    entry = F.when(F.col("points_added") > 0, F.struct(F.col("points_added").alias("points"), F.lit("r").alias("rule_id"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(mins=F.lit(30))).alias("expires_at")))
    rules = F.transform("matches", lambda x: x["rule_id"])
    record = F.when(F.size("matches") > 0, F.struct("ts", "seq", rules.alias("rule_ids"), F.transform("matches", lambda x: x["category"]).alias("categories"), "severity", "decision", "points_added", F.col("points_after").alias("score_after"), F.transform("actions", lambda x: x["type"]).alias("actions"), F.col("raw").alias("original_message")))
    by = m.groupBy("player_id").agg(F.sort_array(F.collect_list(entry)).alias("score_entries"), F.sort_array(F.collect_list(record)).alias("violations"))
    kind = F.when(key % 9 == 0, "PERMANENT").when(key % 7 == 0, "TEMPORARY")
    until = F.when(key % 9 != 0, F.when(key % 2 == 0, at + F.make_dt_interval(secs=F.lit(1))).otherwise(at))
    none = F.lit(None).cast("string")
    mute = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.timestamp_millis(F.lit(0)).alias("muted_at"), until.alias("muted_until"), F.lit("").alias("reason"), F.lit("STAFF").alias("source"), F.lit("").alias("rule_id"), none.alias("moderator_id")))
    states = by.select(key.cast("string").alias("player_id"), F.when(key % 3 == 0, F.concat(F.lit("name "), key.cast("string"))).otherwise(" ").alias("name"), mute.alias("mute"), "score_entries", F.array().cast("array<bigint>").alias("crossed_thresholds"), "violations")
    config = replace(q.SLICE, history={"maximum_entries_per_player": 5, "retention_days": 10})
    back = audit.copied(audit.kept(states, at, config), audit.SNAPSHOT)
    total = F.aggregate("score_entries", F.lit(0).cast("long"), lambda a, x: a + x["points"])
    newest = F.element_at(F.transform("violations", lambda v: v["seq"]), -1)
    return back.select(F.col("player_id").cast("long").alias("player_id"), F.col("mute.kind").alias("mute"), F.size("score_entries").cast("long").alias("scores"), total.alias("points"), F.size("violations").cast("long").alias("records"), F.when(F.size("violations") > 0, newest).alias("newest"))


@registered(f"{LAST} SELECT player_id, array_to_string(list_filter([2, 5, 10, 20], lambda t: t <= points_after), ',') AS crossed FROM w WHERE r = 1")
def crossed_set(spark, sf_dir):
    """The thresholds that each player's score has reached at the last message."""
    m = windowed.evaluate(document_messages(spark, sf_dir), q.SLICE)
    last = m.groupBy("player_id").agg(F.max_by("points_after", F.struct("ts", "seq")).alias("after"))
    got = history.crossed(F.col("after"), [t for t, _ in q.THRESHOLDS])
    return last.select("player_id", F.array_join(F.transform(got, lambda t: t.cast("string")), ",").alias("crossed"))


@registered(f"""WITH x AS (SELECT user_id AS player_id, event_id, ts, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 5 ELSE 0 END AS points FROM events),
  l AS (SELECT *, sum(points) OVER (PARTITION BY player_id) AS score, count(*) OVER (PARTITION BY player_id) AS total_entries, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, event_id) AS place
    FROM x WHERE points > 0 AND ts + INTERVAL 6 DAY > TIMESTAMP '{NOW}')
  SELECT player_id, event_id, score::BIGINT AS score, total_entries, player_id % 3 = 0 OR player_id % 4 = 1 AS muted, CASE WHEN player_id % 5 = 0 THEN '2,10' ELSE '' END AS crossed
  FROM l WHERE place > (least(2, ceil(total_entries / 6)) - 1) * 6 AND place <= least(2, ceil(total_entries / 6)) * 6""")
def violations_page(spark, sf_dir):
    """The second page of what still counts against each user, with mutes (some for ever, some ended) and thresholds."""
    e = q.events(spark, sf_dir)
    points = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in q.POINTS.items()]).cast("long")
    # Rules are numbered so that ties of time keep the order of events.
    entries = e.select(F.col("user_id").alias("player_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("rule_id"), points.alias("points"), F.col("ts").alias("created"), (F.col("ts") + F.make_dt_interval(days=F.lit(6))).alias("expires")).where("points > 0")
    key, at = F.col("player_id"), F.lit(NOW).cast("timestamp")
    u = users(spark, sf_dir).select("player_id", ((key % 3 == 0) | (key % 4 <= 1)).alias("muted"), F.when(key % 3 != 0, F.when(key % 4 == 1, at + F.make_dt_interval(secs=F.lit(1))).otherwise(at)).alias("muted_until"), F.when(key % 5 == 0, F.array(F.lit(10), F.lit(2)).cast("array<bigint>")).alias("crossed"))
    out = history.active_page(entries, u, at, F.lit(2))
    return out.select("player_id", F.col("rule_id").cast("long").alias("event_id"), "score", "total_entries", "muted", F.array_join(F.transform("crossed", lambda t: t.cast("string")), ",").alias("crossed"))


@registered("SELECT count(DISTINCT doc_id) AS tracked_players, 9 AS active_filters FROM documents WHERE length(trim(text)) > 0")
def status_summary(spark, sf_dir):
    return history.status(document_messages(spark, sf_dir), replace(q.BASE, filters=q.FILTERS))


@registered(f"{oracles.LONG} SELECT player_id, seq, rule_id FROM x WHERE pos < 2")
def limit_preview(spark, sf_dir):
    """At most two matches of each message, in order."""
    m = windowed.evaluate(document_messages(spark, sf_dir), q.SLICE)
    return q.each(m.select("player_id", "seq", history.preview(F.col("matches"), 2).alias("shown")), "shown").select("player_id", "seq", "m.rule_id")


@registered(f"""{E}, a AS (SELECT *, list_concat(CASE threshold_crossed WHEN 2 THEN ['WARN'] WHEN 5 THEN ['WARN', 'KICK'] WHEN 10 THEN ['KICK'] WHEN 20 THEN ['EXECUTE_COMMAND'] ELSE [] END, CASE WHEN dup THEN ['NOTIFY_STAFF'] ELSE [] END) AS l FROM e),
  b AS (SELECT *, unnest(l) AS type, generate_subscripts(l, 1) - 1 AS place FROM a)
  SELECT player_id, seq, place, type, CASE type WHEN 'WARN' THEN 'Please follow the server chat rules.' WHEN 'KICK' THEN 'Repeated chat violations.' WHEN 'NOTIFY_STAFF' THEN '' ELSE 'tempban name ' || player_id || ' 1d ' || split_part({oracles.RULE_IDS}, ',', 1) || ' ' || points_after END AS text FROM b""")
def execute_actions(spark, sf_dir):
    """Every planned action as a row, with its text."""
    m = windowed.evaluate(document_messages(spark, sf_dir), q.SLICE)
    out = actions.executed(m, q.SLICE, F.concat(F.lit("name "), F.col("player_id").cast("string")))
    return out.select("player_id", "seq", "place", "type", F.coalesce("text", F.lit("")).alias("text"))


@registered("""WITH u AS (SELECT user_id AS player_id, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id) SELECT player_id FROM u WHERE n % 4 <> 0 ORDER BY last, CAST(player_id AS VARCHAR) LIMIT 7""")
def evict_oldest(spark, sf_dir):
    return history.evict_oldest(users(spark, sf_dir).withColumn("durable", F.col("n") % 4 == 0), 7).select("player_id")


@registered("""WITH u AS (SELECT user_id AS id, min(ts) AS first, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT * FROM u WHERE id % 2 = 0), c AS (SELECT count(*) AS tracked, count(*) FILTER (n % 4 <> 0) AS spare FROM t),
  x AS (SELECT id, row_number() OVER (ORDER BY first, CAST(id AS VARCHAR)) AS place FROM u WHERE id % 2 = 1)
  SELECT id AS player_id, true AS admitted FROM t UNION ALL SELECT id, place <= greatest(60 - tracked, 0) + spare FROM x, c""")
def capacity_admission(spark, sf_dir):
    """Where 60 players are the most, even users are tracked and odd ones arrive."""
    u = users(spark, sf_dir)
    tracked = u.where("player_id % 2 = 0").withColumn("durable", F.col("n") % 4 == 0)
    return history.admitted(tracked, q.events(spark, sf_dir).select(F.col("user_id").alias("player_id"), "ts"), 60)


# --- what no natural row decides --------------------------------------------------------------------------------------


@registered("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE greatest(event_id % 50 + 1, event_id * 3 % 40 + 1) END AS seconds, event_id % 3 = 0 AS noticed FROM events""")
def strongest_mute(spark, sf_dir):
    """Two matches that mute, for a time or for ever: one mute is planned."""
    n = F.col("event_id")
    act = lambda kind, seconds: F.struct(F.lit(kind).alias("type"), F.lit("").alias("message"), seconds.cast("long").alias("seconds"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("command"))
    one = lambda rule, *a: F.struct(F.lit(rule).alias("rule_id"), F.array_compact(F.array(*a)).alias("actions"))
    found = F.array(one("a", act("MUTE", F.when(n % 7 != 0, n % 50 + 1)), F.when(n % 3 == 0, act("NOTIFY_STAFF", F.lit(None)))), one("b", act("MUTE", F.when(n % 5 != 0, n * 3 % 40 + 1)), F.when(n % 3 == 0, act("NOTIFY_STAFF", F.lit(None)))))
    e = q.events(spark, sf_dir).withColumn("matches", found).withColumn("planned", windowed.planned(F.col("matches"), F.array().cast(f"array<{detectors.ACTION}>")))
    mute = F.filter("planned", lambda a: a["type"] == "MUTE")
    return e.select("event_id", F.when(F.size(mute) == 1, F.get(mute, F.lit(0))["seconds"]).otherwise(-1).alias("seconds"), (F.size(F.filter("planned", lambda a: a["type"] == "NOTIFY_STAFF")) == 1).alias("noticed"))


@registered("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'SEVERE' WHEN event_id % 4 = 2 THEN 'HIGH' WHEN event_id % 2 = 1 OR event_id % 3 = 1 THEN 'MODERATE' ELSE 'LOW' END AS severity,
  CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE 'b,a' END AS rule_ids, 3 AS points FROM events""")
def severity_and_dedupe(spark, sf_dir):
    """Matches of four severities, of which rules repeat: the highest severity, the first match of each rule."""
    n = F.col("event_id")
    act = F.array().cast(f"array<{detectors.ACTION}>")

    def one(rule, severity, points):
        return F.struct(rule.alias("rule_id"), F.lit("SPAM").alias("category"), severity.alias("severity"), F.lit(points).cast("long").alias("points"), F.lit("").alias("evidence"), F.lit("").alias("value"), F.lit(False).alias("block"), act.alias("actions")).cast(detectors.MATCH)

    level = F.when(n % 4 == 3, "SEVERE").when(n % 4 == 2, "HIGH").when(n % 2 == 1, "MODERATE").otherwise("LOW")
    other = F.when(n % 3 == 1, "MODERATE").otherwise("LOW")
    first, second = F.when(n % 2 == 0, "a").otherwise("b"), F.when(n % 2 == 0, "b").otherwise("a")
    found = windowed.dedupe(F.array(one(first, level, 1), one(second, other, 2), one(first, F.lit("LOW"), 9), one(second, F.lit("LOW"), 9)))
    e = q.events(spark, sf_dir).select("event_id", found.alias("matches"))
    return e.select("event_id", windowed.severity(F.col("matches")).alias("severity"), F.array_join(F.transform("matches", lambda m: m["rule_id"]), ",").alias("rule_ids"), F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["points"]).alias("points"))


WORDS = """WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) BETWEEN 4 AND 12)[1:20] AS l FROM documents),
  w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS a, unnest(list_concat(l[2:], [l[1]])) AS n FROM t WHERE len(l) > 0),
  p AS (SELECT *, CASE i % 4 WHEN 0 THEN a[1:1] || a[3:3] || a[2:2] || a[4:] WHEN 1 THEN a[2:2] || a[1:1] || a[3:-2] WHEN 2 THEN reverse(a) ELSE n END AS b FROM w)"""


def _words(spark, sf_dir):
    """Words beside themselves with letters swapped, swapped and cut, reversed, or beside their next word."""
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w).between(4, 12)), 1, 20)
    t = read(spark, sf_dir, "documents").select("doc_id", words.alias("l"))
    w = t.select("doc_id", "l", F.posexplode("l").alias("p", "a")).withColumn("i", F.col("p") + 1)
    cut = lambda x, a, n: F.substr(x, F.lit(a), n if not isinstance(n, int) else F.lit(n))
    a, size = F.col("a"), F.length("a")
    after = F.get(F.concat(F.slice("l", 2, 20), F.slice("l", 1, 1)), F.col("p"))
    b = F.when(F.col("i") % 4 == 0, F.concat(cut(a, 1, 1), cut(a, 3, 1), cut(a, 2, 1), cut(a, 4, 12))).when(F.col("i") % 4 == 1, F.concat(cut(a, 2, 1), cut(a, 1, 1), cut(a, 3, size - 3))).when(F.col("i") % 4 == 2, F.reverse(a)).otherwise(after)
    return w.select("doc_id", "i", "a", b.alias("b"))


@registered(f"{WORDS} SELECT doc_id, i, damerau_levenshtein(a, b) <= 2 AS near FROM p")
def osa_bounded(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "i", similarity.osa_within(F.col("a"), F.col("b"), F.lit(2)).alias("near"))


@registered(rf"""{WORDS}, r AS (SELECT *, least(length(a), length(b)) / greatest(length(a), length(b)) AS ratio, floor((1 - 0.8::DOUBLE) * greatest(length(a), length(b))) AS most FROM p)
  SELECT doc_id, i, a = b OR ratio >= 0.8::DOUBLE AND damerau_levenshtein(a, b) <= most AS near FROM r""")
def similar_words(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "i", similarity.similar(F.col("a"), F.col("b"), 0.8).alias("near"))


# --- reloads ----------------------------------------------------------------------------------------------------------

OFF = {name: {"enabled": False} for name in ("similarity_spam", "repeated_characters", "advertising")}


def _version(length: int, caps: dict, duplicate: tuple[int, int], rapid: tuple[int, int, int], minutes: int, cap: int, steps: tuple[int, int]) -> str:
    own = {
        "message_length": {"maximum_length": length}, "caps": caps, "duplicate_spam": {"history_size": duplicate[0], "duplicate_window_seconds": duplicate[1]},
        "rapid_spam": {"minimum_interval_ms": rapid[0], "maximum_messages_in_window": rapid[1], "window_seconds": rapid[2]},
    }
    return json.dumps({"rules": OFF | own, "score": {"point_decay_minutes": minutes, "maximum_points_per_message": cap, "thresholds": [{"points": n, "actions": [a]} for n, a in zip(steps, ("WARN", "KICK"), strict=True)]}})


def reloads() -> asof.Timeline:
    """Four versions over January 2024 out of six reloads: one is not valid, one asks for too little, one changes nothing."""
    at = lambda day, hour=0: (1_704_067_200 + (day - 1) * C.DAY + hour * 3_600) * 1_000_000
    last = _version(60, {"minimum_letters": 8, "points": 4, "actions": ["WARN"]}, (3, 3 * C.DAY), (7_200_000, 3, C.DAY), 1_440, 20, (2, 8))
    attempts = [
        asof.Attempt(at(8), _version(40, {"minimum_letters": 5}, (30, 20 * C.DAY), (60_000, 6, 5 * C.DAY), 8_640, 2, (5, 12))),
        asof.Attempt(at(12), _version(40, {"minimum_letters": 0}, (30, 20 * C.DAY), (60_000, 6, 5 * C.DAY), 8_640, 2, (5, 12))),
        asof.Attempt(at(14), json.dumps({"state": {"maximum_tracked_players": 10}}), tracked_players=11),
        asof.Attempt(at(16, 12), json.dumps({"enabled": False})),
        asof.Attempt(at(20), last),
        asof.Attempt(at(22), last),
    ]
    first = C.load(_version(30, {"minimum_letters": 5}, (6, 5 * C.DAY), (3_600_000, 4, 2 * C.DAY), 2_880, 20, (3, 6)))
    return asof.timeline(first, attempts)[0]


RELOADS = """WITH k(v, on_, len_, letters, caps_points, caps_block, dup_n, dup_s, gap_ms, rapid_n, rapid_s, decay, cap, t1, t2) AS (VALUES
    (0, true, 30, 5, 1, true, 6, 432000, 3600000, 4, 172800, 172800, 20, 3, 6), (1, true, 40, 5, 1, true, 30, 1728000, 60000, 6, 432000, 518400, 2, 5, 12),
    (2, false, 0, 0, 0, false, 0, 0, 0, 0, 0, 0, 0, 0, 0), (3, true, 60, 8, 4, false, 3, 259200, 7200000, 3, 86400, 86400, 20, 2, 8)),
  w AS (SELECT user_id AS player_id, event_id AS seq, epoch_us(ts) AS us, event_type || ' ' || event_id % 3 || CASE WHEN event_id % 11 = 0 THEN repeat(' and so on', 3) WHEN event_id % 13 = 0 THEN repeat(' and so on', 6) ELSE '' END AS said,
      (ts >= TIMESTAMP '2024-01-08')::INT + (ts >= TIMESTAMP '2024-01-16 12:00:00')::INT + (ts >= TIMESTAMP '2024-01-20')::INT AS v FROM events),
  e AS (SELECT *, CASE WHEN seq % 7 = 0 THEN upper(said) ELSE said END AS raw FROM w JOIN k USING (v)),
  m AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY us, seq) AS rn FROM e WHERE on_),
  b AS (SELECT *, lag(us) OVER (PARTITION BY player_id ORDER BY rn) AS last_us, max(rn + 1 - rapid_n) OVER p AS r_first, max(us - rapid_s * 1000000::BIGINT) OVER p AS r_old,
      max(rn + 1 - greatest(dup_n, 8)) OVER p AS d_first, max(us - greatest(dup_s, 45) * 1000000::BIGINT) OVER p AS d_old FROM m
    WINDOW p AS (PARTITION BY player_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  x AS (SELECT b.player_id, b.rn, count(*) FILTER (o.rn >= b.r_first AND o.us >= b.r_old AND o.rn >= b.rn - b.rapid_n AND o.us >= b.us - b.rapid_s * 1000000::BIGINT) AS n_rapid,
      coalesce(bool_or(o.rn >= b.d_first AND o.us >= b.d_old AND o.rn >= b.rn - b.dup_n AND o.us >= b.us - b.dup_s * 1000000::BIGINT AND lower(o.raw) = lower(b.raw)), false) AS dup
    FROM b LEFT JOIN b o ON o.player_id = b.player_id AND o.rn < b.rn GROUP BY b.player_id, b.rn),
  l AS (SELECT b.*, x.dup, length(raw) > len_ AS long_, length(regexp_replace(raw, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(raw, '[^A-Z]', '', 'g')) AS n_upper,
      coalesce(us - last_us < gap_ms * 1000::BIGINT, false) OR n_rapid >= rapid_n AS rapid FROM b JOIN x USING (player_id, rn)),
  h AS (SELECT *, n_letters >= letters AND n_upper > 0.75 * n_letters AS caps FROM l),
  p AS (SELECT *, least(cap, long_::INT + caps::INT * caps_points + dup::INT * 2 + rapid::INT) AS added FROM h),
  s AS (SELECT p.player_id, p.rn, coalesce(sum(o.added) FILTER (o.us + o.decay * 1000000::BIGINT > p.us), 0) AS before FROM p LEFT JOIN p o ON o.player_id = p.player_id AND o.rn < p.rn GROUP BY p.player_id, p.rn)
  SELECT player_id, seq, array_to_string(list_filter([CASE WHEN long_ THEN 'flooding.message_length' END, CASE WHEN caps THEN 'flooding.caps' END, CASE WHEN dup THEN 'spam.duplicate' END, CASE WHEN rapid THEN 'spam.rapid' END], lambda y: y IS NOT NULL), ',') AS rule_ids,
    added::BIGINT AS points_added, CASE WHEN before < t2 AND before + added >= t2 THEN t2 WHEN before < t1 AND before + added >= t1 THEN t1 END::BIGINT AS threshold_crossed,
    CASE WHEN long_ OR dup OR rapid OR (caps AND caps_block) THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM p JOIN s USING (player_id, rn)
  UNION ALL SELECT player_id, seq, '', 0, NULL, 'ALLOW' FROM e WHERE NOT on_"""


def _event_messages(spark, sf_dir):
    n = F.col("event_id")
    said = F.concat("event_type", F.lit(" "), (n % 3).cast("string"), F.when(n % 11 == 0, F.lit(" and so on" * 3)).when(n % 13 == 0, F.lit(" and so on" * 6)).otherwise(""))
    return q.events(spark, sf_dir).select(F.col("user_id").alias("player_id"), n.alias("seq"), "ts", F.when(n % 7 == 0, F.upper(said)).otherwise(said).alias("raw"))


@registered(RELOADS)
def config_reload(spark, sf_dir):
    """Events as messages, each judged by the version of the configuration in force at its time."""
    e = asof.evaluate(_event_messages(spark, sf_dir), reloads())
    ids = F.array_join(F.transform("matches", lambda m: m["rule_id"]), ",")
    return e.select("player_id", "seq", ids.alias("rule_ids"), "points_added", F.col("threshold_crossed").cast("long").alias("threshold_crossed"), "decision")


@registered(RELOADS)
def config_reload_stateful(spark, sf_dir):
    """The same by the stateful tier, whose state goes on from version to version."""
    e = processor.evaluate(_event_messages(spark, sf_dir), reloads())
    return e.select(F.col("player_id").cast("long").alias("player_id"), "seq", F.array_join("rule_ids", ",").alias("rule_ids"), "points_added", "threshold_crossed", "decision")
