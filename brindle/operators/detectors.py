"""Detectors: each gives a nullable match from columns of a message.

A match is a struct of rule_id, category, severity, points, evidence, value,
block and actions. Stateless detectors are expressions; those that look back
read ``recent``, an array of a player's earlier messages that one window gives
(:func:`with_history`). Detectors of length, capitals and runs see the raw text.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions import plain, similarity, text
from brindle.plans.config import Action, Config, Rule

ACTION = "struct<type:string,message:string,seconds:bigint,reason:string,command:string>"
MATCH = f"struct<rule_id:string,category:string,severity:string,points:bigint,evidence:string,value:string,block:boolean,actions:array<{ACTION}>>"


def actions_literal(actions: Iterable[Action]) -> Column:
    parts = [F.struct(F.lit(a.type).alias("type"), F.lit(a.message).alias("message"), F.lit(a.seconds).cast("long").alias("seconds"), F.lit(a.reason).alias("reason"), F.lit(a.command).cast("string").alias("command")) for a in actions]
    return F.array(*parts).cast(f"array<{ACTION}>")


def match(rule: Rule, rule_id: str | Column, category: str, evidence: Column | str, value: Column, severity: str | None = None, points: int | None = None) -> Column:
    say = F.lit(evidence) if isinstance(evidence, str) else evidence
    severity = severity or ("HIGH" if category == "SECURITY" else "MODERATE")
    return F.struct(
        (F.lit(rule_id) if isinstance(rule_id, str) else rule_id).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
        F.lit(rule.points if points is None else points).cast("long").alias("points"), say.alias("evidence"), value.cast("string").alias("value"),
        F.lit(rule.block).alias("block"), actions_literal(rule.actions).alias("actions"),
    ).cast(MATCH)


def none() -> Column:
    return F.lit(None).cast(MATCH)


def with_forms(messages: DataFrame, config: Config) -> DataFrame:
    """Adds canonical, deobfuscated, link_normalized, compact, collapsed and flags of ``raw``."""
    n = config.normalization
    out = messages.withColumn("unicode", text.nfkc(F.col("raw")) if n["unicode_nfkc"] else F.col("raw"))
    out = out.withColumn("canonical", F.lower(text.sanitize(F.col("unicode"))))
    out = out.withColumn("looked", text.substitute(F.col("canonical"), n["lookalike_substitutions"]))
    out = out.withColumn("deobfuscated", text.substitute(F.col("looked"), n["leet_substitutions"]))
    linked = text.link_normalize(F.col("deobfuscated")) if n["normalize_link_obfuscation"] else F.col("deobfuscated")
    out = out.withColumn("link_normalized", linked)
    flags = text.flags(*(F.col(c) for c in ("raw", "unicode", "canonical", "looked", "deobfuscated", "link_normalized")), n["remove_zero_width_characters"])
    return out.withColumns({"compact": text.compact(F.col("deobfuscated")), "collapsed": text.collapse_runs(F.col("deobfuscated")), "flags": flags}).drop("looked")


def message_length(config: Config) -> Column:
    r = config.rules["message_length"]
    n = F.length("raw")
    return F.when(F.lit(r.enabled) & (n > r.maximum_length), match(r, "flooding.message_length", "FLOODING", "message too long", n))


def caps(config: Config) -> Column:
    r = config.rules["caps"]
    # A count of matches would make an array of them.
    letters = F.length(F.regexp_replace("raw", r"[^\p{javaLetter}]+", ""))
    ratio = F.length(F.regexp_replace("raw", r"[^\p{javaLetter}]+|[\p{javaLetter}&&[^\p{javaUpperCase}]]+", "")) / letters
    hit = (letters >= r.minimum_letters) & (ratio > r.maximum_uppercase_ratio)
    return F.when(F.lit(r.enabled) & hit, match(r, "flooding.caps", "FLOODING", "too many capitals", F.round(ratio, 4)))


def repeated_characters(config: Config) -> Column:
    r = config.rules["repeated_characters"]
    run = rf"(?s)(\p{{javaLetter}})\1{{{r.maximum_repeated_letters}}}|([^\p{{javaLetter}}\p{{javaWhitespace}}])\2{{{r.maximum_repeated_symbols}}}"
    return F.when(F.lit(r.enabled) & F.rlike("raw", F.lit(run)), match(r, "flooding.repeated_characters", "FLOODING", "repeated character run", F.regexp_extract("raw", run, 0)))


HISTORY = "recent"
#: The slice of time that a row is worked on in (see ``windowed.sliced``).
SLICE = "_slice"


def player(rows: DataFrame) -> list[str]:
    """What a player's rows are partitioned by."""
    return ["player_id", *([SLICE] if SLICE in rows.columns else [])]


def with_history(messages: DataFrame, config: Config) -> DataFrame:
    """Adds ``recent``, the player's last messages (newest last), and ``last_ts``, over one frame; within a slice, where there are slices."""
    dup, sim, rapid = (config.rules[k] for k in ("duplicate_spam", "similarity_spam", "rapid_spam"))
    n = max(dup.history_size, sim.history_size, rapid.maximum_messages_in_window)
    by = Window.partitionBy(*player(messages)).orderBy("ts", "seq")
    # Only the similarity rule reads the text again.
    clear = text.truncate(F.col("deobfuscated"), sim.maximum_processed_length)
    entry = F.struct("ts", "canonical", (clear if sim.enabled else F.lit("")).alias("clear"))
    return messages.withColumns({HISTORY: F.collect_list(entry).over(by.rowsBetween(-n, -1)), "last_ts": F.lag("ts").over(by)})


def _newest(n: int) -> Column:
    """The newest ``n`` of ``recent``."""
    return F.slice(HISTORY, F.greatest(F.size(HISTORY) - n + 1, F.lit(1)), n)


def _since(seconds: int) -> Column:
    return F.col("ts") - F.make_dt_interval(secs=F.lit(seconds))


def claims(config: Config, x: Column) -> Column:
    """Whether the duplicate rule claims an earlier message, if that is one of the last ``history_size``."""
    r = config.rules["duplicate_spam"]
    return F.lit(r.enabled) & (F.length("canonical") >= r.minimum_length) & (x["ts"] >= _since(r.duplicate_window_seconds)) & (x["canonical"] == F.col("canonical"))


def duplicate(config: Config) -> Column:
    r = config.rules["duplicate_spam"]
    return F.when(F.exists(_newest(r.history_size), lambda x: claims(config, x)), match(r, "spam.duplicate", "DUPLICATE", "exact canonical duplicate", F.col("canonical")))


def rapid(config: Config) -> Column:
    r = config.rules["rapid_spam"]
    gap = F.unix_micros("ts") - F.unix_micros("last_ts")
    soon = F.coalesce((gap >= 0) & (gap < r.minimum_interval_ms * 1000), F.lit(False))
    count = F.size(F.filter(_newest(r.maximum_messages_in_window), lambda x: x["ts"] >= _since(r.window_seconds)))
    full = count >= r.maximum_messages_in_window
    evidence = F.concat_ws(" and ", F.when(soon, F.lit("minimum interval")), F.when(full, F.lit("sliding window")))
    return F.when(F.lit(r.enabled) & (soon | full), match(r, "spam.rapid", "SPAM", evidence, count + 1))


@F.pandas_udf(StringType())
def _first_near(now: pd.Series, candidates: pd.Series, threshold: pd.Series) -> pd.Series:
    """The first of the candidates within the edit bound."""

    def first(a, texts, t):
        return None if a is None or texts is None else next((x for x in texts if plain.near(a, x, t)), None)

    return pd.Series([first(*r) for r in zip(now, candidates, threshold, strict=True)], dtype=object)


def similar_recent(messages: DataFrame, config: Config) -> DataFrame:
    """Adds ``similar``: the newest of the recent texts that resembles the message's.

    Lengths and shared words settle many. Of the texts that are newer than the
    first that these accept, those of like length go to one Arrow UDF for the
    edit distance; rows without any are NULL to it.
    """
    r = config.rules["similarity_spam"]
    t = F.lit(r.similarity_threshold).cast("double")
    now = text.truncate(F.col("deobfuscated"), r.maximum_processed_length)
    open_ = F.lit(r.enabled) & (F.length(now) >= r.minimum_length)
    recent = F.reverse(_newest(r.history_size))
    claimed = lambda x, i: (x["clear"] == now) & (i < config.rules["duplicate_spam"].history_size) & claims(config, x)
    fit = F.transform(F.filter(recent, lambda x, i: (x["ts"] >= _since(r.window_seconds)) & ~claimed(x, i)), lambda x: x["clear"])
    out = messages.withColumn("_now", F.when(open_, now))
    out = out.withColumn("_words", similarity.word_set(F.col("_now")))

    def measured(x: Column) -> Column:
        """Whether the words settle it, and whether the edit distance may."""
        n, m = F.length("_now"), F.length(x)
        short, long_ = F.least(n, m), F.greatest(n, m)
        words = similarity.word_set(x)
        least = F.least(F.size("_words"), F.size(words))
        shared = (short >= 4) & (short >= 0.6 * long_) & (least > 0) & (F.size(F.array_intersect(F.col("_words"), words)) >= t * least)
        return F.struct(x.alias("x"), ((F.col("_now") == x) | shared).alias("sure"), ((short >= 0.6 * long_) & (short >= t * long_)).alias("open"))

    out = out.withColumn("_fit", F.when(open_, F.transform(fit, measured)))
    out = out.withColumn("_near", F.filter("_fit", lambda z: z["sure"] | z["open"]))
    out = out.withColumn("_first", F.array_position(F.transform("_near", lambda z: z["sure"]), True).cast("int"))
    doubtful = F.when(F.col("_first") > 0, F.slice("_near", 1, F.greatest(F.col("_first") - 1, F.lit(0)))).otherwise(F.col("_near"))
    out = out.withColumn("_doubt", F.transform(doubtful, lambda z: z["x"]))
    some = F.size("_doubt") > 0
    found = _first_near(F.when(some, F.col("_now")), F.when(some, F.col("_doubt")), t)
    settled = F.when(F.col("_first") > 0, F.get("_near", F.col("_first") - 1)["x"])
    return out.withColumn("similar", F.coalesce(found, settled)).drop("_now", "_words", "_fit", "_near", "_first", "_doubt")


def similarity_match(config: Config) -> Column:
    r = config.rules["similarity_spam"]
    return F.when(F.col("similar").isNotNull(), match(r, "spam.similarity", "SIMILARITY", "similar to a recent message", F.col("similar")))


# Advertising. Patterns of addresses are fixed values.
INVITE = r"(?i)(?<![a-z0-9-])(?:https?://)?(?:www\.)?(?:discord\.gg|discord(?:app)?\.com/invite)/[a-z0-9-]{2,}(?![a-z0-9-])"
ADDRESS = r"(?<![\p{L}\p{N}.:])\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?(?![.:\p{L}\p{N}])"
HOST = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,24}|xn--[a-z0-9-]{2,59})"
LINK = rf"(?i)(?:https?://)?(?<![a-z0-9-]){HOST}(?![a-z0-9-])[/:]?"


def invite(value: Column) -> Column:
    """The first invite; the patterns all hold the same word."""
    return F.when(F.contains(F.lower(value), F.lit("discord")), F.nullif(F.regexp_extract(value, INVITE, 0), F.lit("")))


def address(canonical: Column) -> Column:
    """The first IPv4 address with a valid port, dots and colons closed up."""
    closed = F.regexp_replace(F.regexp_replace(canonical, r"(?<=\d)\s*\.\s*(?=\d)", "."), r"\s*:\s*", ":")

    def valid(x: Column) -> Column:
        parts = F.split(x, ":")
        octets = F.forall(F.split(F.get(parts, F.lit(0)), r"\."), lambda o: o.cast("int") <= 255)
        port = F.get(parts, F.lit(1)).cast("int")
        return octets & F.coalesce(port.between(1, 65_535), F.lit(True))

    found = F.get(F.filter(F.regexp_extract_all(closed, F.lit(ADDRESS), F.lit(0)), valid), F.lit(0))
    return F.when(F.rlike(canonical, F.lit(r"\d\s*\.\s*\d")), found)


def host_allowed(host: Column, allowed: Iterable[str]) -> Column:
    """The host is an allowed domain or below one."""
    tests = [(host == d) | F.endswith(host, F.lit("." + d)) for d in allowed]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def country_tlds() -> list[str]:
    """The top-level domains of all countries, by the JVM's own list."""
    return sorted(c.lower() for c in SparkSession.active()._jvm.java.util.Locale.getISOCountries())


def domain(value: Column, allowed: Iterable[str], countries: Iterable[str] | None = None) -> Column:
    """The first host that is a known top-level domain's, or is used as a URL, and is not allowed.

    Known are common ones, ``countries`` (by default all) and internationalised ones.
    """
    countries = country_tlds() if countries is None else countries
    known = F.array(*[F.lit(t) for t in dict.fromkeys([*plain.ADVERTISING_TLDS, *countries])])

    def bare(x: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(x, r"^(?i)https?://", ""), "[/:]$", ""))

    def advertised(z: Column) -> Column:
        tld = F.substring_index(z["host"], ".", -1)
        url = F.rlike(z["found"], F.lit(r"(?i)^https?://|[/:]$")) | F.startswith(z["host"], F.lit("www."))
        return (F.startswith(tld, F.lit("xn--")) | F.array_contains(known, tld) | url) & ~F.endswith(z["host"], F.lit("-")) & ~host_allowed(z["host"], allowed)

    hosts = F.transform(F.regexp_extract_all(value, F.lit(LINK), F.lit(0)), lambda x: F.struct(x.alias("found"), bare(x).alias("host")))
    return F.when(F.rlike(value, F.lit(r"(?i)[a-z0-9]\.[a-z0-9]")), F.get(F.filter(hosts, advertised), F.lit(0))["host"])


def with_advertising(messages: DataFrame, config: Config, countries: Iterable[str] | None = None) -> DataFrame:
    """Adds ``m_ads``, up to two matches: an invite, else an address, else a domain; and a note of 0 points if a link was disguised.

    Each test is a column of its own, so that what others name is computed once, and not at all after a hit.
    """
    r = config.rules["advertising"]
    if not r.enabled:
        return messages.withColumn("m_ads", F.array().cast(f"array<{MATCH}>"))
    out = messages.withColumn("_invite", invite(F.col("link_normalized")))
    out = out.withColumn("_ip", F.when(F.col("_invite").isNull(), address(F.col("canonical"))))
    out = out.withColumn("_domain", F.when(F.col("_invite").isNull() & F.col("_ip").isNull(), domain(F.col("link_normalized"), r.allowed_domains, countries)))
    which = F.when(F.col("_invite").isNotNull(), "advertising.discord_invite").when(F.col("_ip").isNotNull(), "advertising.ip").when(F.col("_domain").isNotNull(), "advertising.domain")
    out = out.withColumns({"_rule": which, "_value": F.coalesce("_invite", "_ip", "_domain")})
    first = F.when(F.col("_rule").isNotNull(), match(r, F.col("_rule"), "ADVERTISING", "advertising candidate", F.col("_value")))
    silent = Rule(0, (), False)
    note = match(silent, "advertising.domain_obfuscation", "ADVERTISING", "obfuscated link separator", F.col("_value"))
    note = F.when(F.col("_rule").isNotNull() & F.array_contains("flags", "LINK_SEPARATOR_REWRITTEN"), note)
    return out.withColumn("m_ads", F.array_compact(F.array(first, note))).drop("_invite", "_ip", "_domain", "_rule", "_value")
