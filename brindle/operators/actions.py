"""Actions as rows: what a host would carry out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.plans.config import Config


def commands(config: Config) -> list[str]:
    """The command templates of a configuration."""
    every = [a for r in (*config.rules.values(), *(f.rule for f in config.filters)) for a in r.actions] + [a for _, actions in config.thresholds for a in actions]
    return list(dict.fromkeys(a.command for a in every if a.command))


def executed(evaluated: DataFrame, config: Config, name: Column) -> DataFrame:
    """A row per planned action, in order: player_id, seq, ts, place, type, target text, seconds.

    ``text`` is the message of a warning, the reason of a kick or mute, or the
    command with its placeholders expanded in one pass. Rows stand alone, so
    that one action that fails does not stop the others.
    """
    rule = F.coalesce(F.get("matches", F.lit(0))["rule_id"], F.lit("none"))
    out = evaluated.select("player_id", "seq", "ts", "points_after", rule.alias("rule"), name.alias("name"), F.posexplode_outer("actions").alias("place", "a")).where("a is not null")
    command = F.lit(None).cast("string")
    for c in commands(config):
        command = F.when(F.col("a.command") == c, text.template(c, player=F.col("name"), uuid=F.col("player_id"), points=F.col("points_after"), rule=F.col("rule"))).otherwise(command)
    said = F.when(F.col("a.type") == "EXECUTE_COMMAND", command).when(F.col("a.type") == "WARN", F.col("a.message")).otherwise(F.col("a.reason"))
    return out.select("player_id", "seq", "ts", "place", F.col("a.type").alias("type"), said.alias("text"), F.col("a.seconds").alias("seconds"))
