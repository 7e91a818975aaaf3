"""Alerts as rows of a channel: bounded, escaped fields, and the buttons of a case."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text

# The title and the note that alerts carry.
TITLE, NOTE = "Staff alert", "A configured moderation rule produced a staff notification."
# Code, label and style of a case's buttons; the last is always there.
BUTTONS = (("m10", "Mute 10m", "PRIMARY"), ("m60", "Mute 1h", "PRIMARY"), ("ban", "Ban", "DANGER"), ("dismiss", "Dismiss", "SECONDARY"))


def field(name: str, value: Column, inline: bool, most: int) -> Column:
    return F.struct(F.lit(name).alias("name"), text.escape_markup(value.cast("string"), most).alias("value"), F.lit(inline).alias("inline"))


def embedded(alerts: DataFrame, include_original: bool = False, mention: str = "", enabled: Iterable[str] = ("m10", "m60", "ban")) -> DataFrame:
    """``alerts`` (player_id, player_name, rule_ids, decision, points_added, score_after, original, case_id, ts) with what is shown:
    content (the role that is mentioned), title, description, fields, and buttons, of which there are none without a case."""
    rules = F.when(F.size("rule_ids") > 0, F.array_join("rule_ids", ", ")).otherwise("unknown")
    fields = [
        field("Player", F.col("player_name"), True, 256),
        field("Player UUID", F.col("player_id"), True, 128),
        field("Matched rules", rules, False, 1_024),
        field("Decision", F.lower("decision"), True, 64),
        field("Points added", F.col("points_added"), True, 64),
        field("Current score", F.col("score_after"), True, 64),
    ]
    if include_original:
        fields.append(F.when(F.col("original") != "", field("Original message", F.col("original"), False, 1_024)))
    buttons = [F.struct(F.concat(F.lit("cam:"), "case_id", F.lit(f":{code}")).alias("custom_id"), F.lit(label).alias("label"), F.lit(style).alias("style")) for code, label, style in BUTTONS if code == "dismiss" or code in enabled]
    none = F.array().cast("array<struct<custom_id:string,label:string,style:string>>")
    return alerts.withColumns({
        "content": F.lit(f"<@&{mention}>" if mention else ""), "title": F.lit(TITLE), "description": F.lit(NOTE),
        "fields": F.array_compact(F.array(*fields)), "buttons": F.when(F.col("case_id").isNull(), none).otherwise(F.array(*buttons)),
    })
