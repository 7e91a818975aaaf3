"""Text forms as columns.

All but two are chains of SQL functions inside code generation. NFKC and link
rewriting have no SQL form; their Arrow UDFs see NULL, and so next to no data,
for rows that cannot change: text of ASCII and common Latin letters, and text
without a dot, slash or spelled letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions import plain

SPACES = r"[\p{javaWhitespace}\p{javaSpaceChar}]"
CONTROLS = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]"
OTHER_CONTROLS = rf"[[\p{{Cc}}\p{{Cf}}\p{{Cs}}\p{{Co}}\p{{Cn}}]&&[^\p{{javaWhitespace}}\p{{javaSpaceChar}}]]"
ZERO_WIDTH = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in plain.ZERO_WIDTH) + "]"
NO_WORD = r"[^\p{javaLetterOrDigit}]"
#: What texts must hold for NFKC, and for :func:`sanitize` beyond their ends, to change them: ASCII's graphic characters and
#: the letters of Latin-1 and the start of Latin Extended-A stay as they are and combine with nothing but what is not among them.
MAY_COMPOSE = r"[^\x00-\x7F\x{C0}-\x{131}]"
MAY_HOLD = r"[^\x20-\x7E\x{C0}-\x{131}]|  "


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _links(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else plain.link_normalize(x))


def only_where(udf, test: Column, value: Column) -> Column:
    """``udf`` of the rows that pass ``test``; the others, NULL to the UDF, keep their value."""
    return F.coalesce(udf(F.when(test, value)), value)


def nfkc(raw: Column) -> Column:
    return only_where(_nfkc, F.rlike(raw, F.lit(MAY_COMPOSE)), raw)


def sanitize(value: Column) -> Column:
    """Controls and formats dropped, white space runs to one space, ends trimmed."""
    shown = F.regexp_replace(F.regexp_replace(value, ZERO_WIDTH, ""), OTHER_CONTROLS, "")
    return F.trim(F.when(F.rlike(value, F.lit(MAY_HOLD)), F.regexp_replace(shown, f"{SPACES}+", " ")).otherwise(value))


def substitute(value: Column, table: Mapping[str, str]) -> Column:
    """Each character through ``table``, in one pass."""
    if not table:
        return value
    if all(len(v) == 1 for v in table.values()):
        return F.translate(value, "".join(table), "".join(table.values()))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")


def compact(value: Column) -> Column:
    return F.regexp_replace(value, NO_WORD, "")


def collapse_runs(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)(.)\1{2,}", "$1$1")


def link_normalize(value: Column) -> Column:
    return only_where(_links, F.rlike(value, F.lit(plain.MAY_REWRITE)), value)


def flags(raw: Column, unicode: Column, canonical: Column, looked: Column, clear: Column, linked: Column, zero_width: bool = True) -> Column:
    """Which steps changed the text, in the order of the steps."""
    seen = F.rlike(unicode, F.lit(ZERO_WIDTH))
    others = F.rlike(F.regexp_replace(unicode, ZERO_WIDTH, "") if zero_width else unicode, F.lit(OTHER_CONTROLS))
    return F.array_compact(
        F.array(
            F.when(unicode != raw, F.lit("UNICODE_NORMALIZED")),
            F.when(seen, F.lit("ZERO_WIDTH_REMOVED")) if zero_width else F.lit(None).cast("string"),
            F.when(others, F.lit("CONTROL_REMOVED")),
            F.when(looked != canonical, F.lit("LOOKALIKE_REPLACED")),
            F.when(clear != looked, F.lit("LEETSPEAK_REPLACED")),
            F.when(linked != clear, F.lit("LINK_SEPARATOR_REWRITTEN")),
        )
    )


def filter_text(raw: Column, lookalike: Mapping[str, str], leet: Mapping[str, str], punctuation: bool = False) -> Column:
    """The form that filters see (of NFKC text)."""
    value = F.lower(F.regexp_replace(raw, CONTROLS, ""))
    kept = {k: v for k, v in leet.items() if plain.letter_or_digit(k)} if punctuation else leet
    value = F.replace(substitute(substitute(value, lookalike), kept), F.lit("ß"), F.lit("ss"))
    value = F.trim(F.regexp_replace(value, f"{NO_WORD}+", " "))
    return F.regexp_replace(value, r"(?s)([^ ])\1{2,}", "$1$1")


def tokens(filtered: Column) -> Column:
    return F.when(filtered == "", F.array().cast("array<string>")).otherwise(F.split(filtered, " "))


def truncate(value: Column, n: int | Column) -> Column:
    return F.substring(value, 1, n)


def sanitize_stored(value: Column) -> Column:
    """Line breaks to spaces, other control characters dropped: for stored originals."""
    value = F.regexp_replace(value, r"[\r\n\x{2028}\x{2029}]", " ")
    return F.regexp_replace(value, r"[\x00-\x1F\x7F-\x9F]", "")


def bounded(value: Column, n: int) -> Column:
    """Control, surrogate and separator characters dropped, then the first ``n`` code points."""
    return truncate(F.regexp_replace(value, r"[\x00-\x1F\x7F-\x9F\p{Cs}\x{2028}\x{2029}]", ""), n)


def escape_markup(value: Column, n: int) -> Column:
    """Controls dropped, mentions broken, markup escaped, an empty text named, a long one cut with an ellipsis."""
    marks = r"\*_~`|>"
    value = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1F\x7F-\x9F\p{Cs}\x{2028}\x{2029}]", "")
    value = F.replace(value, F.lit("@"), F.lit("@​"))
    value = F.regexp_replace(value, "([" + "".join("\\" + c for c in marks) + "])", r"\\$1")
    value = F.when(value == "", F.lit("unknown")).otherwise(value)
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n - 1), F.lit("…"))).otherwise(value)


def format_short(seconds: Column) -> Column:
    """One unit, cut off, at least 1s."""
    s = F.greatest(seconds.cast("long"), F.lit(1))
    out = F.when(s >= 3600, F.concat((F.floor(s / 3600)).cast("string"), F.lit("h")))
    return out.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def format_compact(seconds: Column) -> Column:
    """Days, hours, minutes and seconds that are not zero, at least 1s."""
    s = F.greatest(seconds.cast("long"), F.lit(1))
    units = (("d", 86_400, 10**9), ("h", 3_600, 24), ("m", 60, 60), ("s", 1, 60))
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for u, size, top in units for n in [F.floor(s / size) % top]]
    return F.concat_ws(" ", *parts)


def parse_duration(value: Column) -> Column:
    """Seconds of a text such as 5m or 2D; null for what is no positive duration."""
    amount = F.regexp_extract(F.trim(value), r"^([0-9]+)([smhdwSMHDW])$", 1)
    unit = F.lower(F.regexp_extract(F.trim(value), r"^([0-9]+)([smhdwSMHDW])$", 2))
    size = reduce(lambda c, u: c.when(unit == u[0], F.lit(u[1])), (("m", 60), ("h", 3600), ("d", 86_400), ("w", 604_800)), F.when(unit == "s", F.lit(1)))
    n = F.try_multiply(amount.try_cast("long"), size.cast("long"))
    return F.when(n > 0, n)


def template(parts: str, **values: Column) -> Column:
    """A command template expanded in a single pass: a value that looks like a placeholder stays as it is."""
    pieces = plain.regex.split(r"(\{[a-z]+\})", parts)
    return F.concat(*[values[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in pieces])
