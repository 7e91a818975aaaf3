"""Filters: terms in nine modes, named patterns, targeted exceptions.

Terms are compiled to literals and regular expressions on the driver. A
token-window match (consecutive tokens joined, runs of a character tolerated) is
one expression over the token string: each run of e equal characters may take e
to max(2, e), with at most one space before any but the first character.

Filters of more than ``MANY`` terms share one machine (:mod:`terms`), which
keeps the plan and the time for a text the same however many terms there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import plain, text
from brindle.operators import terms
from brindle.operators.detectors import MATCH, match
from brindle.operators.terms import WINDOW, window_body
from brindle.plans.config import COMPACT, LEGACY, PATTERNS, Config, Filter

#: Terms of a filter that are expressions of their own, at most.
MANY = 32
EDGE = (r"(?<![\p{javaLetterOrDigit}])", r"(?![\p{javaLetterOrDigit}])")


def boundary_regex(term: str) -> str:
    return EDGE[0] + re.escape(term) + EDGE[1]


def window_regex(term: str) -> str:
    """The token-window expression of a term, or one that matches nothing for a term without letters."""
    target = plain.compact(term)
    return "(?:^|(?<= ))" + window_body(target) + "(?= |$)" if target else "(?!)"


def window_matches(normalized: Column, term: str) -> Column:
    """Whether consecutive tokens, ``WINDOW`` at most, join to the term. Only terms of more letters than half of that can need more."""
    target = plain.compact(term)
    found = F.rlike(normalized, F.lit(window_regex(term)))
    if 2 * len(target) <= WINDOW:
        return found
    short = lambda t, i: F.rlike(F.array_join(F.slice(t, i, WINDOW), " "), F.lit("^" + window_body(target) + "(?= |$)"))
    return found & let(text.tokens(normalized), lambda t: F.exists(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: short(t, i)))


def term_matches(normalized: Column, compacted: Column, term: str, mode: str) -> Column:
    if mode == "SUBSTRING":
        return F.contains(normalized, F.lit(term))
    if mode == "COMPACT":
        return F.contains(compacted, F.lit(term))
    window = window_matches(normalized, term)
    if mode in ("COMPACT_WORD", "COMPACT_PHRASE"):
        return window
    boundary = F.rlike(normalized, F.lit(boundary_regex(term)))
    return boundary if mode in ("WORD", "PHRASE") else boundary | window


def pattern_match(normalized: Column, compacted: Column, name: str) -> Column:
    """The first token that a named pattern matches whole, else the first run of up to ten tokens (each of at most
    16 characters, stopping beyond 16) that it matches joined.

    Only texts whose letters and digits hold the pattern somewhere are looked at.
    """
    whole = f"^(?i:{PATTERNS[name]})$"

    def search(words: Column) -> Column:
        alone = F.get(F.filter(words, lambda w: F.rlike(w, F.lit(whole))), F.lit(0))

        def runs(w: Column, i: Column) -> Column:
            def one(n: Column) -> Column:
                part = F.slice(words, i + 1, n)
                before = F.length(F.array_join(F.slice(words, i + 1, n - 1), ""))
                fits = (F.size(part) == n) & F.forall(part, lambda x: F.length(x) <= 16) & ((n == 1) | (before <= 16))
                return F.when(fits & F.rlike(F.array_join(part, ""), F.lit(whole)), F.array_join(part, " "))

            return F.get(F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(10)), one)), F.lit(0))

        return F.coalesce(alone, F.get(F.array_compact(F.transform(words, runs)), F.lit(0)))

    found = F.get(F.transform(F.array(text.tokens(normalized)), search), F.lit(0))
    return F.when(F.rlike(compacted, F.lit(f"(?i:{PATTERNS[name]})")), found)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _overlaps_itself(needle: str) -> bool:
    return any(needle.startswith(needle[i:]) for i in range(1, len(needle)))


def occurrences(haystack: Column, needle: str, boundary: bool) -> Column:
    """Spans (s, e) of a literal, overlapping ones too."""
    n = len(needle)
    if _overlaps_itself(needle):
        at = F.when(F.length(haystack) >= n, F.sequence(F.lit(1), F.length(haystack) - n + 1)).otherwise(F.array().cast("array<int>"))
        at = F.filter(at, lambda i: F.substr(haystack, i, F.lit(n)) == needle)
    else:
        # Occurrences cannot overlap: they lie between the parts of a split.
        start = F.struct(F.lit(1).alias("i"), F.array().cast("array<int>").alias("at"))
        step = lambda s, p: F.struct((s["i"] + F.length(p) + n).alias("i"), F.concat(s["at"], F.array(s["i"] + F.length(p))).alias("at"))
        at = let(F.split(haystack, re.escape(needle)), lambda parts: F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda s: s["at"]))
    if boundary:
        edge = lambda c: ~F.rlike(c, F.lit(r"^\p{javaLetterOrDigit}"))
        at = F.filter(at, lambda i: ((i == 1) | edge(F.substr(haystack, i - 1, F.lit(1)))) & edge(F.substr(haystack, i + n, F.lit(1))))
    return F.transform(at, lambda i: F.struct(i.alias("s"), (i + n).alias("e")))


def _inside(exception: str, needle: str, boundary: bool) -> bool:
    pattern = r"(?<![^\W_])" + re.escape(needle) + r"(?![^\W_])" if boundary else re.escape(needle)
    return re.search(pattern, exception) is not None


def covered(normalized: Column, compacted: Column, term: str, f: Filter) -> Column:
    """The first exception that covers, if every occurrence of the term lies inside an exception; else null."""

    def view(haystack: Column, needle: str, boundary: bool, compact_view: bool) -> Column:
        def named(spans: Column, by: str) -> Column:
            return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(by).alias("by")))

        found = occurrences(haystack, needle, boundary)
        lists = []
        for e in f.exceptions:
            cover = plain.compact(e) if compact_view else e
            if needle and _inside(cover, needle, boundary):
                lists.append(named(occurrences(haystack, cover, boundary), e))
        covers = F.flatten(F.array(*lists)) if lists else F.array().cast("array<struct<s:int,e:int,by:string>>")
        both = F.struct(found.alias("f"), covers.alias("c"))
        inside = lambda z: F.forall(z["f"], lambda m: F.exists(z["c"], lambda c: (c["s"] <= m["s"]) & (c["e"] >= m["e"])))
        return let(both, lambda z: F.struct(F.size(z["f"]).alias("n"), F.when(inside(z), F.get(z["c"], F.lit(0))["by"]).alias("by")))

    squeezed = f.mode in COMPACT
    first = view(compacted, plain.compact(term), False, True) if squeezed else view(normalized, term, f.mode != "SUBSTRING", False)
    if squeezed or f.mode in LEGACY:
        return let(first, lambda x: F.when(x["n"] > 0, x["by"]))
    second = view(compacted, plain.compact(term), False, True)
    return let(first, lambda x: F.when(x["n"] > 0, x["by"]).otherwise(let(second, lambda y: F.when(y["n"] > 0, y["by"]))))


def filter_result(f: Filter, variants: list[tuple[Column, Column]], known: Column | None = None) -> tuple[Column, Column]:
    """(match, exception that prevented it) of one filter; at most one is not null. ``known`` has its first term, if that was found elsewhere.

    Only the first matching term counts: if it is excepted, the filter is, even
    where a later term matches. An exception must cover every variant in which
    that term matches.
    """
    if known is not None:
        named = [pattern_match(n, c, p) for p in f.patterns for n, c in variants]
        return _result(f, F.coalesce(known["term"], *named), known["by"])
    tests = [F.when(_any([term_matches(n, c, t, f.mode) for n, c in variants]), F.lit(i)) for i, t in enumerate(f.terms)]
    which = F.coalesce(*tests, F.lit(-1)) if tests else F.lit(-1)
    named = [pattern_match(n, c, p) for p in f.patterns for n, c in variants]
    value = F.get(F.array(*[F.lit(t) for t in f.terms]).cast("array<string>"), F.when(which >= 0, which))
    value = F.coalesce(value, *named) if named else value
    prevented = F.lit(None).cast("string")
    if f.exceptions:
        by_term = prevented
        for i, t in enumerate(f.terms):
            states = F.array(*[F.when(term_matches(n, c, t, f.mode), F.struct(covered(n, c, t, f).alias("by"))) for n, c in variants])
            held = let(F.array_compact(states), lambda z: F.when(~F.exists(z, lambda x: x["by"].isNull()), F.get(z, F.lit(0))["by"]))
            by_term = F.when(which == i, held).otherwise(by_term)
        prevented = by_term
    return _result(f, value, prevented)


def _result(f: Filter, value: Column, prevented: Column) -> tuple[Column, Column]:
    hit = F.lit(f.rule.enabled) & value.isNotNull()
    found = match(f.rule, f.id, f.category, f"filtered {f.mode.lower()}", value, f.severity)
    return F.when(hit & prevented.isNull(), found), F.when(hit, prevented)


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def with_filters(messages, config: Config):
    """Adds ``filtered`` (matches in order) and ``prevented`` (rule_id, exception)."""
    n = config.normalization
    base = F.col("unicode")
    out = messages.withColumns({
        "_f": text.filter_text(base, n["lookalike_substitutions"], n["filter_leet_substitutions"]),
        "_p": text.filter_text(base, n["lookalike_substitutions"], n["filter_leet_substitutions"], punctuation=True),
    })
    out = out.withColumns({"_fc": text.compact(F.col("_f")), "_pc": text.compact(F.col("_p"))})
    modern = [(F.col("_f"), F.col("_fc")), (F.col("_p"), F.col("_pc"))]
    legacy = [(F.col("deobfuscated"), F.col("compact"))]
    many = [f for f in config.filters if len(f.terms) > MANY and all(f.terms)]
    if many:
        sent = tuple(terms.Many(f.mode, f.mode in LEGACY, f.mode in COMPACT, f.terms, f.exceptions) for f in many)
        # Forms that none of them reads stay out of Python.
        read = [v if any(t.legacy == old for t in sent) else [] for v, old in ((legacy, True), (modern, False))]
        out = out.withColumn("_terms", terms.first_terms(sent, *read))
    known = {f.id: F.get("_terms", F.lit(k)) for k, f in enumerate(many)}
    results = {f.id: filter_result(f, legacy if f.mode in LEGACY else modern, known.get(f.id)) for f in config.filters}
    found = F.array_compact(F.array(*[r[0] for r in results.values()])) if results else F.array()
    prevented = F.array_compact(F.array(*[F.when(r[1].isNotNull(), F.struct(F.lit(k).alias("rule_id"), r[1].alias("exception"))) for k, r in results.items()])) if results else F.array()
    return out.withColumns({"filtered": found.cast(f"array<{MATCH}>"), "prevented": prevented.cast("array<struct<rule_id:string,exception:string>>")}).drop("_f", "_p", "_fc", "_pc", "_terms")
