"""Very many terms at once: one Aho-Corasick machine for all filters of many terms.

The plan holds one column however many terms there are. A worker builds the
machine when it first needs it and reads each text once; what the machine finds
is checked exactly (word boundaries, token windows, exceptions), which costs
only where something is found. Terms beyond ``CHARS`` characters make several
machines, which each batch of texts goes through in turn, so that a worker never
holds more than one of full size.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import plain

#: Characters of the terms of one machine, at most (some hundred bytes each).
CHARS = 1 << 21
#: Texts that are held as lists of variants at a time, where one machine serves them all.
ROWS = 1000
#: Tokens that a window joins at most.
WINDOW = 32

RESULT = "array<struct<at:int,term:string,by:string>>"


class Many(NamedTuple):
    """A filter of many terms: its mode, which of the forms it reads, its exceptions, and what exceptions are looked for in."""

    mode: str
    legacy: bool
    squeezed: bool
    terms: tuple[str, ...]
    exceptions: tuple[str, ...]


class Found(NamedTuple):
    at: int
    term: str
    by: str | None


def window_body(target: str) -> str:
    runs = [(c, len(list(g))) for c, g in itertools.groupby(target)]
    return " ?".join(f"{re.escape(c)}(?: ?{re.escape(c)}){{{n - 1},{max(2, n) - 1}}}" for c, n in runs)


@lru_cache(maxsize=1 << 14)
def _window(target: str) -> tuple[re.Pattern, re.Pattern]:
    body = window_body(target)
    return re.compile("(?:^|(?<= ))" + body + "(?= |$)"), re.compile(body + "(?= |$)")


def in_window(normalized: str, target: str) -> bool:
    """Whether consecutive tokens, ``WINDOW`` at most, join to ``target``, runs of a character tolerated."""
    anywhere, here = _window(target)
    if not anywhere.search(normalized):
        return False
    if 2 * len(target) <= WINDOW:
        return True
    tokens = normalized.split(" ")
    return any(here.match(" ".join(tokens[i : i + WINDOW])) for i in range(len(tokens)))


def squeeze(value: str) -> str:
    """Without spaces, each run of a character as one: what a window's text and its term have in common."""
    return "".join(c for c, _ in itertools.groupby(value.replace(" ", "")))


def spans(haystack: str, needle: str, boundary: bool) -> list[tuple[int, int]]:
    """Where ``needle`` is, overlapping places too; with ``boundary`` only between what is no letter or digit."""
    out, n, i = [], len(needle), haystack.find(needle)
    while i >= 0:
        edge = lambda k: not 0 <= k < len(haystack) or not plain.letter_or_digit(haystack[k])
        if not boundary or (edge(i - 1) and edge(i + n)):
            out.append((i, i + n))
        i = haystack.find(needle, i + 1)
    return out


def _view(haystack: str, needle: str, boundary: bool, exceptions: Iterable[tuple[str, str]]) -> tuple[int, str | None]:
    """How often ``needle`` is found, and the first of ``exceptions`` (name, text) found if they cover each place."""
    found = spans(haystack, needle, boundary) if needle else []
    covers = [(s, e, name) for name, cover in exceptions if needle and spans(cover, needle, boundary) for s, e in spans(haystack, cover, boundary)]
    inside = all(any(s <= a and e >= b for s, e, _ in covers) for a, b in found)
    return len(found), covers[0][2] if inside and covers else None


def covered(normalized: str, compacted: str, term: str, f: Many) -> str | None:
    """The exception that covers every place of ``term`` in one form of a text, or none."""
    close = [(e, plain.compact(e)) for e in f.exceptions]
    n, by = _view(compacted, plain.compact(term), False, close) if f.squeezed else _view(normalized, term, f.mode != "SUBSTRING", [(e, e) for e in f.exceptions])
    if not n and not f.squeezed and not f.legacy:
        n, by = _view(compacted, plain.compact(term), False, close)
    return by if n else None


class Machine:
    """Finds the terms ``parts`` (filter, term's place, term) of ``filters`` in the forms of a text."""

    def __init__(self, filters: list[Many], parts: list[tuple[int, int, str]]):
        import ahocorasick

        self.filters = filters
        literal, close, loose = (defaultdict(list) for _ in range(3))
        for f, i, term in parts:
            mode = filters[f].mode
            if mode == "COMPACT":
                close[term].append((f, i, term, ""))
            elif mode in ("SUBSTRING", "WORD", "PHRASE", "NORMALIZED_WORD", "NORMALIZED_PHRASE"):
                literal[term].append((f, i, term, ""))
            if mode in ("COMPACT_WORD", "COMPACT_PHRASE", "NORMALIZED_WORD", "NORMALIZED_PHRASE") and (target := plain.compact(term)):
                loose[squeeze(target)].append((f, i, term, target))
        self.machines = []
        for keys in (literal, close, loose):
            machine = ahocorasick.Automaton()
            for key, owners in keys.items():
                machine.add_word(key, owners)
            if keys:
                machine.make_automaton()
            self.machines.append(machine if keys else None)

    def matches(self, normalized: str, compacted: str, legacy: bool, best: list[int]) -> Iterator[tuple[int, int]]:
        """(filter, term's place) found in one variant of a text, of places up to the ``best`` of their filter."""
        for machine, haystack, kind in zip(self.machines, (normalized, compacted, squeeze(normalized) if self.machines[2] and not legacy else ""), range(3), strict=True):
            if machine is None or not haystack:
                continue
            for end, owners in machine.iter(haystack):
                for f, i, term, target in owners:
                    if self.filters[f].legacy != legacy or i > best[f]:
                        continue
                    if kind == 0 and self.filters[f].mode != "SUBSTRING":
                        a, b = end - len(term), end + 1
                        if (a >= 0 and plain.letter_or_digit(haystack[a])) or (b < len(haystack) and plain.letter_or_digit(haystack[b])):
                            continue
                    if kind == 2 and not in_window(normalized, target):
                        continue
                    yield f, i


@lru_cache(maxsize=1)
def _machine(filters: tuple[Many, ...], part: int) -> Machine:
    return Machine(list(filters), _parts(filters)[part])


@lru_cache(maxsize=1)
def _parts(filters: tuple[Many, ...]) -> list[list[tuple[int, int, str]]]:
    """Terms in parts of ``CHARS`` characters."""
    out, size = [[]], 0
    for f, many in enumerate(filters):
        for i, term in enumerate(many.terms):
            if out[-1] and size + len(term) > CHARS:
                out.append([])
                size = 0
            out[-1].append((f, i, term))
            size += len(term)
    return out


def find(filters: tuple[Many, ...], texts: list[tuple[list[tuple[str, str]], list[tuple[str, str]]]]) -> list[list[Found | None]]:
    """For each text, given as its legacy and its modern variants of (normalized, compacted), the first term of each
    filter that it holds, and the exception that prevents it: one for each variant in which the term matches."""
    never = [len(f.terms) for f in filters]
    best = [list(never) for _ in texts]
    held: list[dict[int, list[int]]] = [{} for _ in texts]
    for part in range(len(_parts(filters))):
        machine = _machine(filters, part)
        for t, variants in enumerate(texts):
            for legacy in (True, False):
                for v, (normalized, compacted) in enumerate(variants[not legacy]):
                    for f, i in machine.matches(normalized, compacted, legacy, best[t]):
                        if i < best[t][f]:
                            best[t][f], held[t][f] = i, [v]
                        elif v not in held[t][f]:
                            held[t][f].append(v)
    out = []
    for t, variants in enumerate(texts):
        row: list[Found | None] = []
        for f, many in enumerate(filters):
            if best[t][f] == never[f]:
                row.append(None)
                continue
            term = many.terms[best[t][f]]
            by = [covered(*variants[not many.legacy][v], term, many) for v in sorted(held[t][f])] if many.exceptions else [None]
            row.append(Found(best[t][f], term, by[0] if None not in by else None))
        out.append(row)
    return out


def first_terms(filters: tuple[Many, ...], legacy: list[tuple[Column, Column]], modern: list[tuple[Column, Column]]) -> Column:
    """:func:`find` as a column: an array with an entry for each filter, null where no term is found."""

    first = len(legacy)

    @F.pandas_udf(RESULT)
    def found(*forms: pd.Series) -> pd.Series:
        out, n = [], ROWS if len(_parts(filters)) == 1 else max(1, len(forms[0]))
        for lo in range(0, len(forms[0]), n):
            own = [f.iloc[lo : lo + n].fillna("") for f in forms]
            pairs = [list(zip(own[k], own[k + 1], strict=True)) for k in range(0, len(own), 2)]
            texts = [(list(v[:first]), list(v[first:])) for v in zip(*pairs, strict=True)]
            out += [[None if x is None else x._asdict() for x in row] for row in find(filters, texts)]
        return pd.Series(out, dtype=object)

    return found(*[c for pair in [*legacy, *modern] for c in pair])
