"""Plain Python twins of the text forms, for configuration values and for what SQL functions cannot express."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import regex

# Fixed values.
ZERO_WIDTH = "​‌‍⁠﻿­"
LINK_TLDS = (
    "com net org gg io co uk us de dev app me tv info biz xyz online site store fr nl ru ca au lol top world fun icu link space "
    "digital agency studio solutions services social today news wiki"
).split()
ADVERTISING_TLDS = (
    "com net org gg io co uk us de dev app me tv info biz xyz online site store fr nl ru ca au edu gov mil cloud tech games network "
    "website pro club live shop ai lol top world fun icu link space digital agency studio solutions services social today news wiki"
).split()

DROPPED = ("Cc", "Cf", "Cs", "Co", "Cn")
LABEL = r"([\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?)"
SPELLED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}][ \t\n\x0b\f\r]+){2,}[\p{L}\p{N}](?![\p{L}\p{N}])")
BRACKETED = regex.compile(LABEL + r"\s*(?:\[\s*\.\s*\]|\(\s*\.\s*\))\s*" + LABEL)
SPACED = regex.compile(LABEL + r"\s+\.\s+" + LABEL)
WORDED = regex.compile(LABEL + r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\s+dot\s+)\s*" + LABEL, regex.I)
#: What parts the labels of the three patterns. Each match lies around one of these.
BRACKETED_DOT = regex.compile(r"\[\s*\.\s*\]|\(\s*\.\s*\)")
SPACED_DOT = regex.compile(r"(?<=\s)\.(?=\s)")
WORDED_DOT = regex.compile(r"[\[(]\s*dot\s*[\])]|(?<=\s)dot(?=\s)", regex.I)
BEFORE = regex.compile(r"(?r)[\p{L}\p{N}-]*+\s*+")
AFTER = regex.compile(r"\s*+[\p{L}\p{N}-]*+")
#: What a text must hold for link rewriting to change it (in Java's syntax): space at a slash, a dot or the word dot in
#: brackets or between spaces, or three spelled letters.
MAY_REWRITE = r"\s/|/\s|[\[(]\s*(?:\.|(?i:dot))\s*[\])]|\s(?:\.|(?i:dot))\s|(?<![\p{L}\p{N}])(?:[\p{L}\p{N}]\s+){2}[\p{L}\p{N}](?![\p{L}\p{N}])"
ROUNDS = 4


def letter_or_digit(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd"


def space(c: str) -> bool:
    """White space in either of the two senses: separators, and the control characters that part lines and fields."""
    return unicodedata.category(c)[0] == "Z" or c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def sanitize(value: str) -> str:
    kept = (" " if space(c) else c for c in value if c not in ZERO_WIDTH and (space(c) or unicodedata.category(c) not in DROPPED))
    return " ".join(x for x in "".join(kept).split(" ") if x)


def substitute(value: str, table: Mapping[str, str]) -> str:
    return "".join(table.get(c, c) for c in value)


def compact(value: str) -> str:
    return "".join(filter(letter_or_digit, value))


def collapse_runs(value: str, exempt: str = "") -> str:
    """At most two of a character in a row; those of ``exempt`` are left alone."""
    out: list[str] = []
    for c in value:
        if c in exempt or out[-2:] != [c, c]:
            out.append(c)
    return "".join(out)


def _around(cores: regex.Pattern, pattern: regex.Pattern, to, value: str) -> str:
    """``pattern.sub(to, value)``, for a pattern of labels around one of ``cores``: only the labels beside each are
    looked at, as the pattern tries up to 63 characters at every place of a text."""
    out, done, start, end = [], 0, -1, -1
    for core in cores.finditer(value):
        left, right = BEFORE.match(value, 0, core.start()).start(), AFTER.match(value, core.end()).end()
        if left >= end and start >= 0:
            out += [value[done:start], pattern.sub(to, value[start:end])]
            done, start = end, -1
        start, end = left if start < 0 else min(start, left), max(end, right)
    return value if start < 0 else "".join([*out, value[done:start], pattern.sub(to, value[start:end]), value[end:]])


def link_normalize(value: str) -> str:
    """Undoes common ways of hiding a link: spelled labels, spaced slashes, bracketed, spaced or worded dots."""
    value = SPELLED.sub(lambda m: m[0].replace(" ", ""), value)
    value = regex.sub(r"[ \t\n\x0b\f\r]*/[ \t\n\x0b\f\r]*", "/", value)
    for _ in range(ROUNDS):
        new = _around(SPACED_DOT, SPACED, r"\1.\2", _around(BRACKETED_DOT, BRACKETED, r"\1.\2", value))
        new = _around(WORDED_DOT, WORDED, lambda m: f"{m[1]}.{m[2]}" if m[2].lower() in LINK_TLDS else m[0], new)
        if new == value:
            break
        value = new
    return value


def forms(raw: str, lookalike: Mapping[str, str], leet: Mapping[str, str], nfkc: bool = True, links: bool = True) -> dict[str, str]:
    """canonical, deobfuscated, link_normalized and compact forms of a text."""
    canonical = sanitize(unicodedata.normalize("NFKC", raw) if nfkc else raw).lower()
    clear = substitute(substitute(canonical, lookalike), leet)
    return {"canonical": canonical, "deobfuscated": clear, "link_normalized": link_normalize(clear) if links else clear, "compact": compact(clear), "collapsed": collapse_runs(clear)}


def filter_text(raw: str, lookalike: Mapping[str, str], leet: Mapping[str, str], nfkc: bool = True, punctuation: bool = False) -> str:
    """The form that filters see: letters and digits, anything else as one space.

    Control and format characters go first, so a line break joins words.
    ``punctuation``: substitutions leave what is not a letter or digit alone.
    """
    value = unicodedata.normalize("NFKC", raw) if nfkc else raw
    value = "".join(c for c in value if c not in ZERO_WIDTH and unicodedata.category(c) not in DROPPED).lower()
    value = substitute(value, lookalike)
    value = "".join(c if punctuation and not letter_or_digit(c) else leet.get(c, c) for c in value).replace("ß", "ss")
    parted = "".join(c if letter_or_digit(c) else " " for c in value)
    return collapse_runs(" ".join(parted.split()), exempt=" ")


def osa(left: str, right: str, most: int) -> int:
    """Optimal string alignment distance (adjacent swaps count 1, no substring is edited twice); ``most`` + 1 beyond ``most``.

    Bit-parallel (Hyyrö): a column of differences between neighbouring cells is one integer. The distance is at least that
    of any two prefixes of one length, less the difference of the lengths, so that unlike texts are left early.
    """
    if most < 0:
        raise ValueError("the bound must not be negative")
    if abs(len(left) - len(right)) > most:
        return most + 1
    if not left:
        return len(right)
    at: dict[str, int] = {}
    for i, c in enumerate(left):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(left)) - 1, 1 << len(left) - 1
    up, down, diagonal, before, score = full, 0, 0, 0, len(left)
    limit = most + abs(len(left) - len(right))
    for j, c in enumerate(right, 1):
        here = at.get(c, 0)
        swapped = (~diagonal & here) << 1 & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swapped) & full
        more, less = down | full ^ (diagonal | up), diagonal & up
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down, before = less | full ^ (diagonal | more), more & diagonal, here
        if not j & 15:
            prefix = (1 << j) - 1
            if j <= len(left) and j + (up & prefix).bit_count() - (down & prefix).bit_count() > limit:
                return most + 1
    return min(score, most + 1)


def near(left: str, right: str, threshold: float) -> bool:
    """Within the edit bound of the longer text."""
    most = int((1.0 - threshold) * max(len(left), len(right)))
    return osa(left, right, most) <= most


def similar(left: str, right: str, threshold: float) -> bool:
    if left == right or not left and not right:
        return True
    short, long_ = sorted((len(left), len(right)))
    ratio = short / long_
    if ratio < 0.6:
        return False
    a, b = (set(regex.split(r"[^\p{L}\p{N}]+", x)) - {""} for x in (left, right))
    if short >= 4 and a and b and len(a & b) / min(len(a), len(b)) >= threshold:
        return True
    return ratio >= threshold and near(left, right, threshold)
