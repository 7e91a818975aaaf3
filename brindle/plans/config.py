"""Configuration: typed values, strict loading with all problems collected, bundles of filter packs.

A configuration is kilobytes, so it is plain Python on the driver; compiled
values go into plans as literals.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from brindle.functions import plain

# Fixed values.
CATEGORIES = ("SPAM", "DUPLICATE", "SIMILARITY", "FLOODING", "FILTERED_CONTENT", "ADVERTISING", "HARASSMENT", "HATE", "EXTREMISM", "THREAT", "SECURITY")
SEVERITIES = ("LOW", "MODERATE", "HIGH", "SEVERE")
MODES = ("WORD", "PHRASE", "SUBSTRING", "COMPACT", "NORMALIZED_WORD", "NORMALIZED_PHRASE", "COMPACT_WORD", "COMPACT_PHRASE", "BUILT_IN_PATTERN")
RESERVED = ("spam.rapid", "spam.duplicate", "spam.similarity", "flooding.caps", "flooding.repeated_characters", "flooding.message_length", "advertising.discord_invite", "advertising.ip", "advertising.domain", "advertising.domain_obfuscation", "security.state_capacity")
LEET = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FILTER_LEET = {"0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "6": "g", "9": "g", "7": "t"}
LOOKALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t", "χ": "x"}
DAY = 86_400
MOST = {"points": 100_000, "cap": 1_000_000, "threshold": 10**9, "window": 2_592_000, "decay": 5_256_000, "history": 10_000, "players": 1_000_000, "entries": 100_000, "similar_history": 256, "similar_length": 4_096, "mute": 3_650 * DAY}

LEGACY = MODES[:4]
COMPACT = ("COMPACT", "COMPACT_WORD", "COMPACT_PHRASE")


class Problem(NamedTuple):
    path: str
    message: str


class ConfigError(ValueError):
    def __init__(self, problems: list[Problem]):
        super().__init__("; ".join(f"{p.path}: {p.message}" for p in problems))
        self.problems = problems


@dataclass(frozen=True)
class Action:
    type: str
    message: str = ""
    seconds: int | None = None
    reason: str = ""
    command: str | None = None


@dataclass(frozen=True)
class Rule:
    """A rule's common part and its own settings."""

    points: int
    actions: tuple[Action, ...] = ()
    block: bool = True
    enabled: bool = True
    settings: Mapping[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["settings"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass(frozen=True)
class Filter:
    id: str
    mode: str
    terms: tuple[str, ...]
    rule: Rule
    category: str = "FILTERED_CONTENT"
    severity: str = "MODERATE"
    patterns: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    enabled: bool
    permissions: Mapping[str, Any]
    normalization: Mapping[str, Any]
    rules: Mapping[str, Rule]
    filters: tuple[Filter, ...]
    thresholds: tuple[tuple[int, tuple[Action, ...]], ...]
    decay_seconds: int
    cap: int
    show_original: bool
    logging: Mapping[str, Any]
    history: Mapping[str, int]
    state: Mapping[str, int]
    notice_cooldown_seconds: int
    mute_seconds: int
    packs: Mapping[str, Any] = field(default_factory=dict)

    def only(self, *names: str) -> Config:
        """With the named rules alone, without filters and thresholds."""
        return replace(self, rules={k: replace(r, enabled=k in names) for k, r in self.rules.items()}, filters=(), thresholds=())

    def with_rule(self, name: str, **settings: Any) -> Config:
        r = self.rules[name]
        return replace(self, rules={**self.rules, name: replace(r, settings={**r.settings, **settings})})


def parse_duration(text: Any, most: int | None = None) -> int:
    """Seconds of a text such as 5m; ValueError for anything else."""
    m = re.fullmatch(r"([0-9]+)([smhdw])", str(text).strip().lower()) if isinstance(text, str) else None
    if m is None:
        raise ValueError("duration must be a number and one of s, m, h, d, w")
    n = int(m[1]) * {"s": 1, "m": 60, "h": 3_600, "d": DAY, "w": 7 * DAY}[m[2]]
    if not n:
        raise ValueError("duration must be positive")
    if most is not None and n > most:
        raise ValueError(f"duration exceeds {most} seconds")
    return n


def compile_template(text: Any) -> str:
    """A command with known placeholders only; ValueError otherwise."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("command must not be blank")
    text = text.removeprefix("/")
    if re.search("[\x00-\x1f\x7f-\x9f  ]", text):
        raise ValueError("command must not contain control or line-separator characters")
    for name in re.findall(r"\{([a-zA-Z_]+)\}", text):
        if name not in ("player", "uuid", "points", "rule"):
            raise ValueError(f"unsupported command placeholder: {{{name}}}")
    if re.search("[{}]", re.sub(r"\{(player|uuid|points|rule)\}", "", text)):
        raise ValueError("unbalanced or unsupported command placeholder")
    return text


def _rule(points: int, block_notify: tuple[str, ...], **own: Any) -> dict:
    return {"enabled": True, "points": (points, 0, MOST["points"]), "actions": list(block_notify), **own}


BOTH, BLOCK = ("BLOCK", "NOTIFY_STAFF"), ("BLOCK",)
#: Field: default, or (default, least, most) for a number. Dictionaries are objects.
SPEC: dict[str, Any] = {
    "schema_version": (1, 1, 1),
    "enabled": True,
    "permissions": {"command_fallback_operator_level": (3, 0, 4), "staff_fallback_operator_level": (3, 0, 4), "operators_bypass_moderation": False, "bypass_fallback_operator_level": (4, 0, 4), "fallback_operator_level": (None, 0, 4)},
    "normalization": {"unicode_nfkc": True, "remove_zero_width_characters": True, "normalize_link_obfuscation": True, "lookalike_substitutions": "substitutions", "leet_substitutions": "substitutions", "filter_leet_substitutions": "substitutions"},
    "filter_packs": {"enabled": True, "directory": "filters", "active": []},
    "rules": {
        "rapid_spam": _rule(1, BOTH, minimum_interval_ms=(700, 1, 86_400_000), window_seconds=(8, 1, MOST["window"]), maximum_messages_in_window=(5, 1, MOST["history"])),
        "duplicate_spam": _rule(2, BOTH, history_size=(8, 1, MOST["history"]), duplicate_window_seconds=(45, 1, MOST["window"]), minimum_length=(3, 0, 1_000_000)),
        "similarity_spam": _rule(2, BOTH, history_size=(8, 1, MOST["similar_history"]), window_seconds=(45, 1, MOST["window"]), minimum_length=(8, 1, 1_000_000), maximum_processed_length=(512, 1, MOST["similar_length"]), similarity_threshold=(0.86, 0.0, 1.0)),
        "caps": _rule(1, BLOCK, minimum_letters=(8, 1, 1_000_000), maximum_uppercase_ratio=(0.75, 0.0, 1.0)),
        "repeated_characters": _rule(1, BLOCK, maximum_repeated_letters=(6, 1, 1_000_000), maximum_repeated_symbols=(8, 1, 1_000_000)),
        "message_length": _rule(1, BLOCK, maximum_length=(220, 1, 1_000_000)),
        "advertising": _rule(5, BOTH, allowed_domains=["example.org"]),
    },
    "filters": [],
    "score": {"point_decay_minutes": (30, 1, MOST["decay"]), "maximum_points_per_message": (20, 1, MOST["cap"]), "threshold_mode": "HIGHEST_CROSSED", "thresholds": []},
    "staff_alerts": {"show_original": False, "mute_button_duration": "5m"},
    "logging": {"enabled": True, "store_original_messages": False, "retention_days": (30, 1, 3_650)},
    "history": {"maximum_entries_per_player": (100, 1, MOST["history"]), "retention_days": (30, 1, 3_650)},
    "state": {"inactive_player_minutes": (30, 1, MOST["decay"]), "maximum_tracked_players": (10_000, 1, MOST["players"]), "maximum_score_entries_per_player": (4_096, 1, MOST["entries"])},
    "mutes": {"notification_cooldown": "5s", "maximum_duration": "30d"},
}
TABLES = {"lookalike_substitutions": LOOKALIKE, "leet_substitutions": LEET, "filter_leet_substitutions": FILTER_LEET}
FILTER_FIELDS = {"id", "category", "severity", "match_mode", "terms", "patterns", "exceptions", "points", "actions", "enabled"}


def _fill(raw: Any, spec: Any, path: str, say: Callable[[str, str], None]) -> Any:
    """``raw`` by ``spec``: unknown fields, wrong types and out-of-range numbers are problems; absent ones take defaults."""
    name = path.rpartition(".")[2]
    if isinstance(spec, dict):
        if raw is not None and not isinstance(raw, dict):
            say(path, "must be an object")
            raw = {}
        raw = raw or {}
        for key in raw.keys() - spec.keys():
            say(f"{path}.{key}", "unknown property")
        return {k: _fill(raw[k] if k in raw else ..., s, f"{path}.{k}", say) if k in raw or not isinstance(s, dict) else _fill({}, s, f"{path}.{k}", say) for k, s in spec.items()}
    default = spec[0] if isinstance(spec, tuple) else dict(TABLES[name]) if spec == "substitutions" else spec
    if raw is ...:
        return default
    if isinstance(spec, tuple):
        kinds = (int, float) if isinstance(default, float) else int
        if isinstance(raw, bool) or not isinstance(raw, kinds):
            say(path, "must be a number" if isinstance(default, float) else "must be an integer")
            return default
        if not spec[1] <= raw <= spec[2] or isinstance(default, float) and raw <= 0:
            say(path, f"must be between {spec[1]} and {spec[2]}")
            return min(max(raw, spec[1]), spec[2])
        return raw
    want = dict if spec == "substitutions" else type(default)
    if not isinstance(raw, want):
        say(path, f"must be {'an object' if want is dict else 'an array' if want is list else 'true or false' if want is bool else 'a string'}")
        return default
    return raw


def _substitutions(raw: Mapping[str, Any], path: str, say) -> dict[str, str]:
    out = {}
    for k, v in raw.items():
        if len(k) != 1:
            say(f"{path}.{k}", "keys must be one character")
        elif not isinstance(v, str) or not 1 <= len(v) <= 4:
            say(f"{path}.{k}", "values must be one to four characters")
        else:
            out[k.lower()] = v
    return out


def _domains(raw: list, path: str, say) -> tuple[str, ...]:
    out = []
    for i, d in enumerate(raw):
        try:
            host = str(d).strip().lower().rstrip(".").encode("idna").decode() if isinstance(d, str) else ""
        except UnicodeError:
            host = ""
        if re.fullmatch(r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9-]{2,63}", host):
            out.append(host)
        else:
            say(f"{path}[{i}]", "must be a bare domain")
    return tuple(dict.fromkeys(out))


def _actions(raw: list, path: str, most: int, say, block_ok: bool) -> tuple[bool, tuple[Action, ...]]:
    block, out = False, []
    for i, item in enumerate(raw):
        at = f"{path}[{i}]"
        got = {"type": item} if isinstance(item, str) else item
        if not isinstance(got, dict):
            say(at, "action must be a string or object")
            continue
        for k in got.keys() - {"type", "message", "duration", "reason", "command"}:
            say(f"{at}.{k}", "unknown property")
        kind = str(got.get("type", "")).upper()
        try:
            if kind == "BLOCK" and block_ok:
                block = True
            elif kind == "BLOCK":
                say(at, "BLOCK is only valid on rules")
            elif kind == "NOTIFY_STAFF":
                out.append(Action(kind))
            elif kind == "WARN":
                out.append(Action(kind, message=got.get("message", "Please follow the server chat rules.")))
            elif kind == "MUTE":
                how = got.get("duration")
                seconds = None if str(how).lower() == "permanent" else parse_duration(how, most)
                out.append(Action(kind, seconds=seconds, reason=got.get("reason", "Chat rule violation")))
            elif kind == "KICK":
                out.append(Action(kind, reason=got.get("reason", "Repeated chat violations.")))
            elif kind == "EXECUTE_COMMAND":
                out.append(Action(kind, command=compile_template(got.get("command"))))
            else:
                say(at, f"unknown action type: {got.get('type')}" if kind else "action type is required")
        except ValueError as e:
            say(f"{at}.{'command' if kind == 'EXECUTE_COMMAND' else 'duration'}", str(e))
    return block, tuple(out)


def normal_term(value: str, mode: str, norm: Mapping[str, Any]) -> str:
    """A filter value in the form that its mode compares."""
    if mode in LEGACY:
        f = plain.forms(value, norm["lookalike_substitutions"], norm["leet_substitutions"], norm["unicode_nfkc"], links=False)
        return f["compact" if mode == "COMPACT" else "deobfuscated"]
    text = plain.filter_text(value, norm["lookalike_substitutions"], norm["filter_leet_substitutions"], norm["unicode_nfkc"])
    return plain.compact(text) if mode in COMPACT else text


def _values(raw: Any, mode: str, norm: Mapping[str, Any], path: str, say) -> tuple[str, ...]:
    out = []
    for i, v in enumerate(raw if isinstance(raw, list) else []):
        at = f"{path}[{i}]"
        if not isinstance(v, str) or not v.strip():
            say(at, "must not be blank")
        elif re.search("[\x00-\x1f\x7f-\x9f]", v):
            say(at, "must not contain control characters")
        elif len(v) > 256:
            say(at, "must contain at most 256 characters")
        elif not (term := normal_term(v, mode, norm)):
            say(at, "must not normalize to an empty value")
        else:
            if mode in COMPACT and len(term) < 4:
                say(at, "compact terms must contain at least four characters")
            out.append(term)
    return tuple(dict.fromkeys(out))


#: Named token patterns that filters may use. Operators add their own families here.
PATTERNS: dict[str, str] = {"badword_family": r"b+a+d+w+o+r+d+(?:s|y|ish)?"}


def _filters(raw: list, norm: Mapping[str, Any], most: int, say, paths: list[str]) -> tuple[Filter, ...]:
    out: list[Filter] = []
    seen: set[str] = set()
    for f, path in zip(raw, paths, strict=True):
        if not isinstance(f, dict):
            say(path, "must be an object")
            continue
        for k in f.keys() - FILTER_FIELDS:
            say(f"{path}.{k}", "unknown property")

        def one_of(key: str, allowed: tuple[str, ...], default: str, f=f, path=path) -> str:
            got = str(f.get(key, default)).upper()
            if got not in allowed:
                say(f"{path}.{key}", f"unsupported value: {f.get(key)}")
            return got if got in allowed else default

        name = f.get("id") or ""
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,63}", name):
            say(f"{path}.id", "must be a lower-case rule id")
        elif name in RESERVED:
            say(f"{path}.id", "collides with a built-in rule ID")
        elif name in seen:
            say(f"{path}.id", "duplicate filter ID")
        seen.add(name)
        mode, category, severity = one_of("match_mode", MODES, "NORMALIZED_WORD"), one_of("category", CATEGORIES, "FILTERED_CONTENT"), one_of("severity", SEVERITIES, "MODERATE")
        if not f.get("terms") and not f.get("patterns"):
            say(path, "must contain at least one term or built-in pattern")
        if severity == "SEVERE" and mode in ("SUBSTRING", "COMPACT", "COMPACT_PHRASE"):
            say(f"{path}.match_mode", "unrestricted substring matching is not allowed for severe rules")
        for i, p in enumerate(f.get("patterns") or []):
            if p not in PATTERNS:
                say(f"{path}.patterns[{i}]", "unsupported built-in pattern")
        points = _fill(f.get("points", ...), (2, 0, MOST["points"]), f"{path}.points", say)
        block, actions = _actions(f.get("actions", ["BLOCK"]), f"{path}.actions", most, say, True)
        if any(a.type == "MUTE" and a.seconds is None for a in actions) and not any(a.type == "NOTIFY_STAFF" for a in actions):
            say(f"{path}.actions", "permanent-mute rules must include NOTIFY_STAFF")
        values = lambda key, f=f, path=path, mode=mode: _values(f.get(key), mode, norm, f"{path}.{key}", say)
        rule = Rule(points, actions, block, bool(f.get("enabled", True)))
        out.append(Filter(name or "invalid", mode, values("terms"), rule, category, severity, tuple(p for p in f.get("patterns") or [] if p in PATTERNS), values("exceptions")))
    return tuple(out)


def _compile(raw: Any, problems: list[Problem], filter_paths: list[str] | None = None) -> Config:
    say = lambda path, message: problems.append(Problem(path, message))
    if not isinstance(raw, dict):
        say("$", "configuration must be an object")
        raw = {}
    c = _fill(raw, SPEC, "$", say)

    def seconds(section: str, key: str, default: int, most: int) -> int:
        try:
            return parse_duration(c[section][key], most)
        except ValueError as e:
            say(f"$.{section}.{key}", str(e))
            return default

    mute = seconds("mutes", "maximum_duration", 30 * DAY, MOST["mute"])
    cooldown = seconds("mutes", "notification_cooldown", 5, mute)
    seconds("staff_alerts", "mute_button_duration", 300, mute)
    norm = c["normalization"] | {k: _substitutions(c["normalization"][k], f"$.normalization.{k}", say) for k in TABLES}
    rules = {}
    for name, r in c["rules"].items():
        block, actions = _actions(r["actions"], f"$.rules.{name}.actions", mute, say, True)
        own = {k: v for k, v in r.items() if k not in ("enabled", "points", "actions")}
        if name == "advertising":
            own["allowed_domains"] = _domains(own["allowed_domains"], "$.rules.advertising.allowed_domains", say)
        rules[name] = Rule(r["points"], actions, block, r["enabled"], own)
    if rules["similarity_spam"].minimum_length > rules["similarity_spam"].maximum_processed_length:
        say("$.rules.similarity_spam.minimum_length", "must not exceed maximum_processed_length")
    if str(c["score"]["threshold_mode"]).upper() != "HIGHEST_CROSSED":
        say("$.score.threshold_mode", "only HIGHEST_CROSSED is supported")
    thresholds, before = [], 0
    for i, t in enumerate(c["score"]["thresholds"]):
        path = f"$.score.thresholds[{i}]"
        got = _fill(t, {"points": (1, 1, MOST["threshold"]), "actions": []}, path, say)
        if got["points"] <= before:
            say(f"{path}.points", "threshold points must be positive and strictly increasing")
        before = max(before, got["points"])
        thresholds.append((got["points"], _actions(got["actions"], f"{path}.actions", mute, say, False)[1]))
    for i, p in enumerate(c["filter_packs"]["active"]):
        if not isinstance(p, str) or not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", p):
            say(f"$.filter_packs.active[{i}]", "must be a valid filter-pack ID")
        elif p in c["filter_packs"]["active"][:i]:
            say(f"$.filter_packs.active[{i}]", "duplicate pack ID")
    part = r"[a-zA-Z0-9][a-zA-Z0-9._-]{0,63}"
    if not re.fullmatch(f"{part}(?:/{part})*", c["filter_packs"]["directory"]):
        say("$.filter_packs.directory", "must be a safe relative directory")
    paths = filter_paths or [f"$.filters[{i}]" for i in range(len(c["filters"]))]
    filters = _filters(c["filters"], norm, mute, say, paths)
    score = c["score"]
    return Config(c["enabled"], c["permissions"], norm, rules, filters, tuple(thresholds), score["point_decay_minutes"] * 60, score["maximum_points_per_message"], c["staff_alerts"]["show_original"], c["logging"], c["history"], c["state"], cooldown, mute, c["filter_packs"])


def _parse(text: str, where: str, problems: list[Problem]) -> Any:
    try:
        return json.loads(text)
    except ValueError as e:
        problems.append(Problem(where, f"invalid JSON: {e}"))
        return {}


def load(text: str) -> Config:
    """A configuration from JSON; ConfigError with every problem found."""
    problems: list[Problem] = []
    config = _compile(_parse(text, "$", problems), problems)
    if problems:
        raise ConfigError(problems)
    return config


def load_bundle(main: str, packs: Mapping[str, str], exceptions: str | None = None) -> Config:
    """The main configuration, its active packs in order, and global exceptions; all or nothing."""
    problems: list[Problem] = []
    raw = _parse(main, "$", problems)
    filters = list(raw.get("filters", []))
    paths = [f"$.filters[{i}]" for i in range(len(filters))]
    use = raw.get("filter_packs", {})
    for name in use.get("active", []) if use.get("enabled", True) else []:
        file = f"{name}.json"
        if file not in packs:
            problems.append(Problem(file, "active pack is missing"))
            continue
        pack = _parse(packs[file], file, problems)
        for key in pack.keys() - {"schema_version", "id", "rules"}:
            problems.append(Problem(f"{file}:$.{key}", "unknown property"))
        if pack.get("schema_version") != 1:
            problems.append(Problem(f"{file}:$.schema_version", "only schema version 1 is supported"))
        if pack.get("id") != name:
            problems.append(Problem(f"{file}:$.id", "must equal the file's name"))
        rules = pack.get("rules") or []
        filters += rules
        paths += [f"{file}:$.rules[{i}]" for i in range(len(rules))]
    if exceptions is not None:
        got = _parse(exceptions, "exceptions.json", problems)
        known = {f.get("id"): k for k, f in enumerate(filters) if isinstance(f, dict)}
        for i, e in enumerate(got.get("global_exceptions", [])):
            for j, target in enumerate(e.get("applies_to", [])):
                if target not in known:
                    problems.append(Problem(f"exceptions.json:$.global_exceptions[{i}].applies_to[{j}]", f"unknown rule: {target}"))
                    continue
                f = filters[known[target]]
                filters[known[target]] = f | {"exceptions": [*(f.get("exceptions") or []), e.get("term")]}
    config = _compile({**raw, "filters": filters}, problems, paths)
    if problems:
        raise ConfigError(problems)
    return config


def default_config(**changes: Any) -> Config:
    return replace(load("{}"), **changes)


def check_reload(config: Config, tracked_players: int, score_entries: int) -> list[Problem]:
    """Why a valid configuration must not replace the active one: limits below what is in use."""
    out = []
    if config.state["maximum_tracked_players"] < tracked_players:
        out.append(Problem("$.state.maximum_tracked_players", f"must be at least {tracked_players}, the players tracked now"))
    if config.state["maximum_score_entries_per_player"] < score_entries:
        out.append(Problem("$.state.maximum_score_entries_per_player", f"must be at least {score_entries}, the most entries in use"))
    return out


def reload(active: Config, main: str, packs: Mapping[str, str], exceptions: str | None, tracked_players: int, score_entries: int) -> tuple[Config, list[Problem]]:
    """The configuration to go on with, and why it is not the new one: any problem leaves the active one in place."""
    try:
        new = load_bundle(main, packs, exceptions)
    except ConfigError as e:
        return active, list(e.problems)
    problems = check_reload(new, tracked_players, score_entries)
    return (active, problems) if problems else (new, [])


def migrate_pack(text: str, required: Mapping[str, list[str]], marker: str) -> str:
    """Adds required terms to a pack's rules, once: a pack that carries ``marker`` is returned as it is."""
    pack = json.loads(text)
    if marker in pack.get("migrations", []):
        return text
    for rule in pack.get("rules", []):
        rule["terms"] = list(dict.fromkeys([*rule.get("terms", []), *required.get(rule.get("id"), [])]))
    return json.dumps(pack | {"migrations": [*pack.get("migrations", []), marker]}, ensure_ascii=False)


def read_packs(folder: str) -> dict[str, str]:
    """The texts of a folder's packs by file name, in order; global exceptions are no pack. ValueError for an unsafe name."""
    out = {}
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if not name.endswith(".json") or name == "exceptions.json" or not os.path.isfile(path):
            continue
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", name.removesuffix(".json")):
            raise ValueError(f"invalid name of a filter pack: {name}")
        with open(path, encoding="utf-8") as f:
            out[name] = f.read()
    return out


def migrate_packs(packs: Mapping[str, str], required: Mapping[str, Mapping[str, list[str]]], marker: str) -> dict[str, str]:
    """All packs (text by name) with what ``required`` (by name) adds to them, or none: an error in one changes no other."""
    return dict(packs) | {name: migrate_pack(packs[name], rules, marker) for name, rules in required.items() if name in packs}


@dataclass(frozen=True)
class Alerts:
    """Where alerts go, and who may act on them."""

    enabled: bool = False
    token_environment_variable: str = "DISCORD_BOT_TOKEN"
    bot_token: str = ""
    guild_id: str = ""
    alert_channel_id: str = ""
    allowed_role_ids: tuple[str, ...] = ()
    allowed_user_ids: tuple[str, ...] = ()
    mention_role_id: str = ""
    case_expiry_seconds: int = DAY
    include_original_message: bool = False
    actions: Mapping[str, bool] = field(default_factory=lambda: {"mute_10_minutes": True, "mute_1_hour": True, "permanent_ban": True})


def snowflake(value: Any) -> bool:
    """An unsigned decimal identifier of 64 bits, not zero."""
    return isinstance(value, str) and re.fullmatch(r"[0-9]{1,20}", value) is not None and 0 < int(value) < 1 << 64


def load_alerts(content: str, environment: Mapping[str, str]) -> tuple[Alerts, list[Problem]]:
    """The configuration of alerts; with any problem, alerts are off and the problems are returned."""
    problems: list[Problem] = []
    say = lambda path, message: problems.append(Problem(path, message))
    try:
        raw = json.loads(content)
    except ValueError:
        return Alerts(), [Problem("$", "invalid JSON")]
    if not isinstance(raw, dict):
        return Alerts(), [Problem("$", "must be a JSON object")]

    def get(name: str, default: Any, kind: type, word: str, of: Mapping[str, Any] = raw, at: str = "$") -> Any:
        value = of.get(name)
        if value is None:
            return default
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            say(f"{at}.{name}", f"must be {word}")
            return default
        return value.strip() if kind is str else value

    def ids(name: str) -> tuple[str, ...]:
        out = []
        for i, value in enumerate(get(name, [], list, "an array")):
            value = value.strip() if isinstance(value, str) else value
            if value == "":
                continue
            if snowflake(value):
                out.append(value)
            else:
                say(f"$.{name}[{i}]", "must be an unsigned decimal identifier")
        return tuple(dict.fromkeys(out))

    base = Alerts()
    string, boolean = (str, "a string"), (bool, "a boolean")
    if get("schema_version", 1, int, "an integer") != 1:
        say("$.schema_version", "must equal 1")
    enabled = get("enabled", False, *boolean)
    variable, token = get("token_environment_variable", base.token_environment_variable, *string), get("bot_token", "", *string)
    guild, channel, mention = (get(n, "", *string) for n in ("guild_id", "alert_channel_id", "mention_role_id"))
    roles, users = ids("allowed_role_ids"), ids("allowed_user_ids")
    chosen = get("actions", {}, dict, "an object")
    actions = {k: get(k, v, *boolean, chosen, "$.actions") for k, v in base.actions.items()}
    try:
        expiry = parse_duration(get("case_expiry", "24h", *string), 7 * DAY)
        if expiry < 300:
            raise ValueError
    except ValueError:
        say("$.case_expiry", "must be a duration between 5 minutes and 7 days")
        expiry = base.case_expiry_seconds
    for name, value in (("guild_id", guild), ("alert_channel_id", channel), ("mention_role_id", mention)):
        if value and not snowflake(value):
            say(f"$.{name}", "must be an unsigned decimal identifier")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", variable):
        say("$.token_environment_variable", "must be a valid environment-variable name")
    if enabled:
        for name, value in (("guild_id", guild), ("alert_channel_id", channel)):
            if not value:
                say(f"$.{name}", "is required while alerts are enabled")
        if any(actions.values()) and not roles and not users:
            say("$.allowed_role_ids", "at least one allowed role or user is required while actions are enabled")
        if not environment.get(variable, "").strip() and not token:
            say("$.bot_token", "must be given here or by the environment variable")
    got = Alerts(enabled and not problems, variable, token, guild, channel, roles, users, mention, expiry, get("include_original_message", False, *boolean), actions)
    return got, problems
