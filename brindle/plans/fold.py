"""The stateful tier: one player's state and one message give the next state and a report.

Needed where actions mute, since a muted message is neither judged nor
remembered, and for control events (mute, unmute, clear). Stateless matches
arrive with the message; history rules, scores, thresholds, mutes and records
are decided here. Times are microseconds. State is plain data, so that it can be
kept as JSON by a stream, a batch or a snapshot alike.
"""

from __future__ import annotations

from typing import Any

from brindle.functions import plain
from brindle.plans.config import MOST, SEVERITIES, Action, Config

INT_MAX = 2_147_483_647
SECOND = 1_000_000
DAY = 86_400 * SECOND


def new_state() -> dict[str, Any]:
    return {"times": [], "recent": [], "entries": [], "mute": None, "violations": [], "crossed": [], "noticed": None, "active": None}


def score(state: dict, now: int) -> int:
    return min(INT_MAX, sum(e["points"] for e in state["entries"] if e["expires"] > now))


def muted(state: dict, now: int) -> bool:
    m = state["mute"]
    return m is not None and (m["until"] is None or m["until"] > now)


def stronger(a: dict | None, b: dict) -> dict:
    """The mute that stands: a permanent one, else the longer."""
    if a is None or b["until"] is None:
        return b
    return a if a["until"] is None or a["until"] >= b["until"] else b


def history_matches(state: dict, message: dict, config: Config) -> list[dict]:
    """Duplicate, rapid and similarity matches of a message (ts, canonical, deobfuscated)."""
    dup, rapid, sim = (config.rules[k] for k in ("duplicate_spam", "rapid_spam", "similarity_spam"))
    now, out = message["ts"], []

    def claims(x: dict, place: int) -> bool:
        return dup.enabled and len(message["canonical"]) >= dup.minimum_length and place <= dup.history_size and x["ts"] >= now - dup.duplicate_window_seconds * SECOND and x["canonical"] == message["canonical"]

    newest = list(enumerate(reversed(state["recent"]), 1))
    if any(claims(x, k) for k, x in newest):
        out.append({"rule_id": "spam.duplicate", "category": "DUPLICATE", "rule": dup})
    if rapid.enabled:
        gap = now - state["times"][-1] if state["times"] else None
        soon = gap is not None and 0 <= gap < rapid.minimum_interval_ms * 1_000
        if soon or sum(t >= now - rapid.window_seconds * SECOND for t in state["times"]) >= rapid.maximum_messages_in_window:
            out.append({"rule_id": "spam.rapid", "category": "SPAM", "rule": rapid})
    text = message["deobfuscated"][: sim.maximum_processed_length]
    if sim.enabled and len(text) >= sim.minimum_length:
        for k, x in newest[: sim.history_size]:
            clear = x["clear"][: sim.maximum_processed_length]
            if x["ts"] >= now - sim.window_seconds * SECOND and not (clear == text and claims(x, k)) and plain.similar(text, clear, sim.similarity_threshold):
                out.append({"rule_id": "spam.similarity", "category": "SIMILARITY", "rule": sim})
                break
    return [{"rule_id": m["rule_id"], "category": m["category"], "severity": "MODERATE", "points": m["rule"].points, "block": m["rule"].block, "actions": m["rule"].actions} for m in out]


def evaluate(state: dict, message: dict, config: Config) -> tuple[dict, dict]:
    """(next state, report) of a message: ts, seq, canonical, deobfuscated, and matches before and after the history rules."""
    now = message["ts"]
    before = score(state, now)
    report = {"seq": message["seq"], "ts": now, "decision": "ALLOW", "rule_ids": [], "points_before": before, "points_added": 0, "points_after": before, "threshold_crossed": None, "actions": []}
    if not config.enabled or message.get("bypass_all"):
        return state, report
    if muted(state, now):
        notice = state["noticed"] is None or state["noticed"] + config.notice_cooldown_seconds * SECOND <= now
        report |= {"decision": "BLOCK", "actions": ["WARN"] if notice else []}
        return (state | {"noticed": now, "active": now} if notice else state), report
    skip = set(message.get("bypass") or ())
    found = [*message["first"], *(m for m in history_matches(state, message, config) if m["category"] not in skip), *message["last"]]
    matches = list({m["rule_id"]: m for m in reversed(found)}.values())[::-1]
    live = [e for e in state["entries"] if e["expires"] > now]
    left, new = config.cap, []
    for m in matches:
        if (award := min(m["points"], left)) > 0:
            new.append({"points": award, "rule": m["rule_id"], "created": now, "expires": now + config.decay_seconds * SECOND})
            left -= award
    if len(live) + len(new) > config.state["maximum_score_entries_per_player"] and new:
        matches.append({"rule_id": "security.state_capacity", "category": "SECURITY", "severity": "HIGH", "points": 0, "block": True, "actions": (Action("NOTIFY_STAFF"),)})
        new = []
    added = sum(e["points"] for e in new)
    after = min(INT_MAX, before + added)
    crossed = max((t for t, _ in config.thresholds if before < t <= after), default=None)
    every = list(dict.fromkeys([a for m in matches for a in m["actions"]] + [a for t, actions in config.thresholds if t == crossed for a in actions]))
    mute = state["mute"] if muted(state, now) else None
    asked = None
    for a in every:
        if a.type == "MUTE":
            got = {"until": None if a.seconds is None else now + a.seconds * SECOND, "at": now, "reason": a.reason, "rule": matches[0]["rule_id"] if matches else "none"}
            asked = stronger(asked, got)
    if asked:
        mute = stronger(mute, asked)
    kinds = [a.type for a in every if a.type in ("WARN", "KICK", "EXECUTE_COMMAND")] + ["MUTE"] * bool(asked) + ["NOTIFY_STAFF"] * any(a.type == "NOTIFY_STAFF" for a in every)
    report |= {"decision": "BLOCK" if any(m["block"] for m in matches) else "ALLOW", "rule_ids": [m["rule_id"] for m in matches], "points_added": added, "points_after": after, "threshold_crossed": crossed, "actions": kinds}
    dup, sim, rapid = (config.rules[k] for k in ("duplicate_spam", "similarity_spam", "rapid_spam"))
    keep = max(dup.duplicate_window_seconds, sim.window_seconds) * SECOND
    recent = [x for x in state["recent"] if x["ts"] >= now - keep] + [{"ts": now, "canonical": message["canonical"], "clear": message["deobfuscated"][: MOST["similar_length"]]}]
    times = [t for t in state["times"] if t >= now - rapid.window_seconds * SECOND] + [now]
    records = [v for v in state["violations"] if v["ts"] >= now - config.history["retention_days"] * DAY]
    if matches:
        worst = max(matches, key=lambda m: SEVERITIES.index(m["severity"]))["severity"]
        records.append({"ts": now, "seq": message["seq"], "rule_ids": report["rule_ids"], "categories": list(dict.fromkeys(m["category"] for m in matches)), "severity": worst, "decision": report["decision"], "points_added": added, "score_after": after, "actions": list(dict.fromkeys(kinds))})
    return {
        "times": times[-rapid.maximum_messages_in_window :],
        "recent": recent[-max(dup.history_size, sim.history_size) :],
        "entries": live + new,
        "mute": mute,
        "violations": records[-config.history["maximum_entries_per_player"] :],
        "crossed": [t for t, _ in config.thresholds if after >= t],
        "noticed": state["noticed"],
        "active": now,
    }, report


def control(state: dict, event: dict, config: Config) -> dict:
    """The state after a staff event: mute (seconds, or none for ever), unmute, or clear (score, history, spam, all)."""
    now, kind = event["ts"], event["kind"]
    if kind == "mute":
        seconds = event.get("seconds")
        if seconds is not None and not 0 < seconds <= config.mute_seconds:
            raise ValueError("a mute lasts longer than nothing and at most the configured maximum")
        held = state["mute"] if muted(state, now) else None
        return state | {"mute": stronger(held, {"until": None if seconds is None else now + seconds * SECOND, "at": now, "reason": event.get("reason", ""), "rule": None})}
    if kind == "unmute":
        if not muted(state, now):
            return state | {"mute": None}
        record = {"ts": now, "seq": event.get("seq"), "rule_ids": ["manual.unmute"], "categories": [], "severity": "LOW", "decision": "ALLOW", "points_added": 0, "score_after": score(state, now), "actions": []}
        return state | {"mute": None, "noticed": None, "violations": [*state["violations"], record][-config.history["maximum_entries_per_player"] :]}
    scope = event["scope"]
    out = dict(state)
    if scope in ("score", "all"):
        out |= {"entries": [], "crossed": []}
    if scope in ("history", "all"):
        out |= {"violations": []}
    if scope in ("spam", "all"):
        out |= {"times": [], "recent": []}
    return out


def cleared(before: dict, after: dict, scope: str) -> bool:
    """Whether a clear of ``scope`` changed anything."""
    kinds = {"score": ("entries", "crossed"), "history": ("violations",), "spam": ("times", "recent")}
    return any(before[k] != after[k] for s, keys in kinds.items() if scope in (s, "all") for k in keys)


def pruned(state: dict, now: int, config: Config) -> dict | None:
    """Without what has expired: scores, a mute, old records. After the idle time buffers go too, and a player whole
    without a mute, a score, a crossed threshold or a record."""
    state = state | {
        "entries": [e for e in state["entries"] if e["expires"] > now],
        "mute": state["mute"] if muted(state, now) else None,
        "violations": [v for v in state["violations"] if v["ts"] >= now - config.history["retention_days"] * DAY],
    }
    if state["active"] is None or state["active"] >= now - idle(config):
        return state
    durable = state["mute"] or state["entries"] or state["crossed"] or state["violations"]
    return state | {"times": [], "recent": [], "noticed": None} if durable else None


def idle(config: Config) -> int:
    """The idle time after which :func:`pruned` clears a player."""
    return config.state["inactive_player_minutes"] * 60 * SECOND


def preview(state: dict | None, message: dict, config: Config) -> dict:
    """The report that a message would have, by a state that stays as it is; a mute does not count."""
    return evaluate((state or new_state()) | {"mute": None}, message, config)[1]
