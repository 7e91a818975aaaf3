"""DuckDB SQL for the queries over message tables, written without the engine's constructs: no look-around, no back-references."""

from __future__ import annotations

from brindle.plans.config import LEET, LOOKALIKE
from brindle.plans.queries import CANONICAL, COLLAPSE, FILTER_SQL, FORMS_SQL, FRONTS, PACK, _translate
from brindle.sources.messages import CONVERSATIONS_SQL, MESSAGES_SQL

ALNUM = r"[^\p{L}\p{Nd}]"
LETTERS = r"len(regexp_extract_all(raw, '\p{L}'))"
UPPER = r"len(regexp_extract_all(raw, '\p{Lu}'))"
DUPLICATE = "length(canonical) >= 3 AND list_contains(list_transform(list_filter(h, lambda x: x.ms >= ms - 45000), lambda x: x.canonical), canonical)"
HISTORY = "coalesce(list({{'ms': ms, 'canonical': canonical}}) OVER (PARTITION BY player_id ORDER BY ms, seq ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING), [])"


def sliced(messages: str, where: str = "true", flood: str = "true") -> str:
    """Common tables up to ``e``: matches, scores and crossings of length, capitals and duplicates."""
    return f"""
WITH {messages},
n AS (SELECT *, {CANONICAL} AS canonical FROM m WHERE {where}),
h AS (SELECT *, {HISTORY.format(8)} AS h FROM n),
d AS (SELECT *, (length(raw) > 220 AND {flood}) AS len, ({LETTERS} >= 8 AND {UPPER} > 0.75 * {LETTERS} AND {flood}) AS cap, ({DUPLICATE}) AS dup FROM h),
p AS (SELECT *, len::INT + cap::INT + 2 * dup::INT AS points_added FROM d),
s AS (
  SELECT *, coalesce(sum(points_added) OVER (PARTITION BY player_id ORDER BY ms RANGE BETWEEN 1799999 PRECEDING AND CURRENT ROW), 0)
          - coalesce(sum(points_added) OVER (PARTITION BY player_id, ms ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS points_before
  FROM p),
e AS (
  SELECT *, points_before + points_added AS points_after, len OR cap OR dup AS hit,
    CASE WHEN points_before < 20 AND points_before + points_added >= 20 THEN 20 WHEN points_before < 10 AND points_before + points_added >= 10 THEN 10
         WHEN points_before < 5 AND points_before + points_added >= 5 THEN 5 WHEN points_before < 2 AND points_before + points_added >= 2 THEN 2 END AS threshold_crossed,
    CASE WHEN len OR cap OR dup THEN 'BLOCK' ELSE 'ALLOW' END AS decision
  FROM s)
"""


E = sliced(MESSAGES_SQL)
RULES = "(VALUES (0, 'flooding.message_length', 'FLOODING', 1), (1, 'flooding.caps', 'FLOODING', 1), (2, 'spam.duplicate', 'DUPLICATE', 2)) r(k, rule_id, category, points)"
LONG = f"{E}, x AS (SELECT player_id, seq, k, rule_id, category, 'MODERATE' AS severity, points, (k > 0 AND len)::INT + (k > 1 AND cap)::INT AS pos FROM e, {RULES} WHERE CASE k WHEN 0 THEN len WHEN 1 THEN cap ELSE dup END)"
RULE_IDS = "array_to_string(list_filter([CASE WHEN len THEN 'flooding.message_length' END, CASE WHEN cap THEN 'flooding.caps' END, CASE WHEN dup THEN 'spam.duplicate' END], lambda x: x IS NOT NULL), ',')"
NOW = "(player_id * 3600000 + 1704067260000)"
PLACED = f"{E}, v AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ms DESC, seq DESC) AS place FROM e WHERE hit AND ms >= {NOW} - 2592000000), t AS (SELECT *, count(*) OVER (PARTITION BY player_id) AS total_entries FROM v WHERE place <= 100)"
ACTIONS = "CASE threshold_crossed WHEN 2 THEN 'WARN' WHEN 5 THEN 'WARN,KICK' WHEN 10 THEN 'KICK' WHEN 20 THEN 'EXECUTE_COMMAND' END"
# Fixed values, apart from the engine's: ISO 3166-1 alpha-2 codes by their first letter, and the generic domains.
COUNTRIES = {
    "a": "defgilmoqrstuwxz", "b": "abdefghijlmnoqrstvwyz", "c": "acdfghiklmnoruvwxyz", "d": "ejkmoz", "e": "ceghrst", "f": "ijkmor", "g": "abdefghilmnpqrstuwy", "h": "kmnrtu", "i": "delmnoqrst",
    "j": "emop", "k": "eghimnprwyz", "l": "abcikrstuvy", "m": "acdefghklmnopqrstuvwxyz", "n": "acefgilopruz", "o": "m", "p": "aefghklmnrstwy", "q": "a", "r": "eosuw", "s": "abcdeghijklmnorstvxyz",
    "t": "cdfghjklmnortvwz", "u": "agmsyz", "v": "aceginu", "w": "fs", "y": "et", "z": "amw",
}
GENERIC = (
    "com net org gg io co uk us de dev app me tv info biz xyz online site store fr nl ru ca au edu gov mil cloud tech games network website pro club live shop ai "
    "lol top world fun icu link space digital agency studio solutions services social today news wiki"
)
DOTTED = "com|net|org|gg|io|co|uk|us|de|dev|app|me|tv|info|biz|xyz|online|site|store|fr|nl|ru|ca|au|lol|top|world|fun|icu|link|space|digital|agency|studio|solutions|services|social|today|news|wiki"
TLDS = ", ".join(f"'{t}'" for t in [*GENERIC.split(), *(a + b for a, rest in COUNTRIES.items() for b in rest)])

CHAR, ZERO = r"[\p{L}\p{N}]", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]"


def _unhidden(value: str) -> str:
    """One round of bracketed, spaced and worded dots."""
    value = rf"regexp_replace({value}, '({CHAR})\s*(?:\[\s*\.\s*\]|\(\s*\.\s*\))\s*({CHAR})', '\1.\2', 'g')"
    value = rf"regexp_replace({value}, '({CHAR})\s+\.\s+({CHAR})', '\1.\2', 'g')"
    return rf"regexp_replace({value}, '({CHAR})(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\))|\s+dot\s+)\s*({DOTTED})(-*)($|[^\p{{L}}\p{{N}}-])', '\1.\2\3\4', 'g')"


#: Lines with their fronts, forms, flags and the link form ``v``.
LINKED = rf"""
WITH {MESSAGES_SQL},
z AS (SELECT * REPLACE (coalesce(list_extract([{", ".join(f"'{x}'" for x in FRONTS)}], (seq * 5 + player_id) % {3 * len(FRONTS)} + 1), '') || raw AS raw) FROM m),
n AS (SELECT *, {CANONICAL} AS canonical FROM z),
f AS (SELECT *, {_translate("canonical", LOOKALIKE)} AS looked, {_translate(_translate("canonical", LOOKALIKE), LEET)} AS clear FROM n),
o AS (SELECT *, regexp_replace(list_reduce(list_prepend(clear, regexp_extract_all(clear, '(^|[^\p{{L}}\p{{N}}])((?:{CHAR} ){{2,}}{CHAR})($|[^\p{{L}}\p{{N}}])', 2)), lambda a, x: replace(a, x, replace(x, ' ', ''))), '\s*/\s*', '/', 'g') AS v0 FROM f),
k AS (SELECT *, {_unhidden(_unhidden("v0"))} AS v2 FROM o),
j AS (SELECT *, {_unhidden(_unhidden("v2"))} AS v FROM k),
a AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches(raw, '{ZERO}') THEN 'ZERO_WIDTH_REMOVED' END,
        CASE WHEN regexp_matches(regexp_replace(raw, '{ZERO}', '', 'g'), '[\p{{Cf}}\p{{Co}}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F]') THEN 'CONTROL_REMOVED' END,
        CASE WHEN looked <> canonical THEN 'LOOKALIKE_REPLACED' END, CASE WHEN clear <> looked THEN 'LEETSPEAK_REPLACED' END, CASE WHEN v <> clear THEN 'LINK_SEPARATOR_REWRITTEN' END) AS flags FROM j)
"""
HOSTNAME = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,24}|xn--[a-z0-9-]{2,59})"
#: The first invite, address and host that counts, each null without one.
ADVERTS = rf"""{LINKED},
i AS (SELECT *, nullif(regexp_extract(v, '(?:^|[^a-z0-9-])((?:https?://)?(?:www\.)?(?:discord\.gg|discord(?:app)?\.com/invite)/[a-z0-9-]{{2,}})', 1), '') AS invite,
        replace(regexp_replace(regexp_replace(regexp_replace(canonical, '(\d)(?:\s+\.\s*|\.\s+)(\d)', '\1.\2', 'g'), '(\d)(?:\s+\.\s*|\.\s+)(\d)', '\1.\2', 'g'), '\s*:\s*', ':', 'g'), ' ', '  ') AS w FROM a),
q AS (SELECT *, regexp_extract_all(w, '(^|[^\p{{L}}\p{{N}}.:])(\d{{1,3}}(\.\d{{1,3}}){{3}}(:\d{{1,5}})?)($|[^.:\p{{L}}\p{{N}}])', 2) AS ips,
        regexp_extract_all(replace(v, ' ', '  '), '(?:^|[^a-z0-9-])(?:https?://)?{HOSTNAME}(?:[^a-z0-9-]|$)') AS hosts FROM i),
r AS (SELECT *,
    list_filter(ips, lambda x: list_max(list_transform(string_split(split_part(x, ':', 1), '.'), lambda o: TRY_CAST(o AS INT))) <= 255 AND (NOT contains(x, ':') OR TRY_CAST(split_part(x, ':', 2) AS INT) BETWEEN 1 AND 65535))[1] AS ip,
    list_transform(hosts, lambda x: {{'x': x, 'h': regexp_replace(regexp_replace(x, '^[^a-z0-9-]?(https?://)?', ''), '[^a-z0-9-]$', '')}}) AS l FROM q),
t AS (SELECT *, list_filter(l, lambda y: (split_part(y.h, '.', -1) IN ({TLDS}) OR y.h LIKE 'www.%' OR regexp_matches(y.x, 'https?://|[/:]$') OR split_part(y.h, '.', -1) LIKE 'xn--%')
        AND y.h <> 'example.org' AND NOT ends_with(y.h, '.example.org'))[1].h AS host FROM r)
"""
SCORE_EVENTS = """
WITH p AS (SELECT user_id AS player_id, event_id AS seq, epoch_us(ts) AS us, least(6, 2 * CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 5 END) AS points_added FROM events),
s AS (SELECT *, coalesce(sum(points_added) OVER (PARTITION BY player_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 0)
   - coalesce(sum(points_added) OVER (PARTITION BY player_id, us ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS points_before FROM p)
SELECT player_id, seq, points_before, points_added, points_before + points_added AS points_after FROM s
"""


FAMILY = "'b+a+d+w+o+r+d+(s|y|ish)?'"


def _family(tokens: str) -> str:
    """The first token that the family matches whole, else the first run of up to ten tokens that it matches joined."""
    part = f"{tokens}[i:i + n - 1]"
    fits = f"len({part}) = n AND list_max(list_transform({part}, lambda w: length(w))) <= 16 AND (n = 1 OR length(array_to_string({tokens}[i:i + n - 2], '')) <= 16)"
    runs = f"flatten(list_transform(range(1, len({tokens}) + 1), lambda i: list_transform(range(1, 11), lambda n: CASE WHEN {fits} AND regexp_full_match(array_to_string({part}, ''), {FAMILY}) THEN array_to_string({part}, ' ') END)))"
    return f"coalesce(list_filter({tokens}, lambda w: regexp_full_match(w, {FAMILY}))[1], list_filter({runs}, lambda w: w IS NOT NULL)[1])"


def _bounded(text: str, term: str) -> str:
    return rf"regexp_matches({text}, '(^|{ALNUM}){term}({ALNUM}|$)')"


def _window(term: str) -> str:
    """Consecutive tokens joined to the term; a run of one may be two."""
    chars = [c for c in term if c != " "]
    out, i = [], 0
    while i < len(chars):
        n = 1
        while i + n < len(chars) and chars[i + n] == chars[i]:
            n += 1
        out.append(f"{chars[i]}( ?{chars[i]}){{{n - 1},{max(2, n) - 1}}}")
        i += n
    return "(^| )" + " ?".join(out) + "( |$)"


def _filter(name: str, mode: str, terms: tuple, exceptions: tuple, points: int) -> str:
    term = terms[0]
    either = lambda test: f"({test('ft')} OR {test('fp')})"
    window = lambda c: f"regexp_matches({c}, '{_window(term)}')"
    tests = {
        "WORD": _bounded("deobfuscated", term), "PHRASE": _bounded("deobfuscated", term), "SUBSTRING": f"contains(deobfuscated, '{term}')", "COMPACT": f"contains(compact, '{term}')",
        "COMPACT_WORD": either(window), "COMPACT_PHRASE": either(window), "NORMALIZED_WORD": either(lambda c: f"({_bounded(c, term)} OR {window(c)})"), "NORMALIZED_PHRASE": either(lambda c: f"({_bounded(c, term)} OR {window(c)})"),
    }
    legacy = mode in ("WORD", "PHRASE", "SUBSTRING", "COMPACT")
    value = term.replace(" ", "") if mode.startswith("COMPACT") else term
    return f"{FORMS_SQL if legacy else FILTER_SQL} SELECT player_id, seq, '{name}' AS rule_id, '{value}' AS value FROM {'c' if legacy else 'v'} WHERE {tests[mode]}"


SQL = {
    "moderate_slice": f"{E} SELECT player_id, seq, len::INT + cap::INT + dup::INT AS n_matches, points_after, threshold_crossed, decision FROM e",
    "normalize_forms": f"{FORMS_SQL}, z AS (SELECT *, string_split(deobfuscated, '') AS ch FROM c) SELECT player_id, seq, canonical, deobfuscated, compact, {COLLAPSE.format('ch', '')} AS collapsed FROM z",
    "filter_text_forms": f"{FILTER_SQL} SELECT player_id, seq, ft AS normalized, fp AS punctuated, CASE WHEN ft = '' THEN 0 ELSE len(string_split(ft, ' ')) END AS n_tokens FROM v",
    "text_bounds": rf"""WITH {MESSAGES_SQL},
      b AS (SELECT *, CASE WHEN raw = '' THEN 'unknown' ELSE regexp_replace(replace(regexp_replace(raw, '[\x00-\x1F\x7F-\x{{9F}}\x{{2028}}\x{{2029}}]', '', 'g'), '@', '@' || chr(8203)), '([\\*_~`|>])', '\\\1', 'g') END AS x FROM m)
      SELECT player_id, seq, regexp_replace(raw, '[\x00-\x1F\x7F-\x{{9F}}\x{{2028}}\x{{2029}}]', '', 'g')[1:160] AS bounded,
        regexp_replace(regexp_replace(raw, '[\r\n\x{{2028}}\x{{2029}}]', ' ', 'g'), '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g') AS stored,
        CASE WHEN length(x) > 512 THEN x[1:511] || '…' ELSE x END AS escaped FROM b""",
    "duration_formats": """WITH e AS (SELECT event_id, greatest(event_id * 37 % 200000, 1) AS s FROM events)
      SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS short,
        concat_ws(' ', CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h' END,
          CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) AS "full",
        CASE WHEN s >= 3600 THEN s // 3600 * 3600 WHEN s >= 60 THEN s // 60 * 60 ELSE s END AS parsed FROM e""",
    "detect_length": f"WITH {MESSAGES_SQL} SELECT player_id, seq, 'flooding.message_length' AS rule_id, 1 AS points, length(raw) AS n FROM m WHERE length(raw) > 220",
    "detect_caps": f"WITH {MESSAGES_SQL} SELECT player_id, seq, 'flooding.caps' AS rule_id, 1 AS points FROM m WHERE {LETTERS} >= 8 AND {UPPER} > 0.75 * {LETTERS}",
    "detect_short_runs": rf"""WITH {MESSAGES_SQL}, c AS (SELECT player_id, seq, string_split(raw, '') AS ch FROM m),
      g AS (SELECT player_id, seq, ch, list_filter(range(1, len(ch) - 1), lambda i: ch[i] = ch[i + 1] AND ch[i] = ch[i + 2] AND NOT regexp_matches(ch[i], '[\s\x0B\x1C-\x1F\p{{Z}}]')) AS hits FROM c)
      SELECT player_id, seq, ch[hits[1]] || ch[hits[1]] || ch[hits[1]] AS value FROM g WHERE len(hits) > 0""",
    "link_forms": f"{LINKED} SELECT player_id, seq, v AS link_normalized, flags FROM a",
    "detect_ip": f"{ADVERTS} SELECT player_id, seq, ip AS value FROM t WHERE ip IS NOT NULL",
    "detect_domain": f"{ADVERTS} SELECT player_id, seq, host AS value FROM t WHERE host IS NOT NULL",
    "detect_invite": f"{ADVERTS} SELECT player_id, seq, invite AS value FROM t WHERE invite IS NOT NULL",
    "detect_advertising": f"""{ADVERTS}, h AS (SELECT *, coalesce(invite, ip, host) AS value, CASE WHEN invite IS NOT NULL THEN 'discord_invite' WHEN ip IS NOT NULL THEN 'ip' ELSE 'domain' END AS rule FROM t)
      SELECT player_id, seq, 'advertising.' || rule AS rule_id, 5 AS points, value FROM h WHERE value IS NOT NULL
      UNION ALL SELECT player_id, seq, 'advertising.domain_obfuscation', 0, value FROM h WHERE value IS NOT NULL AND contains(flags, 'LINK_SEPARATOR')""",
    "host_allowlist": r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
      SELECT *, host IN ('example.org', 'example.net') OR host LIKE '%.example.org' OR host LIKE '%.example.net' AS allowed FROM h""",
    "duplicate_spam": f"{E} SELECT player_id, seq, 'spam.duplicate' AS rule_id, canonical AS value FROM e WHERE dup",
    "rapid_spam": f"""WITH {MESSAGES_SQL},
      n AS (SELECT *, lag(ms) OVER w AS last, coalesce(list(ms) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS l FROM m WINDOW w AS (PARTITION BY player_id ORDER BY ms, seq)),
      c AS (SELECT *, len(list_filter(l, lambda x: x >= ms - 8000)) AS k, coalesce(ms - last BETWEEN 0 AND 699, false) AS soon FROM n)
      SELECT player_id, seq, CASE WHEN soon AND k >= 5 THEN 'minimum interval and sliding window' WHEN soon THEN 'minimum interval' ELSE 'sliding window' END AS evidence, k + 1 AS n FROM c WHERE soon OR k >= 5""",
    "similarity_containment": rf"""{FORMS_SQL}, w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(deobfuscated[1:512], '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS b FROM c),
      q AS (SELECT *, lag(b) OVER (PARTITION BY player_id ORDER BY ms, seq) AS a FROM w)
      SELECT player_id, seq, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END, 6) AS containment FROM q WHERE a IS NOT NULL""",
    # The newest earlier message that is alike: equal, or of like length with most words or within an edit bound.
    "similarity_spam": rf"""{FORMS_SQL}, w AS (SELECT *, deobfuscated[1:512] AS now FROM c),
      h AS (SELECT *, list_reverse(coalesce(list({{'ms': ms, 'canonical': canonical, 'x': now}}) OVER (PARTITION BY player_id ORDER BY ms, seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), [])) AS h FROM w),
      a AS (SELECT player_id, seq, now, list_transform(list_filter(h, lambda y: y.ms >= ms - 45000 AND NOT (y.x = now AND length(canonical) >= 3 AND y.canonical = canonical)), lambda y: y.x) AS l,
        list_distinct(list_filter(regexp_split_to_array(now, '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '')) AS mine FROM h WHERE length(now) >= 8),
      g AS (SELECT *, list_transform(l, lambda x: {{'x': x, 'n': least(length(x), length(now)), 'm': greatest(length(x), length(now)), 'ws': list_distinct(list_filter(regexp_split_to_array(x, '[^\p{{L}}\p{{N}}]+'), lambda z: z <> ''))}}) AS p FROM a),
      s AS (SELECT *, list_filter(p, lambda y: y.x = now OR y.n / y.m >= 0.6::DOUBLE AND (y.n >= 4 AND len(mine) > 0 AND len(y.ws) > 0 AND len(list_intersect(mine, y.ws)) / least(len(mine), len(y.ws)) >= 0.86::DOUBLE
        OR y.n / y.m >= 0.86::DOUBLE AND damerau_levenshtein(now, y.x) <= floor((1 - 0.86::DOUBLE) * y.m))) AS found FROM g)
      SELECT player_id, seq, found[1].x AS similar FROM s WHERE len(found) > 0""",
    "detect_repeated_characters": rf"""WITH {MESSAGES_SQL}, z AS (SELECT player_id, seq, string_split(CASE seq % 6 WHEN 1 THEN raw || ' ========' WHEN 2 THEN raw || ' ==========!' ELSE raw END, '') AS ch FROM m),
      g AS (SELECT player_id, seq, ch, list_filter(range(1, len(ch) + 1), lambda i: CASE WHEN regexp_matches(ch[i], '\p{{L}}') THEN len(ch) >= i + 6 AND len(list_distinct(ch[i:i + 6])) = 1
        WHEN regexp_matches(ch[i], '[\s\x0B\x1C-\x1F\p{{Z}}]') THEN false ELSE len(ch) >= i + 8 AND len(list_distinct(ch[i:i + 8])) = 1 END) AS hits FROM z)
      SELECT player_id, seq, repeat(ch[hits[1]], CASE WHEN regexp_matches(ch[hits[1]], '\p{{L}}') THEN 7 ELSE 9 END) AS value FROM g WHERE len(hits) > 0""",
    "filter_builtin_pattern": FILTER_SQL.replace(MESSAGES_SQL, MESSAGES_SQL + ", lines AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN raw || ' B.4.d w0rdz baddw0rds' ELSE raw END AS raw) FROM m)").replace("AS clean FROM m)", "AS clean FROM lines)") + rf""",
      a AS (SELECT player_id, seq, string_split(ft, ' ') AS t, string_split(fp, ' ') AS u FROM v WHERE contains(replace(ft, ' ', ''), 'badw') OR contains(replace(ft, ' ', ''), 'baddw') OR contains(replace(fp, ' ', ''), 'badw') OR contains(replace(fp, ' ', ''), 'baddw')),
      b AS (SELECT *, {_family('t')} AS x, {_family('u')} AS y FROM a)
      SELECT player_id, seq, coalesce(x, y) AS value FROM b WHERE coalesce(x, y) IS NOT NULL""",
    "filter_exceptions": f"""{FORMS_SQL}, o AS (
        SELECT player_id, seq, len(regexp_extract_all(replace(deobfuscated, ' ', '  '), '(^|{ALNUM})and({ALNUM}|$)')) AS found,
               len(regexp_extract_all(replace(deobfuscated, ' ', '  '), '(^|{ALNUM})and  the({ALNUM}|$)')) AS excused FROM c)
      SELECT player_id, seq, 'fx.except' AS rule_id, 'and the' AS exception FROM o WHERE found > 0 AND found = excused""",
    "match_union": f"{LONG} SELECT player_id, seq, pos, rule_id, category, severity, points FROM x",
    "rule_counts": f"{LONG} SELECT rule_id, count(*) AS n, sum(points)::BIGINT AS points FROM x GROUP BY rule_id",
    "category_severity_rollup": f"{LONG} SELECT coalesce(category, 'all') AS category, coalesce(severity, 'all') AS severity, count(*) AS n FROM x GROUP BY ROLLUP (category, severity)",
    "score_transition": f"{E} SELECT player_id, seq, points_before, points_added, points_after FROM e",
    "threshold_crossing": f"{E} SELECT player_id, seq, threshold_crossed FROM e WHERE threshold_crossed IS NOT NULL",
    "point_cap": SCORE_EVENTS,
    "action_plan": f"{E} SELECT player_id, seq, decision, CASE WHEN hit THEN 'MODERATE' ELSE 'LOW' END AS severity, concat_ws(',', {ACTIONS}, CASE WHEN dup THEN 'NOTIFY_STAFF' END) AS actions FROM e",
    "decision_summary": f"{E} SELECT decision, count(*) AS n, sum(points_added)::BIGINT AS points, count(threshold_crossed) AS crossings FROM e GROUP BY decision",
    "template_expand": f"{E} SELECT player_id, seq, 'tempban {{rule}}' || player_id || ' 1d ' || split_part({RULE_IDS}, ',', 1) || ' ' || points_after AS command FROM e WHERE threshold_crossed = 20",
    "violation_history": f"""{E} SELECT player_id, seq, {RULE_IDS} AS rule_ids, concat_ws(',', CASE WHEN len OR cap THEN 'FLOODING' END, CASE WHEN dup THEN 'DUPLICATE' END) AS categories,
      'MODERATE' AS severity, decision, points_added, points_after AS score_after, raw AS original_message FROM e WHERE hit""",
    "history_page": f"""{PLACED}, u AS (SELECT *, greatest(ceil(total_entries / 6), 1)::BIGINT AS total_pages, least(2, greatest(ceil(total_entries / 6), 1))::BIGINT AS page FROM t)
      SELECT player_id, seq, place, page, total_entries, total_pages FROM u WHERE place > (page - 1) * 6 AND place <= page * 6""",
    "history_page_core": f"{PLACED} SELECT player_id, seq, place, total_entries, greatest(ceil(total_entries / 10), 1)::BIGINT AS total_pages FROM t WHERE place > 10 AND place <= 20",
    "history_retention": f"""{E}, v AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ms DESC, seq DESC) AS place FROM e WHERE hit AND ms >= {NOW})
      SELECT player_id, count(*) AS kept, max(seq) AS newest FROM v WHERE place <= 5 GROUP BY player_id""",
    "active_violations": f"""{E} SELECT player_id, seq, points_added, (sum(points_added) OVER (PARTITION BY player_id))::BIGINT AS active_score, row_number() OVER (PARTITION BY player_id ORDER BY ms DESC, seq DESC) AS place
      FROM e WHERE points_added > 0 AND ms <= {NOW} AND ms + 60000 > {NOW}""",
    "max_score_entries": f"{E}, g AS (SELECT player_id, count(*) AS k FROM e WHERE points_added > 0 AND ms <= {NOW} AND ms + 60000 > {NOW} GROUP BY player_id) SELECT coalesce(max(k), 0) AS most_entries FROM g",
    "mute_gate": """SELECT e.user_id AS player_id, e.event_id AS seq FROM events e WHERE NOT EXISTS (
      SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'error' AND e.ts >= o.ts + INTERVAL 1 SECOND AND e.ts < o.ts + INTERVAL 12 HOUR)""",
    "bypass_filter": sliced(CONVERSATIONS_SQL, "role <> 'system'", "role <> 'assistant'") + " SELECT player_id, seq, decision, points_added FROM e UNION ALL SELECT player_id, seq, 'ALLOW', 0 FROM m WHERE role = 'system'",
    "suggest_names": "SELECT DISTINCT c_name AS name FROM customer WHERE trim(c_name) <> '' AND lower(c_name) LIKE 'cust%'",
    "lookup_permission": """SELECT DISTINCT user_id AS player_id, CASE WHEN user_id % 3 = 0 THEN user_id % 2 = 0 ELSE user_id % 5 >= 3 END AS allowed,
      CASE WHEN user_id % 3 = 0 THEN 'PROVIDER' WHEN user_id % 5 >= 3 THEN 'OPERATOR' ELSE 'DENIED' END AS origin FROM events""",
}
SQL["tier_s_evaluate"] = f"{E} SELECT player_id, seq, decision, points_before, points_added, threshold_crossed FROM e"
SQL["audit_daily_counts"] = f"{E} SELECT make_timestamp(ms * 1000)::DATE AS event_date, count(*) AS n, sum(points_added)::BIGINT AS points FROM e WHERE hit GROUP BY ALL"
SQL["snapshot_from_state"] = E.replace(DUPLICATE, "false") + " SELECT player_id, seq, decision, points_before, points_added, points_after, threshold_crossed FROM e WHERE seq > 10"
#: Terms of four syllables with their places, and the first that is among ``parts`` of a message.
MANY_SQL = """, y AS (SELECT unnest(['th', 'an', 'ti', 'er', 'on', 'ha', 'st', 'nd', 'en', 'ed']) AS x, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) AS k),
  terms AS (SELECT a.x || b.x || c.x || d.x AS term, a.k * 1000 + b.k * 100 + c.k * 10 + d.k AS i FROM y a, y b, y c, y d),
  parts AS (SELECT player_id, seq, unnest({parts}) AS term FROM c)
SELECT player_id, seq, 'fx.many' AS rule_id, arg_min(term, i) AS value FROM parts JOIN terms USING (term) GROUP BY player_id, seq"""
SQL["filter_many_words"] = FORMS_SQL + MANY_SQL.format(parts=r"regexp_extract_all(deobfuscated, '[\p{L}\p{Nd}]+')")
SQL["filter_many_substrings"] = FORMS_SQL + MANY_SQL.format(parts="list_transform(range(1, length(deobfuscated) - 6), lambda p: deobfuscated[p:p + 7])")
SQL |= {f"filter_{f[1].lower()}": _filter(*f) for f in PACK[:8]}
