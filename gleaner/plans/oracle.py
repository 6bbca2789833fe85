"""The check's own SQL, for DuckDB: written from the rules and apart from the plans, so that a wrong rule shows.

Where a plan uses a window, its check uses a join, a list or a recursion, and the other way round.
"""

from __future__ import annotations

from gleaner.plans import values as V

LINES = "lines AS (SELECT doc_id AS page_id, CAST(i - 1 AS INT) AS sent_id, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE parts[i] <> '')"
RULES = [(0, "prices"), (1, "dates"), (2, "people")]
TERMS = [(0, "costs"), (1, "names")]


def p(text: str) -> str:
    return f"(CAST('0x' || md5({text})[1:4] AS INT) / CAST(65535 AS DOUBLE))"


def listed(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


JUDGED = f"{LINES}, judged AS (SELECT page_id, sent_id, text, {p('text')} AS keep FROM lines)"
DENIED = listed(V.DENIED_HOSTS)
HOSTS = f"""hosts AS (SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS h FROM pages UNION ALL
SELECT unnest({listed(["www.Example.com ", "mail.google.com", "a.github.com", "notgithub.com", "localhost", "printer", "nas.local", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.9", "169.254.3.4", "8.8.8.8", "intra.corp", "fd00::1", "router.home.arpa", "127.0.0.1", "x_y.com"])})),
clean AS (SELECT DISTINCT CASE WHEN starts_with(lower(trim(h)), 'www.') THEN lower(trim(h))[5:] ELSE lower(trim(h)) END AS host FROM hosts)"""
USERS = "e AS (SELECT user_id, event_id, ts, event_type, epoch_us(ts) AS t FROM events)"
LABELLED = f"l AS (SELECT d.lang, x.quality AS label, {p('d.text')} AS score FROM labels x JOIN documents d USING (doc_id))"


def any_rule(texts: list[tuple[int, str]], separator: int, least: float) -> str:
    """The first of some items whose score for the text reaches a bound."""
    return f"list_min(list_filter({[i for i, _ in texts]}, lambda k: {p(f'concat({listed([x for _, x in texts])}[k + 1], chr({separator}), text)')} >= {least}))"


def answers() -> str:
    kinds = listed(V.KINDS)
    return f"""{JUDGED}, given AS (SELECT page_id, sent_id, keep, CAST(floor(keep * 1000) AS INT) % 7 AS odd, {kinds}[CAST(floor(keep * 13) AS INT) + 1] AS kind FROM judged),
parsed AS (SELECT page_id, sent_id, odd = 0 OR kind IS NULL AS failed, kind, CASE odd WHEN 1 THEN least(1, keep + 0.5) WHEN 2 THEN greatest(0, keep - 0.5) ELSE keep END AS keep FROM given)"""


def pack_scores() -> str:
    """A score column for each kind of page."""
    out = []
    for name, signals in V.PACKS:
        parts = []
        if "jsonld" in signals:
            parts.append(f"CASE WHEN len(list_intersect(types, {listed(signals['jsonld'])})) > 0 THEN {V.WEIGHTS['jsonld']} ELSE 0 END")
        if "og" in signals:
            parts.append(f"CASE WHEN og IN {tuple(signals['og']) if len(signals['og']) > 1 else f'({chr(39)}{signals['og'][0]}{chr(39)})'} THEN {V.WEIGHTS['og']} ELSE 0 END")
        if "path" in signals:
            parts.append(f"CASE WHEN len(list_filter({listed(signals['path'])}, lambda x: contains(path, '/' || x || '/'))) > 0 THEN {V.WEIGHTS['path']} ELSE 0 END")
        if "host" in signals:
            parts.append(f"CASE WHEN len(list_filter({listed(signals['host'])}, lambda x: CASE WHEN ends_with(x, '.') THEN starts_with(host, x) ELSE host = x OR ends_with(host, '.' || x) END)) > 0 THEN {V.WEIGHTS['host']} ELSE 0 END")
        if "cue" in signals:
            parts.append(f"least({V.CUE_CAP}, {V.WEIGHTS['cue']} * len(list_filter({listed(signals['cue'])}, lambda x: contains(hay, x))))")
        out.append(f"round(least(1, {' + '.join(parts)})::DOUBLE, 6) AS {name}")
    return ", ".join(out)


def routed() -> str:
    from gleaner.plans.sql import SIGNAL_PAGES

    more = " ".join(f"UNION ALL SELECT {i}, 'https://{host}/', '{html}'" for i, host, html in SIGNAL_PAGES)
    names = [name for name, _ in V.PACKS]
    return f"""WITH source AS (SELECT page_id, url, html FROM pages {more}),
meta AS (SELECT page_id, regexp_extract(url, '^https?://(?:www[.])?([^/?#:]+)', 1) AS host, regexp_extract_all(lower(html), '"@type"\\s*:\\s*"([^"]+)"', 1) AS types, regexp_extract(lower(html), '<meta property="og:type" content="([^"]*)"', 1) AS og,
  '/' || trim(regexp_extract(lower(url), '^https?://[^/?#]+([^?#]*)', 1), '/') || '/' AS path, lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || substr(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1, 600)) AS hay FROM source),
scores AS (SELECT page_id, {pack_scores()} FROM meta),
best AS (SELECT page_id, [{", ".join(names)}] AS s FROM scores)
SELECT page_id, CASE WHEN list_max(s) >= {V.ROUTE_AT} THEN {listed(names)}[list_position(s, list_max(s))] ELSE 'other' END AS page_kind, CAST(list_max(s) AS DOUBLE) AS score FROM best"""


ORACLES = {
    "host_normalize": f"WITH {HOSTS} SELECT h, CASE WHEN starts_with(lower(trim(h)), 'www.') THEN lower(trim(h))[5:] ELSE lower(trim(h)) END AS host FROM hosts",
    "host_deny": f"WITH {HOSTS} SELECT host FROM clean WHERE len(list_filter({DENIED}, lambda x: host = x OR ends_with(host, '.' || x))) > 0",
    "host_enabled": f"WITH {HOSTS} SELECT host, host <> '' AND (host = 'a.github.com' OR len(list_filter({DENIED}, lambda x: host = x OR ends_with(host, '.' || x))) = 0) AS enabled FROM clean",
    "min_sentences": f"SELECT doc_id AS page_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS sentences FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) >= {V.MIN_SENTENCES}",
    "page_sample": "SELECT doc_id AS page_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))[1:600] AS sample FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) > 0",
    "balanced_chunks": f"""WITH {LINES}, n AS (SELECT page_id, list(sent_id ORDER BY sent_id) AS ids FROM lines GROUP BY page_id),
      c AS (SELECT page_id, ids, CAST(ceil(len(ids) / {V.PER_REQUEST}.0) AS BIGINT) AS c FROM n),
      k AS (SELECT page_id, ids, c, unnest(range(c)) AS chunk FROM c),
      s AS (SELECT *, len(ids) // c + CASE WHEN chunk < len(ids) % c THEN 1 ELSE 0 END AS size FROM k),
      b AS (SELECT *, CAST(sum(size) OVER (PARTITION BY page_id ORDER BY chunk) AS BIGINT) AS upto FROM s)
      SELECT page_id, chunk, size AS sentences, ids[upto - size + 1] AS first_id, ids[upto] AS last_id FROM b""",
    "rule_keep": f"WITH {JUDGED}, r AS (SELECT *, {any_rule(RULES, 31, V.RULE_AT)} AS rule_order FROM judged) SELECT page_id, sent_id, keep < {V.KEEP_AT} AND rule_order IS NULL AS faded, rule_order FROM r",
    "mark_keep": f"WITH {JUDGED}, r AS (SELECT *, {any_rule(TERMS, 30, V.MARK_AT)} AS term_order FROM judged) SELECT page_id, sent_id, keep < {V.KEEP_AT} AND term_order IS NULL AS faded, term_order FROM r",
    "rule_hits": f"WITH {JUDGED}, r AS (SELECT unnest({listed([x for _, x in RULES])}) AS rule) SELECT d.doc_id AS page_id, r.rule, (SELECT count(*) FROM lines l WHERE l.page_id = d.doc_id AND {p('concat(r.rule, chr(31), l.text)')} >= {V.RULE_AT}) AS hits FROM documents d, r",
    "mark_hits": f"WITH {JUDGED}, t AS (SELECT unnest({listed([x for _, x in TERMS])}) AS term) SELECT d.doc_id AS page_id, t.term, (SELECT count(*) FROM lines l WHERE l.page_id = d.doc_id AND {p('concat(t.term, chr(30), l.text)')} >= {V.MARK_AT}) AS spans, (SELECT count(*) FROM lines l WHERE l.page_id = d.doc_id AND {p('concat(t.term, chr(30), l.text)')} >= {V.MARK_AT}) AS sentences FROM documents d, t",
    "missing_rules": f"WITH {JUDGED}, r AS (SELECT unnest({listed([x for _, x in RULES])}) AS rule) SELECT doc_id AS page_id, rule FROM documents, r EXCEPT SELECT page_id, rule FROM lines, r WHERE {p('concat(rule, chr(31), text)')} >= 0.8",
    "pin_override": f"WITH {JUDGED} SELECT page_id, sent_id, keep >= {V.KEEP_AT} OR sent_id IN (SELECT 5 * unnest(range(5000))) AS kept, sent_id % 5 = 0 AS pinned FROM judged",
    "threshold_counts": f"WITH {JUDGED} SELECT CAST(t AS DOUBLE) AS threshold, page_id, count(*) AS total, count(*) FILTER (keep >= t) AS kept FROM judged, (SELECT unnest([0.1, 0.25, 0.5, 0.9]::DOUBLE[]) AS t) GROUP BY t, page_id",
    "page_counts": f"WITH {answers()} SELECT page_id, count(*) AS total, count(*) FILTER (keep >= {V.KEEP_AT}) AS kept, count(*) FILTER (keep < {V.KEEP_AT}) AS faded FROM parsed WHERE NOT failed GROUP BY page_id",
    "reason_word": f"WITH {answers()} SELECT page_id, sent_id, CASE WHEN failed THEN 'aside' ELSE kind END AS reason FROM parsed WHERE failed OR keep < {V.KEEP_AT}",
    "error_relay": f"WITH {answers()}, f AS (SELECT page_id, list(failed) AS f FROM parsed GROUP BY page_id) SELECT page_id, CASE WHEN NOT list_contains(f, true) THEN 'ok' WHEN list_contains(f, false) THEN 'partial' ELSE 'network' END AS status, CAST(len(list_filter(f, lambda x: x)) AS BIGINT) AS failed FROM f",
    "cache_admission": f"WITH {answers()} SELECT page_id, bool_or(sent_id = 0) AS full_page, count(*) FILTER (failed) AS failed, bool_or(sent_id = 0) AND NOT bool_or(failed) AS admitted FROM parsed GROUP BY page_id",
    "judgment_upsert": f"""WITH {JUDGED}, b AS (SELECT page_id, sent_id, {p("text || chr(28)")} AS keep, CAST(floor(keep * 1000) AS INT) % 3 = 0 AS failed FROM judged WHERE sent_id % 2 = 0),
      a AS (SELECT page_id, sent_id, keep, CAST(floor(keep * 1000) AS INT) % 5 = 0 AS failed FROM judged)
      SELECT page_id, sent_id, CASE WHEN b.failed = false THEN round(b.keep, 6) WHEN NOT a.failed THEN round(a.keep, 6) END AS keep, a.failed AND coalesce(b.failed, true) AS failed FROM a LEFT JOIN b USING (page_id, sent_id)""",
    "cache_lookup": "SELECT a.event_id AS tick, concat('h', a.user_id, a.event_type) AS hash, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id < a.event_id) AS cached, CASE WHEN EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id < a.event_id) THEN 0 ELSE 1 END AS requests FROM events a",
    "lru_stack_distance": f"""WITH a AS (SELECT x.event_id AS tick, x.user_id, x.event_type AS hash, (SELECT max(b.event_id) FROM events b WHERE b.user_id = x.user_id AND b.event_type = x.event_type AND b.event_id < x.event_id) AS prev FROM events x),
      d AS (SELECT a.tick, a.user_id, a.hash, a.prev, (SELECT count(DISTINCT b.event_type) FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.prev AND b.event_id < a.tick) AS n FROM a)
      SELECT tick, user_id, hash, CASE WHEN prev IS NOT NULL THEN n END AS between, prev IS NOT NULL AND n < {V.CACHE_PAGES} AS hit FROM d""",
    "unit_memo": f"SELECT lower(event_type) AS term, CASE WHEN {p('arg_max(event_type, event_id)')} >= {V.UNIT_AT} THEN 'sentence' ELSE 'words' END AS unit, max(event_id) AS seq FROM events GROUP BY lower(event_type) ORDER BY seq DESC LIMIT {V.UNIT_MEMO}",
    "latest_state": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "auc": f"WITH {LABELLED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 9) AS auc FROM l a, l b WHERE a.label = 1 AND b.label <> 1",
    "threshold_sweep": f"WITH {LABELLED}, s AS (SELECT CAST(k AS INT) AS k, round(count(*) FILTER ((score >= k * 0.05::DOUBLE) = (label = 1)) / count(*)::DOUBLE, 9) AS accuracy FROM l, (SELECT unnest(range(1, 20)) AS k) GROUP BY k) SELECT k, accuracy, (SELECT 1 + count(*) FROM s t WHERE t.accuracy > s.accuracy) AS place FROM s",
    "variant_flips": f"WITH {LINES}, v AS (SELECT page_id, sent_id, list_transform(['none', 'chunk', 'page'], lambda x: {p('concat(x, text)')} >= {V.KEEP_AT}) AS sides FROM lines) SELECT page_id, sent_id FROM v WHERE list_contains(sides, true) AND list_contains(sides, false)",
    "debounce_sessions": f"""WITH {USERS}, o AS (SELECT a.user_id, a.event_id, a.t, NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND (b.t, b.event_id) < (a.t, a.event_id) AND b.t > a.t - 3600000000) AS opens FROM e a),
      s AS (SELECT x.user_id, x.event_id, (SELECT count(*) FROM o y WHERE y.user_id = x.user_id AND y.opens AND (y.t, y.event_id) <= (x.t, x.event_id)) AS session FROM o x)
      SELECT user_id, session, count(*) AS changes, max(event_id) AS last_event FROM s GROUP BY user_id, session""",
    "rate_limited_batches": f"""WITH RECURSIVE {USERS}, sends(user_id, number, due) AS (
      SELECT user_id, 1::BIGINT, min(t) FROM e GROUP BY user_id
      UNION ALL SELECT s.user_id, s.number + 1, greatest((SELECT min(e.t) FROM e WHERE e.user_id = s.user_id AND e.t > s.due), s.due + {V.REQUEST_INTERVAL_MS * 1000}) FROM sends s WHERE s.number < {V.REQUEST_BUDGET} AND EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.t > s.due))
      SELECT s.user_id, s.number, s.due AS at_micros, (SELECT count(*) FROM e WHERE e.user_id = s.user_id AND e.t <= s.due AND e.t > coalesce((SELECT q.due FROM sends q WHERE q.user_id = s.user_id AND q.number = s.number - 1), -1)) AS pooled FROM sends s""",
    "context_window": "SELECT a.conv_id, a.turn, md5(coalesce((SELECT string_agg(b.text, ' ' ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn IN (SELECT c.turn FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn ORDER BY c.turn DESC LIMIT 5)), '')) AS context_md5 FROM conversations a",
    "pack_route": routed(),
    "page_scan": "SELECT page_id, url FROM pages WHERE starts_with(url, 'http:') OR starts_with(url, 'https:')",
    "private_path": f"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES (-1, 'https://shop.com/Cart/view.html'), (-2, 'https://shop.com/login.php?x=1'), (-3, 'https://shop.com/cartoon'), (-4, 'https://shop.com/Settings.aspx/billing/')) e(page_id, url))
      SELECT page_id, list_filter(list_transform(string_split(regexp_extract(lower(url), '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: regexp_replace(x, '[.](html?|php|aspx?|jsp)$', '')), lambda x: list_contains({listed(V.PRIVATE_SEGMENTS)}, x))[1] AS segment FROM u""",
    "rule_chunk_size": "SELECT user_id, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, count(*) AS rules, CASE WHEN count(*) < 3 THEN 30 WHEN count(*) > 60 THEN 1 ELSE 60 // count(*) END::BIGINT AS per_request FROM events GROUP BY ALL",
    "threshold_migration": "SELECT event_id AS id, coalesce(old.now, round(value) / 100)::DOUBLE AS threshold FROM events LEFT JOIN (VALUES (0, 50, 0.25), (1, 35, 0.25)) old(rest, percent, now) ON user_id % 3 = rest AND round(value) = percent",
    "validate_settings": "SELECT event_id AS id, CASE WHEN event_type = 'error' OR value IS NULL THEN 0.25 WHEN value < 10 THEN 0.1 WHEN value > 90 THEN 0.9 ELSE round(value / 100, 6) END::DOUBLE AS threshold, CASE WHEN event_type = 'signup' OR value IS NULL THEN 30 WHEN value < 9.5 THEN 10 WHEN value >= 119.5 THEN 120 ELSE floor(value + 0.5) END::INT AS chunk, CASE event_type WHEN 'click' THEN 'click' ELSE 'auto' END AS run_mode FROM events",
    "normalize_colour": """WITH h AS (SELECT event_id, event_type, md5(event_id::VARCHAR) AS h FROM events)
      SELECT event_id, CASE event_type WHEN 'view' THEN '#' || h[1:3] WHEN 'click' THEN '#' || upper(h[1:6]) WHEN 'error' THEN '#' || h[1:6] WHEN 'purchase' THEN '#' || h[1:5] ELSE event_type END AS c,
        CASE WHEN event_type IN ('click', 'error') THEN '#' || h[1:6] WHEN event_type = 'view' THEN '#' || repeat(h[1], 2) || repeat(h[2], 2) || repeat(h[3], 2) ELSE '#ffe066' END AS colour FROM h""",
    "lru_keep": f"SELECT concat('h', user_id, event_type) AS hash, max(event_id) AS last_tick FROM events GROUP BY user_id, event_type ORDER BY last_tick DESC LIMIT {V.CACHE_PAGES}",
    "usage_stats": "SELECT user_id, count(*) AS pages, coalesce(sum(round(value * 100)) FILTER (value > 0), 0)::BIGINT AS tokens, coalesce(sum(round(value * 10)) FILTER (value > 0), 0)::BIGINT AS ms, count(*) FILTER (event_type = 'view') AS hits FROM events GROUP BY user_id",
    "auc_by_group": f"WITH {LABELLED} SELECT g.lang, (SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 9) FROM l a, l b WHERE a.label = 1 AND b.label <> 1 AND a.lang = g.lang AND b.lang = g.lang) AS auc FROM (SELECT DISTINCT lang FROM l) g",
    "score_profile": f"WITH {LABELLED}, s AS (SELECT lang, label, list(score) AS s FROM l GROUP BY lang, label) SELECT lang, label, CAST(len(s) AS BIGINT) AS n, round(list_avg(s), 9) AS mean_score, list_min(s) AS least, list_max(s) AS most FROM s",
    "score_rollup": f"WITH {LABELLED} SELECT lang, label, count(*) AS n, round(avg(score), 9) AS mean_score FROM l GROUP BY lang, label UNION ALL SELECT lang, NULL, count(*), round(avg(score), 9) FROM l GROUP BY lang UNION ALL SELECT NULL, NULL, count(*), round(avg(score), 9) FROM l",
    "repeat_stability": f"WITH {JUDGED} SELECT page_id, max(abs(keep - {p('text || chr(27)')})) AS max_change FROM judged GROUP BY page_id",
}
