"""The reference operators as SQL plans over the driver's tables (FIXTURES.md tells which table stands in for what).

Each function gives the text of one plan in a dialect. Scores are the stub judge's, so every plan is deterministic.
Plans keep to equi-joins on page or sentence keys and to windows per page; the tables of rules, terms, packs and hosts
are literals of fixed size.
"""

from __future__ import annotations

from gleaner.plans import values as V


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rows(*items: tuple) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int | float) else quoted(x) for x in item) + ")" for item in items)


def qtext(d, x: str) -> str:
    return quoted(x).replace("''", "\\'") if d.name == "spark" else quoted(x)


RULES = rows((0, "prices"), (1, "dates"), (2, "people"))
TERMS = rows((0, "costs"), (1, "names"))


def judged(d) -> str:
    return f"SELECT page_id, sent_id, text, {d.p('text')} AS keep FROM ({d.lines()}) s"


def rule_scores(d) -> str:
    return f"SELECT s.page_id, s.sent_id, r.rule_order, r.rule, {d.p('concat(r.rule, chr(31), s.text)')} AS p FROM ({d.lines()}) s CROSS JOIN (VALUES {RULES}) AS r(rule_order, rule)"


def spans(d) -> str:
    """Up to one mark for a term in a sentence: where the sentence's first word is."""
    return f"SELECT s.page_id, s.sent_id, t.term_order, t.term, {d.p('concat(t.term, chr(30), s.text)')} AS p FROM ({d.lines()}) s CROSS JOIN (VALUES {TERMS}) AS t(term_order, term)"


def hosts(d) -> str:
    """Hosts of pages, and some that show each rule."""
    found = d.extract("url", "^https?://([^/?#:]+)", 1)
    extra = ["www.Example.com ", "mail.google.com", "a.github.com", "notgithub.com", "localhost", "printer", "nas.local", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.9", "169.254.3.4", "8.8.8.8", "intra.corp", "fd00::1", "router.home.arpa", "127.0.0.1", "x_y.com"]
    return f"SELECT {found} AS h FROM pages UNION ALL SELECT h FROM (VALUES {rows(*[(x,) for x in extra])}) AS e(h)"


def norm(d, h: str) -> str:
    return d.replace(f"lower(trim({h}))", "^www[.]", "")


def page_scan(d):
    return f"SELECT page_id, url FROM pages WHERE {d.matches('url', '^https?:')}"


def page_meta(d):
    title, lang, host = d.extract("html", "<title>([^<]*)</title>", 1), d.extract("html", '<html[^>]* lang="([^"]*)"', 1), d.extract("url", "^https?://([^/?#:]+)", 1)
    return f"SELECT page_id, trim({title}) AS title, {lang} AS lang, {norm(d, host)} AS host, length(html) AS html_chars FROM pages"


def host_normalize(d):
    return f"SELECT h, {norm(d, 'h')} AS host FROM ({hosts(d)}) x"


def denied(d) -> str:
    """Hosts with each of their suffixes, joined by equality with the list: no pairwise matching."""
    parts = d.split("host", ".")
    if d.name == "spark":
        suffix = "explode(transform(sequence(1, size(parts)), i -> array_join(slice(parts, i, size(parts)), '.'))) AS suffix"
    else:
        suffix = "unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))) AS suffix"
    return f"SELECT DISTINCT x.host FROM (SELECT host, {suffix} FROM (SELECT host, {parts} AS parts FROM (SELECT DISTINCT {norm(d, 'h')} AS host FROM ({hosts(d)}) a) b) c) x JOIN (VALUES {rows(*[(h,) for h in V.DENIED_HOSTS])}) AS l(rule) ON x.suffix = l.rule"


def host_deny(d):
    return f"SELECT host FROM ({denied(d)}) q"


def host_enabled(d):
    return f"SELECT k.host, CASE WHEN k.host = '' THEN false WHEN a.host IS NOT NULL THEN true ELSE q.host IS NULL END AS enabled FROM (SELECT DISTINCT {norm(d, 'h')} AS host FROM ({hosts(d)}) x) k LEFT JOIN ({denied(d)}) q ON k.host = q.host LEFT JOIN (VALUES {rows(('a.github.com',))}) AS a(host) ON k.host = a.host"


def host_parse(d):
    e = d.replace("lower(trim(h))", "^[a-z]+://", "")
    e = d.replace(d.replace(e, "^[*][.]", ""), "[/?#].*$", "")
    e = d.replace(d.replace(e, ":[0-9]+$", ""), "^www[.]", "")
    return f"SELECT DISTINCT {e} AS host FROM (SELECT url AS h FROM pages UNION ALL SELECT h FROM (VALUES {rows(('*.Example.org',), ('https://www.a.com:8080/x',), ('b.net/path',))}) AS e(h)) x WHERE {e} <> ''"


def private(d, h: str) -> str:
    checks = [f"{h} NOT LIKE '%.%' AND {h} NOT LIKE '%:%' AND {h} <> 'localhost' AND {h} <> ''", d.matches(h, "[.](local|internal|lan|intranet|corp|private|home[.]arpa)$"), d.matches(h, "^10([.][0-9]{1,3}){3}$"), d.matches(h, "^192[.]168([.][0-9]{1,3}){2}$"), d.matches(h, "^169[.]254([.][0-9]{1,3}){2}$"), d.matches(h, "^172[.](1[6-9]|2[0-9]|3[01])([.][0-9]{1,3}){2}$"), d.matches(h, "^(fc|fd|fe[89ab])[0-9a-f]*:")]
    return "(" + " OR ".join(f"({c})" for c in checks) + ")"


def private_host(d):
    return f"SELECT host, {private(d, 'host')} AS private FROM (SELECT DISTINCT {norm(d, 'h')} AS host FROM ({hosts(d)}) x) k"


def paths(d) -> str:
    return f"SELECT page_id, url, lower({d.extract('url', '^https?://[^/?#]+([^?#]*)', 1)}) AS path FROM (SELECT page_id, url FROM pages UNION ALL SELECT id, u FROM (VALUES {rows((-1, 'https://shop.com/Cart/view.html'), (-2, 'https://shop.com/login.php?x=1'), (-3, 'https://shop.com/cartoon'), (-4, 'https://shop.com/Settings.aspx/billing/'))}) AS e(id, u)) a"


def private_path(d):
    hit = d.unnest(d.split("path", "/"), f"({paths(d)}) p", "page_id", "segment")
    bare = d.replace("segment", "[.](html?|php|aspx?|jsp)$", "")
    named = f"SELECT page_id, segment, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM (SELECT page_id, pos, {bare} AS segment FROM ({hit}) q) n WHERE segment IN ({', '.join(quoted(x) for x in V.PRIVATE_SEGMENTS)})"
    return f"SELECT p.page_id, h.segment FROM ({paths(d)}) p LEFT JOIN ({named}) h ON p.page_id = h.page_id AND h.r = 1"


def privacy_level(d):
    host = norm(d, d.extract("url", "^https?://([^/?#:]+)", 1))
    return f"SELECT p.page_id, CASE WHEN {private(d, host)} OR q.segment IS NOT NULL THEN 'ask' END AS level, CASE WHEN {private(d, host)} THEN 'private-host' WHEN q.segment IS NOT NULL THEN 'private-path' END AS reason FROM ({paths(d)}) p JOIN ({private_path(d)}) q ON p.page_id = q.page_id"


def min_sentences(d):
    return f"SELECT page_id, count(*) AS sentences FROM ({d.lines()}) s GROUP BY page_id HAVING count(*) >= {V.MIN_SENTENCES}"


#: Lines (page_id, text) that show numbers which the tables don't have.
ACCOUNT_LINES = [
    (-1, "Pay to GB82 WEST 1234 5698 7654 32 today."), (-1, "Or to DE89370400440532013000, please."), (-1, "GB82 WEST 1234 5698 7654 33 is none."), (-1, "Her number is 123-45-6789."),
    (-2, "Part 000-45-6789 and 900-12-3456 are none, nor is 666-12-3456."), (-2, "RSSMRA85T10A562S is a tax code, XRSSMRA85T10A562S is none."), (-2, "Card 4111-1111-1111-1111."), (-2, "Card 4111 1111 1111 1112 is none."),
]


def account(d, text: str = "text") -> str:
    """Whether a text has a card or IBAN with the right check digits, an Italian tax code or a US social security number."""
    digits = d.found(text, "(?:^|[^0-9-])([2-6][0-9]{3}(?:[ -]?[0-9]{2,6}){2,4})(?:[^0-9-]|$)", 1)
    clean = d.replace("x", "[ -]", "")
    card = d.filter_len(digits, "x", f"length({clean}) >= 13 AND length({clean}) <= 19 AND {d.luhn(clean)}")
    space = d.literal(r"[ \x{A0}]")
    ibans = d.found(text, d.literal(r"(?:^|[^0-9A-Za-z_])([A-Z]{2}[0-9]{2}(?:[ \x{A0}]?[A-Z0-9]{4}){2,7}(?:[ \x{A0}]?[A-Z0-9]{1,4})?)(?:[^0-9A-Za-z_]|$)"), 1)
    compact = d.replace("x", space, "")
    iban = d.filter_len(ibans, "x", f"length({compact}) >= 15 AND length({compact}) <= 34 AND {d.mod97(f'concat(substr({compact}, 5), substr({compact}, 1, 4))')} = 1")
    code = d.matches(text, "(^|[^0-9A-Za-z_])[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]([^0-9A-Za-z_]|$)")
    area = "(00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])"
    ssn = d.matches(text, f"(^|[^0-9-]){area}-(0[1-9]|[1-9][0-9])-(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{{2}}|[1-9][0-9]{{3}})([^0-9-]|$)")
    return f"({card} > 0 OR {iban} > 0 OR {code} OR {ssn})"


def account_numbers(d):
    more = " UNION ALL ".join(f"SELECT {i}, {k}, {quoted(t)}" for k, (i, t) in enumerate(ACCOUNT_LINES))
    return f"SELECT page_id, sent_id FROM ({d.lines()} UNION ALL {more}) s WHERE {account(d)}"


def statement_pages(d):
    return f"SELECT page_id, count(*) AS withheld, count(*) >= {V.STATEMENT_NUMBERS} AS held FROM ({account_numbers(d)}) a GROUP BY page_id"


def lead_in_filter(d):
    lead = d.literal(r":(?:\[[^\[\]]{1,30}\])*$")
    return f"SELECT page_id, sent_id, length(text) AS chars FROM ({d.lines()}) s WHERE NOT {d.matches('text', lead)}"


#: All that counts as white space in text from the web.
SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


#: Footnote marks behind a character that is no space.
GLUED = r"(\S)(?:\[[^\[\]\n]{1,30}\])+"


def count_words(d, x: str) -> str:
    """Words; a character of a script without spaces is one, footnote marks glued to a word are none. Most texts need one pass only."""
    bare = f"CASE WHEN {d.contains(x, quoted('['))} THEN {d.replace(x, d.literal(GLUED), '$1 ')} ELSE {x} END"
    one = d.literal("[" + "".join(d.script(s) for s in ("Han", "Hiragana", "Katakana")) + "]")
    word = d.literal(r"[\p{L}\p{N}]+(?:[\x{27}’]\p{L}+)?")
    return f"CASE WHEN {d.matches(x, one)} THEN {d.count(bare, one)} + {d.count(d.replace(bare, one, ' '), word)} ELSE {d.count(bare, word)} END"


def word_count(d):
    extra = rows((-1, "The rise [1] of fads.[2][3] It’s d’accord"), (-2, "彼は昨日来た Tōkyō へ"), (-3, ""))
    return f"SELECT doc_id, {count_words(d, 'text')} AS words FROM (SELECT doc_id, text FROM documents UNION ALL SELECT id, t FROM (VALUES {extra}) AS e(id, t)) x"


def clean_text(d):
    extra = "SELECT -1 AS doc_id, ' a\u00a0\t\u202fb ' AS text"
    return f"SELECT doc_id, md5(trim({d.replace('text', d.literal(SPACE), ' ')})) AS clean_md5 FROM (SELECT doc_id, text FROM documents UNION ALL {extra}) x"


def page_sample(d):
    return f"SELECT page_id, substr({d.joined('text', chr(92) + 'n', 'sent_id')}, 1, 600) AS sample FROM ({d.lines()}) s GROUP BY page_id"


def pack_signals(d) -> str:
    out = [(order, name, kind, x) for order, (name, signals) in enumerate(V.PACKS) for kind, xs in signals.items() for x in xs]
    return "(VALUES " + ", ".join(f"({o}, {quoted(n)}, {quoted(k)}, {qtext(d, x)})" for o, n, k, x in out) + ") AS signals(pack_order, pack, kind, pattern)"


#: Pages (id, host, html) that show the signals which the tables' pages don't have: types of structured data, with a tie, and og:type.
SIGNAL_PAGES = [
    (-1, "a.org", '<script type="application/ld+json">{"@type": "Recipe"}</script>'),
    (-2, "b.org", '<script type="application/ld+json">{"@graph": [{"@type":"Product"}, {"@type" : "NewsArticle"}]}</script>'),
    (-3, "c.org", '<meta property="og:type" content="Article">'),
    (-4, "d.org", '<script type="application/ld+json">{"@type": "Organization"}</script>'),
]


def pack_hits(d) -> str:
    title, host = d.extract("html", "<title>([^<]*)</title>", 1), norm(d, d.extract("url", "^https?://([^/?#:]+)", 1))
    stripped = d.replace("html", "<[^>]*>", " ")
    path = d.extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    quote = d.literal(r'"@type"\s*:\s*"([^"]+)"')
    types = d.found("lower(html)", quote, 1)
    og = d.extract("lower(html)", '<meta property="og:type" content="([^"]*)"', 1)
    more = " UNION ALL ".join(f"SELECT {i}, 'https://{host}/', {quoted(html)}" for i, host, html in SIGNAL_PAGES)
    source = f"SELECT page_id, url, html FROM pages UNION ALL {more}"
    meta = f"SELECT page_id, {host} AS host, {types} AS types, {og} AS og, concat('/', {d.replace(f'lower({path})', '^/+|/+$', '')}, '/') AS path, lower(concat({title}, ' ', substr({stripped}, 1, 600))) AS hay FROM ({source}) p"
    host_hit = "(CASE WHEN pattern LIKE '%.' THEN starts_with(host, pattern) ELSE host = pattern OR ends_with(host, concat('.', pattern)) END)"
    if d.name == "spark":
        host_hit = host_hit.replace("starts_with", "startswith").replace("ends_with", "endswith")
    test = f"CASE kind WHEN 'path' THEN {d.contains('path', 'concat(concat(chr(47), pattern), chr(47))')} WHEN 'host' THEN {host_hit} WHEN 'cue' THEN {d.contains('hay', 'pattern')} WHEN 'jsonld' THEN {d.has('types', 'pattern')} ELSE og = pattern END"
    return f"SELECT page_id, pack_order, pack, kind, count(*) AS hits FROM (SELECT m.page_id, s.pack_order, s.pack, s.kind, {test} AS hit FROM ({meta}) m CROSS JOIN {pack_signals(d)[:-len('signals(pack_order, pack, kind, pattern)')]}s(pack_order, pack, kind, pattern)) h WHERE hit GROUP BY page_id, pack_order, pack, kind"


def pack_score(d):
    once = " ".join(f"WHEN '{kind}' THEN {V.WEIGHTS[kind]}" for kind in ("jsonld", "og", "path", "host"))
    total = f"sum(CASE kind {once} ELSE least({V.CUE_CAP}, hits * {V.WEIGHTS['cue']}) END)"
    return f"SELECT page_id, pack_order, pack, round(least(CAST(1 AS DOUBLE), CAST({total} AS DOUBLE)), 6) AS score FROM ({pack_hits(d)}) x GROUP BY page_id, pack_order, pack"


def pack_route(d):
    best = f"SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pack_order) AS r FROM ({pack_score(d)}) s"
    return f"SELECT p.page_id, CASE WHEN b.score >= {V.ROUTE_AT} THEN b.pack ELSE 'other' END AS page_kind, coalesce(b.score, CAST(0 AS DOUBLE)) AS score FROM (SELECT page_id FROM pages UNION ALL SELECT id FROM (VALUES {rows(*[(i,) for i, _, _ in SIGNAL_PAGES])}) AS m(id)) p LEFT JOIN ({best}) b ON p.page_id = b.page_id AND b.r = 1"


def chunks(d, size: str = str(V.PER_REQUEST)) -> str:
    """Contiguous chunks of nearly equal size, larger ones first."""
    div = d.hex_div()
    n = f"SELECT page_id, sent_id, text, row_number() OVER (PARTITION BY page_id ORDER BY sent_id) - 1 AS r, count(*) OVER (PARTITION BY page_id) AS n FROM ({d.lines()}) s"
    c = f"SELECT *, (n + {size} - 1) {div} {size} AS c FROM ({n}) a"
    be = f"SELECT *, n {div} c AS b, n % c AS e FROM ({c}) a"
    return f"SELECT page_id, sent_id, text, CAST(CASE WHEN r < e * (b + 1) THEN r {div} (b + 1) ELSE e + (r - e * (b + 1)) {div} b END AS BIGINT) AS chunk FROM ({be}) a"


def balanced_chunks(d):
    return f"SELECT page_id, chunk, count(*) AS sentences, min(sent_id) AS first_id, max(sent_id) AS last_id FROM ({chunks(d)}) c GROUP BY page_id, chunk"


def rule_chunk_size(d):
    """Each user's events of a day stand for that day's rules."""
    day = f"{d.micros('ts')} {d.hex_div()} 86400000000"
    return f"SELECT user_id, day, n AS rules, CAST(greatest(1, least({V.PER_REQUEST}, floor(2.0 * {V.PER_REQUEST} / n))) AS BIGINT) AS per_request FROM (SELECT user_id, day, count(*) AS n FROM (SELECT user_id, {day} AS day FROM events) e GROUP BY user_id, day) r"


def request_bodies(d):
    return f"SELECT page_id, chunk, md5({d.joined('text', ' ', 'sent_id')}) AS state_md5, 2 * count(*) + CASE WHEN chunk = 0 THEN 1 ELSE 0 END AS questions FROM ({chunks(d)}) c GROUP BY page_id, chunk"


def rule_questions(d):
    return f"SELECT page_id, chunk, count(*) AS questions FROM ({chunks(d, '20')}) c CROSS JOIN (VALUES {RULES}) AS r(rule_order, rule) GROUP BY page_id, chunk"


def answers(d) -> str:
    """Replies as the model might give them: some out of range, of an unknown kind, or missing."""
    j = f"SELECT page_id, sent_id, keep, CAST(floor(keep * 13) AS INT) AS k, CAST(floor(keep * 1000) AS INT) % 7 AS odd FROM ({judged(d)}) s"
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(V.KINDS))
    return f"SELECT page_id, sent_id, CASE odd WHEN 0 THEN NULL WHEN 1 THEN keep + 0.5 WHEN 2 THEN keep - 0.5 ELSE keep END AS noul, CASE k {kinds} ELSE 'unheard-of' END AS choice, CASE WHEN odd = 3 THEN NULL ELSE keep END AS confidence FROM ({j}) a"


def parse_answers(d):
    ok = f"noul IS NOT NULL AND choice IN ({', '.join(quoted(k) for k in V.KINDS)})"
    return f"SELECT page_id, sent_id, CASE WHEN {ok} THEN round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), noul)), 6) END AS keep, CASE WHEN {ok} THEN choice END AS kind, CASE WHEN {ok} THEN round(coalesce(confidence, CAST(0 AS DOUBLE)), 6) END AS kind_conf, NOT ({ok}) AS failed FROM ({answers(d)}) a"


def parse_rule_answers(d):
    given = f"SELECT *, CAST(floor(p * 1000) AS INT) % 4 AS odd FROM ({rule_scores(d)}) r"
    return f"SELECT page_id, sent_id, count(CASE WHEN odd <> 0 THEN 1 END) AS answered, count(CASE WHEN odd <> 0 THEN 1 END) = 0 AS failed FROM ({given}) g GROUP BY page_id, sent_id"


def gated(d) -> str:
    return f"SELECT * FROM ({spans(d)}) g WHERE p >= {V.MARK_AT}"


def highlight_cap(d):
    return f"SELECT page_id, term, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, term ORDER BY sent_id) AS r FROM ({gated(d)}) g) x WHERE r <= {V.SENTENCES_PER_TERM}"


def words(d) -> str:
    """The words asked about: with a sign of money or per cent, without punctuation behind, no function words."""
    found = d.unnest(d.found("text", d.literal(V.ASKED_WORD.replace("'", r"\x{27}"))), f"({d.lines()}) s", "page_id, sent_id", "raw")
    bare = d.replace("raw", d.literal(r"[.,\x{27}’-]+$"), "")
    return f"SELECT page_id, sent_id, pos, word FROM (SELECT page_id, sent_id, pos, {bare} AS word FROM ({found}) f) w WHERE (length(word) >= 2 OR {d.matches('word', d.literal(chr(94) + chr(92) + 'p{N}$'))}) AND lower(word) NOT IN ({', '.join(quoted(x) for x in V.STOP_WORDS)})"


def content_words(d):
    return f"SELECT page_id, count(*) AS words, count(DISTINCT lower(word)) AS different FROM ({words(d)}) w GROUP BY page_id"


def numbered_words(d) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY page_id, sent_id ORDER BY pos) - 1 AS BIGINT) AS word_no FROM ({words(d)}) w"


def batched(d) -> str:
    return f"SELECT *, word_no {d.hex_div()} {V.WORDS_PER_REQUEST} AS batch, {d.p('concat(word, CAST(word_no AS VARCHAR(20)), CAST(page_id AS VARCHAR(20)))')} AS p FROM ({numbered_words(d)}) n"


def word_batches(d):
    return f"SELECT page_id, sent_id, CAST(batch AS BIGINT) AS batch, count(*) AS words FROM ({batched(d)}) b GROUP BY page_id, sent_id, batch"


def best_words(d) -> str:
    best = f"SELECT *, max(p) OVER (PARTITION BY page_id, sent_id, batch) AS best FROM ({batched(d)}) b"
    return f"SELECT * FROM ({best}) x WHERE p >= {V.MARK_AT} OR (p >= {V.MARK_FLOOR} AND p >= {V.STANDOUT} * best)"


def pick_words(d):
    return f"SELECT page_id, sent_id, count(*) AS marked, min(word_no) AS first_word, max(word_no) AS last_word FROM ({best_words(d)}) w GROUP BY page_id, sent_id"


def clauses(d) -> str:
    found = d.unnest(d.split("text", ",;:"), f"({d.lines()}) s", "page_id, sent_id", "clause")
    return f"SELECT page_id, sent_id, pos, {d.p('clause')} AS p FROM ({found}) c"


def pick_clauses(d):
    best = f"SELECT *, max(p) OVER (PARTITION BY page_id, sent_id) AS best FROM ({clauses(d)}) c"
    chosen = f"SELECT *, pos - row_number() OVER (PARTITION BY page_id, sent_id ORDER BY pos) AS island FROM ({best}) b WHERE p >= {V.MARK_AT} OR p = best OR (p >= {V.MARK_FLOOR} AND p >= {V.STANDOUT} * best)"
    return f"SELECT page_id, sent_id, min(pos) AS first_clause, max(pos) AS last_clause FROM ({chosen}) c GROUP BY page_id, sent_id, island"


def stated_override(d):
    stated = f"SELECT page_id, sent_id, {d.p('concat(text, chr(29))')} AS stated FROM ({d.lines()}) s"
    marks = f"SELECT page_id, sent_id, count(*) AS n FROM ({best_words(d)}) w GROUP BY page_id, sent_id"
    return f"SELECT s.page_id, s.sent_id, CASE WHEN s.stated >= {V.STATED_AT} THEN 'clauses' ELSE 'words' END AS marks, CASE WHEN s.stated >= {V.STATED_AT} THEN 0 ELSE coalesce(m.n, 0) END AS words FROM ({stated}) s LEFT JOIN ({marks}) m ON s.page_id = m.page_id AND s.sent_id = m.sent_id"


def span_align(d):
    at = d.locate("wrapped", "text")
    return f"SELECT page_id, sent_id, CAST(greatest(0, 3 - ({at} - 1)) AS INT) AS span_start, CAST(greatest(0, least(length(wrapped), 12 - ({at} - 1))) AS INT) AS span_end FROM (SELECT page_id, sent_id, text, trim(substr(text, 3)) AS wrapped FROM ({d.lines()}) s) w WHERE wrapped <> ''"


def threshold_counts(d):
    return f"SELECT t.threshold, j.page_id, count(*) AS total, count(CASE WHEN j.keep >= t.threshold THEN 1 END) AS kept FROM ({judged(d)}) j CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS t(threshold) GROUP BY t.threshold, j.page_id"


def first_rule(d) -> str:
    return f"SELECT page_id, sent_id, min(rule_order) AS rule_order FROM ({rule_scores(d)}) r WHERE p >= {V.RULE_AT} GROUP BY page_id, sent_id"


def rule_keep(d):
    return f"SELECT j.page_id, j.sent_id, j.keep < {V.KEEP_AT} AND r.rule_order IS NULL AS faded, r.rule_order FROM ({judged(d)}) j LEFT JOIN ({first_rule(d)}) r ON j.page_id = r.page_id AND j.sent_id = r.sent_id"


def mark_keep(d):
    owner = f"SELECT page_id, sent_id, min(term_order) AS term_order FROM ({gated(d)}) g GROUP BY page_id, sent_id"
    return f"SELECT j.page_id, j.sent_id, j.keep < {V.KEEP_AT} AND o.term_order IS NULL AS faded, o.term_order FROM ({judged(d)}) j LEFT JOIN ({owner}) o ON j.page_id = o.page_id AND j.sent_id = o.sent_id"


def pin_override(d):
    pins = f"SELECT page_id, sent_id FROM ({judged(d)}) p WHERE sent_id % 5 = 0"
    return f"SELECT j.page_id, j.sent_id, j.keep >= {V.KEEP_AT} OR p.page_id IS NOT NULL AS kept, p.page_id IS NOT NULL AS pinned FROM ({judged(d)}) j LEFT JOIN ({pins}) p ON j.page_id = p.page_id AND j.sent_id = p.sent_id"


def page_counts(d):
    return f"SELECT page_id, count(*) AS total, count(CASE WHEN keep >= {V.KEEP_AT} THEN 1 END) AS kept, count(CASE WHEN keep < {V.KEEP_AT} THEN 1 END) AS faded FROM ({parse_answers(d)}) a WHERE NOT failed GROUP BY page_id"


def badge(d):
    return f"SELECT d.doc_id AS page_id, CASE WHEN c.total IS NULL THEN '!' ELSE CAST(c.kept AS VARCHAR(20)) END AS badge, CASE WHEN c.total IS NULL THEN 'nothing judged' ELSE concat(concat(concat(CAST(c.kept AS VARCHAR(20)), ' of '), CAST(c.total AS VARCHAR(20))), ' kept') END AS status_line FROM documents d LEFT JOIN ({page_counts(d)}) c ON d.doc_id = c.page_id"


def rule_hits(d):
    return f"SELECT p.page_id, r.rule, count(s.sent_id) AS hits FROM (SELECT doc_id AS page_id FROM documents) p CROSS JOIN (VALUES {RULES}) AS r(rule_order, rule) LEFT JOIN (SELECT * FROM ({rule_scores(d)}) x WHERE p >= {V.RULE_AT}) s ON s.page_id = p.page_id AND s.rule = r.rule GROUP BY p.page_id, r.rule"


def mark_hits(d):
    return f"SELECT p.page_id, t.term, count(g.sent_id) AS spans, count(DISTINCT g.sent_id) AS sentences FROM (SELECT doc_id AS page_id FROM documents) p CROSS JOIN (VALUES {TERMS}) AS t(term_order, term) LEFT JOIN ({gated(d)}) g ON g.page_id = p.page_id AND g.term = t.term GROUP BY p.page_id, t.term"


def judgment_upsert(d):
    log = f"SELECT page_id, sent_id, 1 AS seq, keep, CAST(floor(keep * 1000) AS INT) % 5 = 0 AS failed FROM ({judged(d)}) a UNION ALL SELECT page_id, sent_id, 2, {d.p('concat(text, chr(28))')}, CAST(floor(keep * 1000) AS INT) % 3 = 0 FROM ({judged(d)}) b WHERE sent_id % 2 = 0"
    best = f"SELECT *, row_number() OVER (PARTITION BY page_id, sent_id ORDER BY CASE WHEN failed THEN 1 ELSE 0 END, seq DESC) AS r FROM ({log}) l"
    return f"SELECT page_id, sent_id, CASE WHEN failed THEN NULL ELSE round(keep, 6) END AS keep, failed FROM ({best}) b WHERE r = 1"


def accesses(d) -> str:
    """Accesses to cached pages in logical time; the host of the event stands for the content hash."""
    return "SELECT event_id AS tick, concat(concat('h', CAST(user_id AS VARCHAR(20))), event_type) AS hash FROM events"


def cache_lookup(d):
    put = f"SELECT hash, min(tick) AS stored FROM ({accesses(d)}) a GROUP BY hash"
    return f"SELECT a.tick, a.hash, a.tick > p.stored AS cached, CASE WHEN a.tick > p.stored THEN 0 ELSE 1 END AS requests FROM ({accesses(d)}) a JOIN ({put}) p ON a.hash = p.hash"


def lru_keep(d):
    return f"SELECT hash, last_tick FROM (SELECT hash, max(tick) AS last_tick FROM ({accesses(d)}) a GROUP BY hash) x ORDER BY last_tick DESC LIMIT {V.CACHE_PAGES}"


def lru_stack_distance(d):
    """How many other pages of a user came between two visits of a page: an LRU cache of more pages has it still.

    Each access is held against the last visit of each page of its user, so the work is accesses times pages of a user.
    """
    a = "SELECT event_id AS tick, user_id, event_type AS hash FROM events"
    last = f"SELECT a.tick, a.user_id, a.hash, k.hash AS other, max(CASE WHEN a.hash = k.hash THEN a.tick END) OVER (PARTITION BY a.user_id, k.hash ORDER BY a.tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({a}) a JOIN (SELECT DISTINCT user_id, hash FROM ({a}) b) k ON a.user_id = k.user_id"
    own = f"SELECT *, max(CASE WHEN hash = other THEN seen END) OVER (PARTITION BY tick) AS before FROM ({last}) l"
    return f"SELECT tick, user_id, hash, CASE WHEN max(before) IS NOT NULL THEN count(CASE WHEN other <> hash AND seen > before THEN 1 END) END AS between, coalesce(CASE WHEN max(before) IS NOT NULL THEN count(CASE WHEN other <> hash AND seen > before THEN 1 END) END < {V.CACHE_PAGES}, false) AS hit FROM ({own}) o GROUP BY tick, user_id, hash"


def versioned_merge(d):
    log = f"SELECT page_id, term, sent_id, CAST(floor(p * 100) AS INT) % 3 + 3 AS version, p FROM ({gated(d)}) g"
    return f"SELECT page_id, term, count(*) AS spans FROM ({log}) l WHERE version = 5 GROUP BY page_id, term"


def missing_rules(d):
    known = f"SELECT DISTINCT page_id, rule FROM ({rule_scores(d)}) r WHERE p >= 0.8"
    return f"SELECT p.page_id, r.rule FROM (SELECT doc_id AS page_id FROM documents) p CROSS JOIN (VALUES {RULES}) AS r(rule_order, rule) LEFT JOIN ({known}) k ON k.page_id = p.page_id AND k.rule = r.rule WHERE k.rule IS NULL"


def cache_admission(d):
    return f"SELECT page_id, min(sent_id) = 0 AS full_page, count(CASE WHEN failed THEN 1 END) AS failed, min(sent_id) = 0 AND count(CASE WHEN failed THEN 1 END) = 0 AS admitted FROM ({parse_answers(d)}) a GROUP BY page_id"


def unit_memo(d):
    log = f"SELECT lower(event_type) AS term, event_id AS seq, CASE WHEN {d.p('event_type')} >= {V.UNIT_AT} THEN 'sentence' ELSE 'words' END AS unit FROM events"
    return f"SELECT term, unit, seq FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY seq DESC) AS r FROM ({log}) l) x WHERE r = 1 ORDER BY seq DESC LIMIT {V.UNIT_MEMO}"


def usage(d) -> str:
    return "SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS tokens, CAST(round(value * 10) AS BIGINT) AS ms, event_type = 'view' AS cached FROM events"


def usage_stats(d):
    return f"SELECT user_id, count(*) AS pages, CAST(sum(greatest(0, tokens)) AS BIGINT) AS tokens, CAST(sum(greatest(0, ms)) AS BIGINT) AS ms, count(CASE WHEN cached THEN 1 END) AS hits FROM ({usage(d)}) u GROUP BY user_id"


def usage_cost(d):
    return f"SELECT user_id, round(tokens * CAST({V.PRICE:.12f} AS DOUBLE), 9) AS usd, CASE WHEN pages = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(ms AS DOUBLE) / pages, 6) END AS avg_ms FROM ({usage_stats(d)}) s"


def normalize(d, x: str) -> str:
    return f"trim(substr(trim({d.replace(x, d.literal(SPACE), ' ')}), 1, {V.RULE_CHARS}))"


def normalize_rule(d):
    return f"SELECT page_id, sent_id, {normalize(d, 'text')} AS rule FROM ({d.lines()}) s"


def distinct_first_spelling(d):
    r = f"SELECT page_id, sent_id, {normalize(d, 'text')} AS rule FROM ({d.lines()}) s"
    first = f"SELECT *, row_number() OVER (PARTITION BY page_id, lower(rule) ORDER BY sent_id) AS r FROM ({r}) x WHERE rule <> ''"
    return f"SELECT page_id, sent_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sent_id) AS k FROM ({first}) f WHERE r = 1) y WHERE k <= 8"


def validate_settings(d):
    """Each event stands for one stored setting: its value is the threshold in percent and the chunk, its type the mode; some lack one of them."""
    stored = "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS t, CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS c, event_type AS m FROM events"
    return f"SELECT id, CASE WHEN t IS NULL THEN CAST(0.25 AS DOUBLE) ELSE round(greatest(CAST(0.1 AS DOUBLE), least(CAST(0.9 AS DOUBLE), CAST(t AS DOUBLE))), 6) END AS threshold, CASE WHEN c IS NULL THEN 30 ELSE CAST(greatest(10, least(120, round(c))) AS INT) END AS chunk, CASE WHEN m IN ('auto', 'click') THEN m ELSE 'auto' END AS run_mode FROM ({stored}) s"


def threshold_migration(d):
    """Each event stands for one stored threshold (its value in whole percent), and its user for the revision that stored it."""
    stored = "SELECT event_id AS id, user_id % 3 + 1 AS rev, round(value) / 100 AS t FROM events"
    return f"SELECT id, CASE WHEN (rev = 1 AND t = CAST(0.5 AS DOUBLE)) OR (rev = 2 AND t = CAST(0.35 AS DOUBLE)) THEN CAST(0.25 AS DOUBLE) ELSE CAST(t AS DOUBLE) END AS threshold FROM ({stored}) s"


def labelled(d) -> str:
    return f"SELECT l.doc_id, d.lang, l.quality AS label, {d.p('d.text')} AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


#: Ranges of scores that are ranked apart.
SCORE_CELLS = 1024


def auc_of(d, group: str) -> str:
    """Wins of positives over negatives: equal scores are one row, ranks are taken inside a range of scores, and the ranges, at most 1025 a group, are summed up apart."""
    own = group or "CAST(0 AS INT)"
    ties = f"SELECT own, cell, score, count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS pos FROM (SELECT {own} AS own, CAST(floor(score * {SCORE_CELLS}) AS INT) AS cell, score, label FROM ({labelled(d)}) l) c GROUP BY own, cell, score"
    inside = f"SELECT own, cell, pos, n - pos AS neg, coalesce(sum(n - pos) OVER (PARTITION BY own, cell ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({ties}) t"
    cells = f"SELECT own, cell, sum(pos) AS pos, sum(neg) AS neg, sum(pos * (below + neg * 0.5)) AS wins FROM ({inside}) i GROUP BY own, cell"
    under = f"SELECT own, pos, neg, wins + pos * coalesce(sum(neg) OVER (PARTITION BY own ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM ({cells}) c"
    out = f"own AS {group}, " if group else ""
    return f"SELECT {out}round(CAST(sum(wins) AS DOUBLE) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0), 9) AS auc FROM ({under}) b" + (" GROUP BY own" if group else "")


def auc(d):
    return auc_of(d, "")


def auc_by_group(d):
    return auc_of(d, "lang")


def sweep(d) -> str:
    t = "explode(sequence(1, 19)) AS k" if d.name == "spark" else "unnest(range(1, 20)) AS k"
    return f"SELECT CAST(t.k AS INT) AS k, avg(CASE WHEN (l.score >= t.k * CAST(0.05 AS DOUBLE)) = (l.label = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy FROM ({labelled(d)}) l CROSS JOIN (SELECT {t}) t GROUP BY t.k"


def threshold_sweep(d):
    return f"SELECT k, round(accuracy, 9) AS accuracy, rank() OVER (ORDER BY round(accuracy, 9) DESC) AS place FROM ({sweep(d)}) s"


def score_profile(d):
    return f"SELECT lang, label, count(*) AS n, round(avg(score), 9) AS mean_score, min(score) AS least, max(score) AS most FROM ({labelled(d)}) l GROUP BY lang, label"


def score_rollup(d):
    return f"SELECT lang, label, count(*) AS n, round(avg(score), 9) AS mean_score FROM ({labelled(d)}) l GROUP BY ROLLUP (lang, label)"


def repeat_stability(d):
    again = f"SELECT page_id, sent_id, {d.p('concat(text, chr(27))')} AS keep FROM ({d.lines()}) s"
    return f"SELECT a.page_id, max(abs(a.keep - b.keep)) AS max_change FROM ({judged(d)}) a JOIN ({again}) b ON a.page_id = b.page_id AND a.sent_id = b.sent_id GROUP BY a.page_id"


def variants(d) -> str:
    return f"SELECT page_id, sent_id, v.variant, {d.p('concat(v.variant, text)')} AS keep FROM ({d.lines()}) s CROSS JOIN (VALUES ('none'), ('chunk'), ('page')) AS v(variant)"


def variant_drift(d):
    base = f"SELECT page_id, sent_id, keep AS base FROM ({variants(d)}) b WHERE variant = 'none'"
    t = V.KEEP_AT
    return f"SELECT v.variant, count(CASE WHEN v.keep < {t} THEN 1 END) AS grey, count(CASE WHEN v.keep < {t} AND b.base >= {t} THEN 1 END) AS to_grey, count(CASE WHEN v.keep >= {t} AND b.base < {t} THEN 1 END) AS to_kept, round(avg(abs(v.keep - b.base)), 6) AS drift, count(CASE WHEN v.keep BETWEEN 0.2 AND 0.8 THEN 1 END) AS unsure FROM ({variants(d)}) v JOIN ({base}) b ON v.page_id = b.page_id AND v.sent_id = b.sent_id GROUP BY v.variant"


def variant_flips(d):
    return f"SELECT page_id, sent_id FROM ({variants(d)}) v GROUP BY page_id, sent_id HAVING min(keep) < {V.KEEP_AT} AND max(keep) >= {V.KEEP_AT}"


def context_window(d):
    before = [f"lag(text, {i}) OVER (PARTITION BY conv_id ORDER BY turn)" for i in range(5, 0, -1)]
    return f"SELECT conv_id, turn, md5(concat_ws(' ', {', '.join(before)})) AS context_md5 FROM conversations"


def state_variants(d):
    """The state of each chunk under five of the variants: no text, the chunk shifted by half, five sentences before it, the chunk, the page."""
    by = f"SELECT page_id, chunk, min(sent_id) AS first_id, {d.joined('text', ' ', 'sent_id')} AS text FROM ({chunks(d)}) c GROUP BY page_id, chunk"
    page = f"SELECT page_id, substr({d.joined('text', ' ', 'sent_id')}, 1, 80000) AS text FROM ({d.lines()}) s GROUP BY page_id"
    numbered = f"SELECT page_id, sent_id, text, row_number() OVER (PARTITION BY page_id ORDER BY sent_id) - 1 AS r FROM ({d.lines()}) s"
    shifted = f"SELECT page_id, (r + {V.PER_REQUEST // 2}) {d.hex_div()} {V.PER_REQUEST} AS chunk, {d.joined('text', ' ', 'sent_id')} AS text FROM ({numbered}) n GROUP BY page_id, (r + {V.PER_REQUEST // 2}) {d.hex_div()} {V.PER_REQUEST}"
    before = ", ".join(f"lag(text, {i}) OVER (PARTITION BY page_id ORDER BY sent_id)" for i in range(5, 0, -1))
    five = f"SELECT page_id, sent_id, concat_ws(' ', {before}) AS before FROM ({d.lines()}) s"
    parts = [
        f"SELECT page_id, chunk, 'none' AS variant, '' AS state FROM ({by}) a",
        f"SELECT page_id, CAST(chunk AS BIGINT) AS chunk, 'shift' AS variant, text AS state FROM ({shifted}) b",
        f"SELECT c.page_id, c.chunk, 'window' AS variant, concat_ws(' | ', f.before, c.text) AS state FROM ({by}) c JOIN ({five}) f ON c.page_id = f.page_id AND c.first_id = f.sent_id",
        f"SELECT page_id, chunk, 'chunk' AS variant, text AS state FROM ({by}) e",
        f"SELECT c.page_id, c.chunk, 'page' AS variant, p.text AS state FROM ({by}) c JOIN ({page}) p ON c.page_id = p.page_id",
    ]
    return f"SELECT page_id, chunk, variant, length(state) AS chars, md5(state) AS state_md5 FROM ({' UNION ALL '.join(parts)}) v"


def review_buckets(d):
    """The first few of each bucket; the bound on the place lets every task keep no more of a bucket than that before the shuffle."""
    soft = f"SELECT page_id, sent_id, keep, kind FROM ({parse_answers(d)}) a WHERE NOT failed"
    named = f"SELECT *, CASE WHEN keep < {V.KEEP_AT} THEN 'faded' WHEN kind IN ('story', 'opinion', 'promo') THEN 'soft' WHEN keep < 0.75 THEN 'borderline' ELSE 'kept' END AS bucket FROM ({soft}) s"
    return f"SELECT bucket, page_id, sent_id, keep FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY keep, page_id, sent_id) AS r FROM ({named}) n) x WHERE r <= 45 AND (bucket = 'faded' OR bucket IN ('soft', 'borderline') AND r <= 25)"


def debounce_sessions(d):
    gap = d.seconds("ts", "lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    opened = f"SELECT user_id, event_id, ts, CASE WHEN {gap} < 3600 THEN 0 ELSE 1 END AS opens FROM events"
    numbered = f"SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM ({opened}) o"
    return f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS changes, max(event_id) AS last_event FROM ({numbered}) n GROUP BY user_id, session"


def rate_limited_batches(d):
    """Requests of a user at least five seconds apart: what comes earlier waits and goes out together, beyond the budget it is dropped.

    One pass over each user's times in order; a request is known by when it goes out, which later arrivals do not change.
    """
    wait, budget = V.REQUEST_INTERVAL_MS * 1000, V.REQUEST_BUDGET
    times = f"SELECT user_id, array_sort(collect_list({d.micros('ts')})) AS times FROM events GROUP BY user_id"
    start = "CAST(array() AS ARRAY<STRUCT<at: BIGINT, pooled: BIGINT>>)"
    last = "element_at(sends, -1)"
    joined = f"concat(slice(sends, 1, size(sends) - 1), array(named_struct('at', {last}.at, 'pooled', {last}.pooled + 1)))"
    opened = f"concat(sends, array(named_struct('at', CASE WHEN size(sends) = 0 THEN t ELSE greatest(t, {last}.at + {wait}) END, 'pooled', 1L)))"
    step = f"CASE WHEN size(sends) > 0 AND t <= {last}.at THEN {joined} WHEN size(sends) < {budget} THEN {opened} ELSE sends END"
    return f"SELECT user_id, CAST(pos + 1 AS BIGINT) AS number, send.at AS at_micros, send.pooled AS pooled FROM (SELECT user_id, posexplode(aggregate(times, {start}, (sends, t) -> {step})) AS (pos, send) FROM ({times}) e) x"


def latest_state(d):
    return "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1"


def reason_word(d):
    return f"SELECT page_id, sent_id, coalesce(kind, 'aside') AS reason FROM ({parse_answers(d)}) a WHERE failed OR keep < {V.KEEP_AT}"


def error_relay(d):
    return f"SELECT page_id, CASE WHEN count(CASE WHEN failed THEN 1 END) = count(*) THEN 'network' WHEN count(CASE WHEN failed THEN 1 END) > 0 THEN 'partial' ELSE 'ok' END AS status, count(CASE WHEN failed THEN 1 END) AS failed FROM ({parse_answers(d)}) a GROUP BY page_id"


def normalize_colour(d):
    """Each event has the colour that a hash of its id gives, spelled by its type: three or six digits, five by mistake, or a word."""
    digits = "md5(CAST(event_id AS STRING))"
    spelled = f"CASE event_type WHEN 'view' THEN concat('#', substr({digits}, 1, 3)) WHEN 'click' THEN concat('#', upper(substr({digits}, 1, 6))) WHEN 'error' THEN concat('#', substr({digits}, 1, 6)) WHEN 'purchase' THEN concat('#', substr({digits}, 1, 5)) ELSE event_type END"
    return f"SELECT event_id, c, CASE WHEN {d.matches('c', '^#[0-9a-fA-F]{6}$')} THEN lower(c) WHEN {d.matches('c', '^#[0-9a-fA-F]{3}$')} THEN lower({d.replace('c', '^#(.)(.)(.)$', '#$1$1$2$2$3$3')}) ELSE '#ffe066' END AS colour FROM (SELECT event_id, {spelled} AS c FROM events) x"


PLANS = {f.__name__: f for f in (page_scan, page_meta, host_normalize, host_deny, host_enabled, host_parse, private_host, private_path, privacy_level, min_sentences, account_numbers, statement_pages, lead_in_filter, word_count, clean_text, page_sample, pack_score, pack_route, balanced_chunks, rule_chunk_size, request_bodies, rule_questions, parse_answers, parse_rule_answers, highlight_cap, content_words, word_batches, pick_words, pick_clauses, stated_override, span_align, threshold_counts, rule_keep, mark_keep, pin_override, page_counts, badge, rule_hits, mark_hits, judgment_upsert, cache_lookup, lru_keep, lru_stack_distance, versioned_merge, missing_rules, cache_admission, unit_memo, usage_stats, usage_cost, normalize_rule, distinct_first_spelling, validate_settings, threshold_migration, auc, auc_by_group, threshold_sweep, score_profile, score_rollup, repeat_stability, variant_drift, variant_flips, context_window, state_variants, review_buckets, debounce_sessions, rate_limited_batches, latest_state, reason_word, error_relay, normalize_colour)}
