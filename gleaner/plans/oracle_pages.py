"""The check's own SQL for sentences and pages, for DuckDB: rows and windows where the plans use arrays, and the other way round."""

from __future__ import annotations

from gleaner.functions.columns import SPACE, SPACES, any_of
from gleaner.plans import values as V
from gleaner.plans.dialect import Duck
from gleaner.plans.sql import account

CUT, TAIL = "chr(64976)", "chr(64977)"
CHARS = "concat(" + ", ".join(f"chr({ord(c)})" for c in SPACES) + ")"
INLINE = SPACE.replace(r"\n", "").replace(r"\r", "")
MARKS, FLUSH, CLOSERS, OPENERS = (any_of(x) for x in (V.SENTENCE_MARKS, V.FLUSH_MARKS, V.CLOSERS, V.OPENERS))
NOTES = r"(?:\[[^\[\]\n\r]{1,30}\])*"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    """Words: a character of a script without spaces is one, footnote marks behind a character are none."""
    bare = f"regexp_replace({x}, {q(rf'([^{SPACE}])(?:\[[^\[\]\n]{{1,30}}\])+')}, {q(chr(92) + '1 ')}, 'g')"
    one = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
    return f"len(regexp_extract_all({bare}, {q(one)})) + len(regexp_extract_all(regexp_replace({bare}, {q(one)}, ' ', 'g'), {q(r'[\p{L}\p{N}]+(?:[' + chr(39) + r'’]\p{L}+)?')}))"


def abbreviated(token: str) -> str:
    any_case = sorted({a.lower() for a in V.ABBREVIATIONS if a not in V.ABBREVIATIONS_AS_WRITTEN})
    return f"({token} IN ({', '.join(map(q, V.ABBREVIATIONS))}) OR lower({token}) IN ({', '.join(map(q, any_case))}))"


def sentences(source: str, key: str, name: str = "s") -> str:
    """CTEs that end in ``name`` (key, k, raw): the sentences of ``source`` (key, text), by rows of pieces; raw keeps the white space around them.

    An opener is taken along, as this engine's expressions can't look ahead, and given back.
    """
    place = rf"({MARKS}*{FLUSH}{CLOSERS}*{NOTES}[{INLINE}]*|{MARKS}+{CLOSERS}*{NOTES}[{INLINE}]+)([\p{{L}}\p{{N}}]|{OPENERS})"
    ends = rf"[.!?…。！？][\"'”’»)\]]*{NOTES}[{SPACE}]*$"
    n = name
    digits = "regexp_extract(before, '(?:^|[^0-9])([0-9]{1,2})$', 1)"
    rest = "before[:len(before) - len(digits)]"
    return f"""
{n}1 AS (SELECT {key}, trim(coalesce(text, ''), {CHARS}) AS x FROM {source}),
{n}2 AS (SELECT {key}, string_split(regexp_replace(regexp_replace(x, {q(place)}, {TAIL} || '\\1' || {CUT} || '\\2', 'g'), '([\\n\\r]+)', '\\1' || {CUT}, 'g'), {CUT}) AS parts FROM {n}1 WHERE x <> ''),
{n}3 AS (SELECT {key}, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM {n}2),
{n}4 AS (SELECT *, string_split(part, {TAIL})[1] AS before, string_split(part, {TAIL})[-1] AS tail, lag(part) OVER w AS previous, lead(part) OVER w AS next FROM {n}3 WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{n}5 AS (SELECT *, regexp_extract(right(before, 24), '([\\p{{L}}\\p{{N}}.]+)$', 1) AS token, {digits} AS digits, regexp_extract(tail, {q(f'^({MARKS}+)')}, 1) AS marks, regexp_matches(tail, {q(f'^{MARKS}+{CLOSERS}*' + r'\[')}) AS noted FROM {n}4),
{n}6 AS (SELECT *, {rest} AS rest, rtrim({rest}, {CHARS}) AS bare FROM {n}5),
{n}7 AS (SELECT *, digits <> '' AND CASE WHEN bare = '' THEN previous IS NULL OR regexp_matches(previous, '[\\n\\r]$') OR regexp_matches(string_split(previous, {TAIL})[-1], '[.!?…][{SPACE}]+$')
  ELSE contains({q(V.BEFORE_ENUMERATOR)}, right(bare, 1)) AND (bare <> rest OR right(bare, 1) <> '.') END AS numbered, regexp_matches(right(before, 2), '^[^\\p{{L}}\\p{{N}}]?\\p{{L}}$') AS initial FROM {n}6),
{n}8 AS (SELECT {key}, i, replace(part, {TAIL}, '') AS part, next IS NOT NULL AND (regexp_matches(part, '[\\n\\r]$') OR NOT (regexp_matches(next[1], '^[\\p{{Ll}}\\p{{Lt}}]') AND lower(next[1]) <> upper(next[1])
  OR marks = '.' AND token <> '' AND ({abbreviated('token')} OR {abbreviated("string_split(token, '.')[-1]")} OR NOT noted AND (initial OR numbered)))) AS ends FROM {n}7),
{n}9 AS (SELECT {key}, g, string_agg(part, '' ORDER BY i) AS line FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {n}8) GROUP BY {key}, g),
{n}a AS (SELECT *, {words('line')} AS n FROM {n}9),
{n}b AS (SELECT *, lead(g) OVER w IS NULL AND n <= {V.TAIL_WORDS} AND NOT regexp_matches(line, {q(ends)}) AND count(*) FILTER (n >= {V.MIN_WORDS}) OVER (PARTITION BY {key} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS dropped,
  greatest(1, count(*) FILTER (n >= {V.MIN_WORDS}) OVER w) AS k FROM {n}a WINDOW w AS (PARTITION BY {key} ORDER BY g)),
{name} AS (SELECT {key}, k - 1 AS k, string_agg(line, '' ORDER BY g) AS raw FROM {n}b WHERE NOT dropped GROUP BY {key}, k)"""


def document_sentences() -> str:
    """Rows of documents are told apart by a number, as ids may be shared."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),{sentences('d', 'rn')}
SELECT d.doc_id, CAST(s.k AS INT) AS sent_id, trim(s.raw, {CHARS}) AS sentence FROM s JOIN d USING (rn)"""


def ties(dropped: str) -> str:
    """CTEs from ``keyed`` (id, text) and its sentences ``s`` to ``told``, sentences by place, and ``run``, stretches of them that quotations tie.

    Marks are walked one by one with the list of open ones; neighbours that one quotation touches are tied, runs of ties are stretches.
    """
    return f"""
placed AS (SELECT id, k, trim(raw, {CHARS}) AS x, len(regexp_extract(raw, '^[{SPACE}]*')) + coalesce(sum(len(raw)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + any_value(len(regexp_extract(t.text, '^[{SPACE}]*'))) OVER (PARTITION BY id) AS a FROM s JOIN keyed t USING (id)),
told AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i, x, a, a + len(x) AS b FROM placed WHERE NOT regexp_matches(x, {q(dropped)})),
marks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS m, pos, text[pos + 1] AS mark FROM (SELECT id, text, unnest(list_filter(range(len(text)), lambda i: contains('"“”„«»', text[i + 1]))) AS pos FROM keyed)),
walk AS (SELECT id, 0::BIGINT AS m, []::BIGINT[] AS open, NULL::BIGINT AS a, NULL::BIGINT AS b FROM (SELECT DISTINCT id FROM marks)
  UNION ALL SELECT w.id, m.m, CASE WHEN m.mark IN ('“', '„', '«') OR m.mark = '"' AND len(w.open) = 0 THEN list_append(w.open, m.pos) ELSE w.open[:-2] END,
    CASE WHEN (m.mark IN ('”', '»') OR m.mark = '"') AND len(w.open) > 0 THEN w.open[-1] END, CASE WHEN (m.mark IN ('”', '»') OR m.mark = '"') AND len(w.open) > 0 THEN m.pos + 1 END FROM walk w JOIN marks m ON m.id = w.id AND m.m = w.m + 1),
tie AS (SELECT DISTINCT w.id, t.i FROM walk w JOIN told t ON w.id = t.id AND t.b > w.a AND t.a < w.b JOIN told u ON u.id = t.id AND u.i = t.i + 1 AND u.b > w.a AND u.a < w.b WHERE w.a IS NOT NULL),
run AS (SELECT id, min(i) AS first, max(i) + 1 AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM tie) GROUP BY id, g)"""


def page_rows() -> str:
    """CTEs that end in ``found``: the sentences of pages as these tables have them, by plain definitions on their markup.

    Prose stands in the paragraphs of an article, or, where an article has none, in a box that holds a good part of the page's
    text; paragraphs end where the next tag of a block stands, bold runs to the end of its paragraph.
    """
    decode = "x"
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        decode = f"regexp_replace({decode}, '&{entity};?', '{char}', 'g')"
    ends = rf"[.!?…。！？][\"'”’»)\]]*{NOTES}[{SPACE}]*$"
    question = r"^[^.!]*\?[\"'”’»)\]]*" + f"[{SPACE}]*$"
    caption = r"(?i)^\s*(fig(ure|ura)?s?|tab(le|ella)?s?|scheme|box|chart|equation|eq)\.?\s*\d+"
    strip = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style|title|h1)>.*?(</(?:script|style|title|h1)>|$)', '', 'g'), '<[A-Za-z/!][^>]*$', '')"
    dense = lambda x: f"len(regexp_replace({x}, '[{SPACE}]+', '', 'g'))"
    bare = lambda x: f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return f"""
html AS (SELECT row_number() OVER () AS rn, page_id, {strip} AS x FROM pages WHERE starts_with(url, 'http:') OR starts_with(url, 'https:')),
cut AS (SELECT rn, page_id, x, CASE WHEN contains(x, '<article>') THEN string_split(string_split(x, '<article>')[2], '</article>')[1] ELSE '' END AS article, regexp_extract(x, '(?s)<div class="ad">(.*?)(?:</div>|<article>|$)', 1) AS box FROM html),
part AS (SELECT rn, page_id, unnest(string_split(regexp_replace(article, '</p>|</?(?:div|footer)[^>]*>', '<p>', 'g'), '<p>')) AS x, unnest(range(1000000)[:len(string_split(regexp_replace(article, '</p>|</?(?:div|footer)[^>]*>', '<p>', 'g'), '<p>'))]) AS place FROM cut),
own AS (SELECT rn, place, contains(x, '<b>') AS bold, 'p' AS tag, {bare("regexp_replace(x, '<br>', chr(10), 'g')")} AS x FROM part WHERE place > 0 AND {bare('x')} <> ''),
boxed AS (SELECT rn, 0 AS place, false AS bold, 'div' AS tag, {bare('box')} AS x FROM cut WHERE {bare('box')} <> '' AND rn NOT IN (SELECT rn FROM own WHERE trim(x, {CHARS}) <> '') AND {dense(bare('box'))} >= {V.CHROME_SHARE} * {dense(bare("regexp_replace(x, '(?s)^.*<body>', '')"))}),
block AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY place) - 1 AS block_id, bold, tag, regexp_replace({decode}, '^\\n+|\\n+$', '', 'g') AS text FROM (SELECT * FROM own UNION ALL SELECT * FROM boxed)),
prose AS (SELECT * FROM (SELECT *, {words('text')} AS n, regexp_matches(text, {q(ends)}) AS ended FROM block) WHERE n >= CASE tag WHEN 'div' THEN {V.LAYOUT_WORDS} ELSE {V.MIN_WORDS} END AND NOT regexp_matches(text, {q(caption)}) AND NOT (n <= {V.QUESTION_WORDS} AND regexp_matches(text, {q(question)})) AND (ended OR n > CASE WHEN bold THEN {V.BOLD_HEADING_WORDS} ELSE {V.HEADING_WORDS} END)),
keyed AS (SELECT rn * 100000 + block_id AS id, text FROM prose),{sentences('keyed', 'id', 's')},
{ties(rf':{NOTES}[{SPACE}]*$')},
ids AS (SELECT id, i, x, row_number() OVER (PARTITION BY id // 100000 ORDER BY id, i) - 1 AS sent_id, coalesce(sum(CASE WHEN i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id // 100000 ORDER BY id, i), 0) AS nth FROM told),
found AS (SELECT h.page_id, h.rn, CAST(y.sent_id AS INT) AS sent_id, CAST(y.id % 100000 AS INT) AS block_id, trim(regexp_replace(y.x, '[{SPACE}]+', ' ', 'g')) AS text, 0 AS wrap_start, CAST(y.sent_id - y.i + r.first AS INT) AS quote_id
  FROM ids y JOIN html h ON h.rn = y.id // 100000 LEFT JOIN run r ON r.id = y.id AND y.i BETWEEN r.first AND r.last WHERE y.sent_id - y.i < {V.MAX_SENTENCES})"""


def page_sentences() -> str:
    return f"WITH RECURSIVE {page_rows()} SELECT page_id, sent_id, block_id, text, wrap_start, quote_id, {account(Duck())} AS withheld FROM found"


def page_content_hash() -> str:
    step = "CAST(xor(h, c) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT AS UHUGEINT)"
    units = "list_transform(string_split(text, ''), lambda x: CAST(unicode(x) AS UHUGEINT))"
    return f"""WITH RECURSIVE {page_rows()}, joined AS (SELECT h.rn, h.page_id, string_agg(f.text, chr(10) ORDER BY f.sent_id) AS text FROM html h LEFT JOIN found f USING (rn) GROUP BY h.rn, h.page_id)
SELECT page_id, CASE WHEN coalesce(text, '') = '' THEN 'cbf29ce484222325' ELSE lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, {units}), lambda h, c: {step})), 16, '0')) END AS content_hash FROM joined"""


def quoted() -> str:
    return f"WITH RECURSIVE keyed AS (SELECT row_number() OVER () AS id, conv_id, turn, concat(t[:len(t) // 2], '“', t[len(t) // 2 + 1:], '”') AS text FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)),{sentences('keyed', 'id', 's')},{ties('^$')}"


def quote_islands() -> str:
    return f"{quoted()} SELECT conv_id AS page_id, turn, CAST(first AS INT) AS group_id, CAST(last AS INT) AS last_id FROM run JOIN keyed USING (id)"


def quote_keep() -> str:
    score = "(CAST('0x' || md5(x)[1:4] AS INT) / CAST(65535 AS DOUBLE))"
    return f"""{quoted()}, own AS (SELECT t.id, t.i, r.first, {score} >= {V.KEEP_AT} AS kept, CAST(floor({score} * 1000) AS INT) % 50 = 0 AS pending FROM told t LEFT JOIN run r ON r.id = t.id AND t.i BETWEEN r.first AND r.last),
every AS (SELECT id, first, bool_or(kept) AS kept, bool_or(pending) AS pending FROM own WHERE first IS NOT NULL GROUP BY id, first)
SELECT k.conv_id AS page_id, k.turn, CAST(o.i AS INT) AS sent_id, CASE WHEN coalesce(e.pending, o.pending) THEN 'undecided' WHEN coalesce(e.kept, o.kept) THEN 'kept' ELSE 'faded' END AS state FROM own o JOIN keyed k USING (id) LEFT JOIN every e ON e.id = o.id AND e.first = o.first"""


def stitch_spans() -> str:
    """Words by rows; two marks are one stretch if they are neighbours among the asked words and little, without punctuation, is between them."""
    stop = "(" + ", ".join(map(q, V.STOP_WORDS)) + ")"
    score = "(CAST('0x' || md5(concat(word, '/', i))[1:4] AS INT) / CAST(65535 AS DOUBLE))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),{sentences('d', 'rn')},
t AS (SELECT rn, k, trim(raw, {CHARS}) AS text FROM s),
w AS (SELECT rn, k, text, unnest(range(len(l))) AS n, unnest(l) AS raw, unnest(p) AS piece FROM (SELECT *, regexp_extract_all(text, {q(V.ASKED_WORD)}) AS l, regexp_extract_all(text, {q('(?s).*?(?:' + V.ASKED_WORD + ')')}) AS p FROM t)),
a AS (SELECT rn, k, text, n, rtrim(raw, {q(".,'’-")}) AS word, CAST(sum(len(piece)) OVER (PARTITION BY rn, k ORDER BY n) - len(raw) AS INT) AS a FROM w),
i AS (SELECT rn, k, text, word, a, a + len(word) AS b, row_number() OVER (PARTITION BY rn, k ORDER BY n) - 1 AS i FROM a WHERE (len(word) > 1 OR regexp_matches(word, '^\\p{{N}}$')) AND lower(word) NOT IN {stop}),
p AS (SELECT *, {score} AS p FROM i),
c AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY rn, k, i // {V.WORDS_PER_REQUEST}) AS best FROM p) WHERE p >= {V.MARK_AT} OR p >= {V.MARK_FLOOR} AND p >= {V.STANDOUT} * best),
o AS (SELECT *, CASE WHEN i - lag(i) OVER e = 1 AND a - lag(b) OVER e <= {V.STITCH_GAP} AND NOT regexp_matches(text[lag(b) OVER e + 1:a], {q(V.STITCH_BREAK)}) THEN 0 ELSE 1 END AS opens FROM c WINDOW e AS (PARTITION BY rn, k ORDER BY i)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY rn, k ORDER BY i) - 1 AS g FROM o)
SELECT any_value(doc_id) AS page_id, CAST(k AS INT) AS sent_id, CAST(g AS INT) AS span_no, min(a) AS start, max(b) AS "end" FROM g JOIN d USING (rn) GROUP BY rn, k, g"""


def page_cap() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT * FROM (SELECT rn, doc_id, unnest(range(len(l))) AS place, unnest(l) AS text FROM d) WHERE text <> ''), keyed AS (SELECT rn * 1000000 + place AS id, text FROM b),{sentences('keyed', 'id', 's')},
n AS (SELECT b.rn, b.doc_id, b.place, count(s.id) AS n FROM b LEFT JOIN s ON s.id = b.rn * 1000000 + b.place GROUP BY b.rn, b.doc_id, b.place),
f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rn ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_id FROM n)
SELECT doc_id AS page_id, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS sentences FROM f WHERE first_id < {V.MAX_SENTENCES} GROUP BY rn, doc_id"""


def page_cache() -> str:
    """Requests of the first run: those of the first page of each text that passes the guards; of the second: none."""
    return f"""WITH RECURSIVE {page_rows()}, f AS (SELECT *, {account(Duck())} AS withheld FROM found),
n AS (SELECT h.rn, h.page_id, count(f.rn) AS n, count(*) FILTER (f.withheld) AS held, string_agg(f.text, chr(10) ORDER BY f.sent_id) AS text FROM html h LEFT JOIN f USING (rn) GROUP BY h.rn, h.page_id),
g AS (SELECT *, n >= {V.MIN_SENTENCES} AND held < {V.STATEMENT_NUMBERS} AS judged FROM n)
SELECT page_id, CASE WHEN judged AND row_number() OVER (PARTITION BY judged, text ORDER BY page_id) = 1 THEN CAST(ceil((n - held) / {V.PER_REQUEST}.0) AS BIGINT) ELSE 0 END AS requests, CASE WHEN judged THEN n - held ELSE 0 END AS answered, 0 AS failed, judged AS hit_again, 0 AS requests_again FROM g"""


ORACLES = {"page_cap": page_cap(), "stitch_spans": stitch_spans(), "quote_islands": quote_islands(), "quote_keep": quote_keep(), "page_cache": page_cache(), "document_sentences": document_sentences(), "page_sentences": page_sentences(), "page_content_hash": page_content_hash(), "document_accounts": f"SELECT doc_id FROM documents WHERE {account(Duck())}"}
