"""Text functions that SQL cannot express; spans are offsets in code points.

Where pieces join their neighbours (short sentences, short clauses, marks, quotations) the rule is written as one
classification of all pieces, and the joined ones are read off as groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby

import regex

from gleaner.plans import values as V

Span = tuple[int, int]
#: More characters than any abbreviation, initial or list number has with the white space before it.
LOOK_BACK = 256


def any_of(characters: str) -> str:
    return "[" + "".join(regex.escape(c) for c in characters) + "]"


#: A place where a sentence may begin: marks, what closes the sentence, white space (none needed behind full-width marks), an opener.
BOUNDARY = regex.compile(
    rf"(?P<marks>{any_of(V.SENTENCE_MARKS)}+){any_of(V.CLOSERS)}*(?P<notes>{V.FOOTNOTES})(?:(?<={any_of(V.FLUSH_MARKS)}(?:{any_of(V.CLOSERS)}|\[[^\[\]\n]{{1,30}}\])*)\s*|\s+)(?=(?P<opener>[\p{{Lu}}\p{{N}}]|{any_of(V.OPENERS)}|\p{{L}}))"
)
LINE = regex.compile(r"[^\n\r]+")
ENDS = regex.compile(V.ENDS_SENTENCE)
LEAD_IN = regex.compile(V.LEAD_IN)
CASED = regex.compile(r"[\p{Ll}\p{Lt}]")
TOKEN = regex.compile(r"[\p{L}\p{N}.]+$")
INITIAL = regex.compile(r"(?<![\p{L}\p{N}])\p{L}$|\.$")
LIST_NUMBER = regex.compile(rf"(?:^\s*|{any_of(V.BEFORE_ENUMERATOR)}\s+|(?!\.){any_of(V.BEFORE_ENUMERATOR)})\d{{1,2}}$")
BY_CHARACTER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’]\p{L}+)?")
NOTE_BEHIND = regex.compile(r"(?<=\S)\[[^\[\]\n]{1,30}\]")
ASKED = regex.compile(V.ASKED_WORD)
BREAK = regex.compile(V.STITCH_BREAK)
CUT = regex.compile(V.CLAUSE_CUT)
EDGE = regex.compile(rf"^{V.CLAUSE_EDGE}+|{V.CLAUSE_EDGE}+$")
QUOTE = regex.compile(r'["“”„«»]')
AS_WRITTEN = frozenset(V.ABBREVIATIONS)
IN_ANY_CASE = frozenset(a.lower() for a in V.ABBREVIATIONS if a not in V.ABBREVIATIONS_AS_WRITTEN)


def count_words(text: str) -> int:
    """Words; a character of a script without spaces is a word, a footnote mark behind a word is none."""
    bare = NOTE_BEHIND.sub(" ", text) if "[" in text else text
    return len(BY_CHARACTER.findall(bare)) + len(WORD.findall(BY_CHARACTER.sub(" ", bare)))


def abbreviated(token: str) -> bool:
    return token in AS_WRITTEN or token.lower() in IN_ANY_CASE


def period_is_inside(before: str, noted: bool) -> bool:
    """Whether a period behind ``before`` belongs to an abbreviation, an initial or a list number; a footnote rules out the last two."""
    token = TOKEN.search(before)
    if not token:
        return False
    if abbreviated(token[0]) or abbreviated(token[0].rpartition(".")[2]):
        return True
    return not noted and bool(INITIAL.search(before) or LIST_NUMBER.search(before))


def before(line: str, at: int) -> str:
    """What stands before a place, as far back as the rules on periods look; a line that begins farther back has a letter there."""
    return line[:at] if at <= LOOK_BACK else "x" + line[at - LOOK_BACK : at]


def openings(line: str) -> list[int]:
    """Where sentences begin inside a line, beyond its first."""
    found = []
    for m in BOUNDARY.finditer(line):
        opener = m["opener"]
        if opener.isalpha() and opener.lower() != opener.upper() and CASED.match(opener):
            continue
        if m["marks"] == "." and period_is_inside(before(line, m.start()), bool(m["notes"])):
            continue
        found.append(m.end())
    return found


def stripped(text: str, a: int, b: int) -> Span:
    piece = text[a:b]
    return a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())


def hulls(spans: list[Span], groups: list[int]) -> list[Span]:
    """From the first start to the last end of each group of neighbours."""
    joined = ([s for s, _ in part] for _, part in groupby(zip(spans, groups, strict=True), key=lambda x: x[1]))
    return [(part[0][0], part[-1][1]) for part in joined]


def split_sentences(text: str) -> list[Span]:
    """Sentences as spans: a line break always ends one, short pieces join a neighbour, a short unfinished tail is dropped."""
    pieces: list[Span] = []
    for line in LINE.finditer(text):
        cuts = [line.start(), *(line.start() + x for x in openings(line[0])), line.end()]
        pieces += [s for a, b in zip(cuts, cuts[1:], strict=False) if (s := stripped(text, a, b))[0] < s[1]]
    size = [count_words(text[a:b]) for a, b in pieces]
    long = [n >= V.MIN_WORDS for n in size]
    if pieces and any(long[:-1]) and size[-1] <= V.TAIL_WORDS and not ENDS.search(text[slice(*pieces[-1])]):
        del pieces[-1], long[-1]
    # a long piece opens a group and short ones stay in it; those before the first long one belong to its group
    return hulls(pieces, [max(1, n) for n in accumulate(map(int, long))])


def quotations(text: str) -> list[Span]:
    """Double quotation marks paired as they nest; a straight one closes what is open, else opens; unpaired ones are ignored."""
    open_: list[int] = []
    found = []
    for m in QUOTE.finditer(text):
        closes = m[0] in "”»" or m[0] == '"' and open_
        if not closes:
            open_.append(m.start())
        elif open_:
            found.append((open_.pop(), m.end()))
    return sorted(found)


def quote_groups(sentences: list[Span], quotes: list[Span]) -> list[int]:
    """For each sentence the first of those that quotations tie it to, or -1.

    A quotation touches a stretch of neighbouring sentences; stretches that share a sentence merge.
    """
    starts, ends = [s for s, _ in sentences], [e for _, e in sentences]
    touched = sorted((bisect_right(ends, a), bisect_left(starts, b) - 1) for a, b in quotes)
    group = [-1] * len(sentences)
    first = last = -1
    for low, high in touched:
        if low >= high:
            continue
        first, last = (first, max(last, high)) if low <= last else (low, high)
        group[first : last + 1] = [first] * (last + 1 - first)
    return group


def asked_words(text: str) -> list[tuple[int, int, str]]:
    """The words worth asking about."""
    words = ((m.start(), m[0].rstrip(".,'’-")) for m in ASKED.finditer(text))
    return [(at, at + len(w), w) for at, w in words if (len(w) > 1 or w.isnumeric()) and w.lower() not in V.STOP_WORDS]


def stitch(text: str, marked: list[Span], asked: list[tuple[int, int, str]]) -> list[Span]:
    """Marks become one stretch if little, no punctuation and no refused word is between them."""
    spans = sorted(marked)
    reach = list(accumulate((b for _, b in spans), max))
    begins = [a for a, _, _ in asked]

    def apart(end: int, start: int) -> bool:
        if start < end:
            return False
        next_asked = bisect_left(begins, end)
        refused = next_asked < len(asked) and asked[next_asked][1] <= start
        return refused or start - end > V.STITCH_GAP or bool(BREAK.search(text, end, start))

    opens = [i == 0 or apart(reach[i - 1], a) for i, (a, _) in enumerate(spans)]
    return hulls([(a, r) for (a, _), r in zip(spans, reach, strict=True)], list(accumulate(map(int, opens))))


def clauses(text: str, least: int = V.CLAUSE_WHOLE_WORDS, merge: int = V.CLAUSE_MERGE_WORDS) -> list[Span]:
    """The clauses of a long sentence: short ones join the one before; what is short at the head joins the next."""

    def words(a: int, b: int) -> int:
        return len(text[a:b].split())

    if words(0, len(text)) <= least:
        return [(0, len(text))]
    cuts = [0, *(m.end() for m in CUT.finditer(text)), len(text)]
    pieces = list(zip(cuts, cuts[1:], strict=False))
    groups = list(accumulate(int(words(a, b) >= merge) for a, b in pieces))
    head = groups.count(0)
    if head and words(0, pieces[head - 1][1]) < merge:
        groups = [max(1, g) for g in groups]
    return [core(text, a, b) for a, b in hulls(pieces, groups)]


def core(text: str, a: int, b: int) -> Span:
    """A clause without the white space and punctuation at its edges."""
    trims = {m.start(): len(m[0]) for m in EDGE.finditer(text[a:b])}
    lead = trims.get(0, 0)
    tail = sum(n for at, n in trims.items() if at)
    return a + lead, max(a + lead, b - tail)


def hash_text(text: str) -> str:
    """FNV-1a with 64 bits over UTF-16 units, as 16 hexadecimal digits."""
    value = 0xCBF29CE484222325
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        value = ((value ^ (raw[i] | raw[i + 1] << 8)) * 0x100000001B3) & (2**64 - 1)
    return f"{value:016x}"


def iban_valid(text: str) -> bool:
    compact = "".join(text.replace(" ", " ").split(" "))
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def luhn_valid(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


IBAN, CARD = regex.compile(V.IBAN), regex.compile(V.CARD)
OTHER_NUMBERS = regex.compile(f"{V.ITALIAN_TAX_CODE}|{V.US_SSN}")
DIGIT = regex.compile(r"\d")


def carries_account_number(text: str) -> bool:
    if not DIGIT.search(text):
        return False
    valid = any(iban_valid(m[0]) for m in IBAN.finditer(text)) or any(luhn_valid(m[0]) for m in CARD.finditer(text))
    return valid or bool(OTHER_NUMBERS.search(text))
