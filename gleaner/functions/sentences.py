"""Sentences of a text in built-in functions.

One regular expression marks every place where a sentence may begin; the text is cut there and at line breaks, and each cut is
kept or dropped by what stands right beside it: the opener behind it, and the last characters before it (an abbreviation, an
initial, a list number). Cuts before short pieces are dropped too, and then the pieces are joined again up to the next cut
that stays. Every step is one pass over the text or over its pieces, so work is linear in the text, however long a line is.

Two characters that Unicode leaves undefined serve as marks; in a text they count as line breaks and are lost.
"""

from __future__ import annotations

from gleaner.functions import sqltext as F
from gleaner.functions.columns import BLANK, NOTE, SPACES, among, count_words, let, running, strip
from gleaner.functions.sqltext import Expr as Column
from gleaner.plans import values as V

CUT, TAIL = "\ufdd0", "\ufdd1"
INLINE = BLANK.replace(r"\n", "").replace(r"\r", "")
CLOSERS, NOTES = among(V.CLOSERS) + "*", f"(?:{NOTE})*"
#: Marks, what closes the sentence, footnotes, white space (none needed behind full-width marks), and ahead an opener.
PLACE = rf"(?:{among(V.SENTENCE_MARKS)}*{among(V.FLUSH_MARKS)}{CLOSERS}{NOTES}[{INLINE}]*|{among(V.SENTENCE_MARKS)}+{CLOSERS}{NOTES}[{INLINE}]+)(?=[\p{{L}}\p{{N}}]|{among(V.OPENERS)})"
MARKS = rf"^({among(V.SENTENCE_MARKS)}+){CLOSERS}({NOTES})"
ENDS = rf"[.!?…。！？]{among(chr(34) + chr(39) + '”’»)]')}*{NOTES}[{BLANK}]*$"
LEAD_IN = rf":{NOTES}[{BLANK}]*$"
AS_WRITTEN = V.ABBREVIATIONS
IN_ANY_CASE = sorted({a.lower() for a in V.ABBREVIATIONS if a not in V.ABBREVIATIONS_AS_WRITTEN})
#: More characters than the longest abbreviation has.
REACH = 24


def abbreviated(token: Column) -> Column:
    return token.isin(AS_WRITTEN) | F.lower(token).isin(IN_ANY_CASE)


def list_number(before: Column, first: Column, tail: Column) -> Column:
    """Whether a piece's text before its marks is, or ends in, one or two digits at a line's begin or behind a mark.

    first: whether the piece is the first of its line; tail: what the piece before ends in, from its marks on.
    """
    digits = F.length(F.regexp_extract(F.right(before, F.lit(2)), "([0-9]{1,2})$", 1))
    rest = F.left(before, F.length(before) - digits)
    bare = F.trim(rest, SPACES, "TRAILING")
    apart = F.length(bare) < F.length(rest)
    behind = F.right(bare, F.lit(1)).isin(list(V.BEFORE_ENUMERATOR)) & (apart | ~bare.endswith("."))
    return (digits > 0) & F.when(bare == "", first | tail.rlike(rf"[.!?…][{BLANK}]+$")).otherwise(behind)


def stays(piece: Column, before_it: Column, after_it: Column) -> Column:
    """Whether the cut between a piece and the one after it stays."""
    at_break = before_it.isNull() | before_it.rlike(r"[\n\r]$")
    before, tail = F.substring_index(piece, TAIL, 1), F.substring_index(piece, TAIL, -1)
    initial = F.right(before, F.lit(2)).rlike(r"^[^\p{L}\p{N}]?\p{L}$") | before.endswith(".")
    noted = F.regexp_extract(tail, MARKS, 2) != ""

    def inside(token: Column) -> Column:
        return (token != "") & (abbreviated(token) | abbreviated(F.substring_index(token, ".", -1)) | ~noted & (initial | list_number(before, at_break, F.substring_index(before_it, TAIL, -1))))

    period = (F.regexp_extract(tail, MARKS, 1) == ".") & let(F.regexp_extract(F.right(before, F.lit(REACH)), r"([\p{L}\p{N}.]+)$", 1), inside)
    opener = F.left(after_it, F.lit(1))
    small = opener.rlike(r"^[\p{Ll}\p{Lt}]") & (F.lower(opener) != F.upper(opener))
    return piece.rlike(r"[\n\r]$") | ~(small | period)


def joined(pieces: Column) -> Column:
    """The text again, with a mark where a cut stays."""

    def kept(piece: Column, i: Column) -> Column:
        cut = (i + 1 < F.size(pieces)) & stays(piece, F.get(pieces, i - 1), F.get(pieces, i + 1))
        return F.concat(F.replace(piece, TAIL, ""), F.when(cut, CUT).otherwise(""))

    return F.array_join(F.transform(pieces, kept), "")


def grouped(lines: Column, words: Column) -> Column:
    """A long piece opens a sentence and short ones stay in it; those before the first long one belong to its sentence."""
    n = F.size(lines)

    def opened(first: Column) -> Column:
        drops = (first > 0) & (first < n) & (F.element_at(words, -1) <= V.TAIL_WORDS) & ~F.element_at(lines, -1).rlike(ENDS)
        marked = F.transform(lines, lambda line, i: F.concat(F.when((first > 0) & (i >= first) & (F.get(words, i) >= V.MIN_WORDS), CUT).otherwise(""), line))
        return F.array_join(F.slice(marked, F.lit(1), n - drops.cast("int")), "")

    return let(F.array_position(F.transform(words, lambda w: w >= V.MIN_WORDS), True), opened)


def cleaned(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), CUT, "\n"), TAIL, "\n")


def segments(text: Column) -> Column:
    """The stretches of a text that are its sentences, with the white space around them; a short unfinished tail is no sentence."""

    def of(clean: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(clean, PLACE, f"{TAIL}$0{CUT}"), r"[\n\r]+", f"$0{CUT}")
        lines = F.split(let(F.split(marked, CUT), joined), CUT)
        whole = let(lines, lambda x: let(F.transform(x, count_words), lambda words: grouped(x, words)))
        return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(whole, CUT))

    return let(strip(cleaned(text)), of)


def split(text: Column) -> Column:
    """The sentences of a text, without the white space around them."""
    return F.transform(segments(text), strip)


def placed(text: Column, cut: Column) -> Column:
    """Stretches that follow one another in a text as (a, b, text): places and text without the white space around them."""
    head = lambda x: F.length(x) - F.length(F.trim(x, SPACES, "LEADING"))

    def of(found: Column, upto: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return let(head(text) + F.coalesce(F.get(upto, i - 1), F.lit(0)) + head(x), lambda a: F.struct(a.cast("int").alias("a"), (a + F.length(strip(x))).cast("int").alias("b"), strip(x).alias("text")))

        return F.transform(found, one)

    return let(cut, lambda found: let(running(F.transform(found, lambda x: F.length(x).cast("long")), F.lit(0).cast("long")), lambda upto: of(found, upto)))
