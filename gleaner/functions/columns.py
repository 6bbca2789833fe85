"""Small expressions that several plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from gleaner.functions import sqltext as F
from gleaner.functions.sqltext import Expr as Column

#: All that counts as white space in text from the web, as characters and as the inside of a class of a regular expression.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same inside of a class, for Java's regular expressions: most characters are told by one comparison with the range of what is beyond Latin-1.
BLANK = r"\t\n\x{0B}\f\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
NOTE = r"\[[^\[\]\n\r]{1,30}\]"
#: None of the three scripts has a character below U+2E80.
BY_CHARACTER = r"[\x{2E80}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
WORD = r"[\p{L}\p{N}]+(?:['’]\p{L}+)?"


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` and columns that are worked out once: no later expression or filter gets a copy of what they are made of."""
    own = [c for c in df.columns if c not in columns]
    return df.select(*(S.col(f"`{c}`") for c in own), S.expr(F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).text))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that a running sum goes through before it starts another list; work per element stays the same, however many there are.
BLOCK = 16


def running(items: Column, zero: Column) -> Column:
    """The sums of an array of numbers up to and including each element."""
    def within(block: Column) -> Column:
        empty = F.slice(F.array(zero), F.lit(1), F.lit(0))
        return F.aggregate(block, empty, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x))

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))

    def shifted(parts: Column) -> Column:
        return let(within(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda x: x + F.coalesce(F.get(ends, b - 1), zero)))))

    return let(items, lambda all_: F.when(F.size(all_) == 0, all_).otherwise(let(blocks(all_), shifted)))


def any_of(characters: str) -> str:
    """A class of characters for a regular expression."""
    return "[" + "".join("\\" + c if c in "\\^-[]&~#" else c for c in characters) + "]"


def among(characters: str) -> str:
    """The same class for Java: characters beyond Latin-1 are looked at one by one only within their range."""
    near, far = ("".join(c for c in characters if (ord(c) < 256) is latin) for latin in (True, False))
    return any_of(near) if not far else any_of(near)[:-1] + f"[{min(far)}-{max(far)}&&{any_of(far)}]]"


def strip(x: Column) -> Column:
    return F.trim(x, SPACES)


def squeeze(x: Column) -> Column:
    """One blank for each white space between words, none at the ends."""
    return F.trim(F.regexp_replace(x, f"[{BLANK}]+", " "))


def count_words(x: Column) -> Column:
    """Words; a character of a script without spaces is one, footnote marks behind a character are none."""
    bare = F.when(F.contains(x, F.lit("[")), F.regexp_replace(x, f"([^{BLANK}])(?:{NOTE})+", "$1 ")).otherwise(x)
    many = F.regexp_count(bare, F.lit(BY_CHARACTER)) + F.regexp_count(F.regexp_replace(bare, BY_CHARACTER, " "), F.lit(WORD))
    return F.when(x.rlike(BY_CHARACTER), many).otherwise(F.regexp_count(bare, F.lit(WORD)))
