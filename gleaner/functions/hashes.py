"""Hashes of text in built-in functions."""

from __future__ import annotations

from gleaner.functions import sqltext as F
from gleaner.functions.sqltext import Expr as Column

LOW = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a with 64 bits over UTF-16 units, as 16 hexadecimal digits.

    The number is held in two halves, as its prime is 2**40 + 435: no product has more than 42 bits.
    """
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")), F.lit(".{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(h: Column, unit: Column) -> Column:
        low = h["low"].bitwiseXOR(unit)
        return F.struct((h["high"] * 435 + F.shiftright(low * 435, 32) + low * 256).bitwiseAND(LOW).alias("high"), (low * 435).bitwiseAND(LOW).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).alias("high"), F.lit(0x84222325).alias("low"))
    return F.aggregate(units, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))
