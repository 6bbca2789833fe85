"""Double quotation marks in pairs, and the sentences that a quotation ties, in built-in functions."""

from __future__ import annotations

from gleaner.functions import sqltext as F
from gleaner.functions.columns import let, running
from gleaner.functions.sqltext import Expr as Column

MARK = '["“”„«»]'


def pairs(text: Column) -> Column:
    """Where quotations begin and end: marks are paired as they nest; a straight one closes what is open, else opens; unpaired ones are ignored."""
    # what follows the last mark is a match too: else each of its places would be tried up to the text's end
    upto = F.filter(F.regexp_extract_all(text, F.lit(rf'[^"“”„«»]*+(?:{MARK}|\z)'), F.lit(0)), lambda x: F.right(x, F.lit(1)).rlike(MARK))
    marks = let(upto, lambda found: let(running(F.transform(found, lambda x: F.length(x).cast("long")), F.lit(0).cast("long")), lambda at: F.transform(found, lambda x, i: F.struct(F.get(at, i).alias("end"), F.right(x, F.lit(1)).alias("mark")))))

    def step(state: Column, m: Column) -> Column:
        depth = F.size(state["open"])
        closes = m["mark"].isin("”", "»") | (m["mark"] == '"') & (depth > 0)
        opened = F.when(~closes, F.array_append(state["open"], m["end"] - 1)).when(depth > 0, F.slice(state["open"], F.lit(1), depth - 1)).otherwise(state["open"])
        found = F.when(closes & (depth > 0), F.array_append(state["found"], F.struct(F.element_at(state["open"], -1).alias("a"), m["end"].alias("b")))).otherwise(state["found"])
        return F.struct(opened.alias("open"), found.alias("found"))

    none = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast("array<struct<a: bigint, b: bigint>>").alias("found"))
    return F.when(text.rlike(MARK), F.aggregate(marks, none, step, lambda s: s["found"])).otherwise(F.array().cast("array<struct<a: bigint, b: bigint>>"))


def groups(spans: Column, found: Column) -> Column:
    """Stretches of sentences (first, last) that quotations tie; ``spans`` (a, b) in order. Stretches that share a sentence are one."""
    first = lambda q: F.size(F.filter(spans, lambda s: s["b"] <= q["a"]))
    last = lambda q: F.size(F.filter(spans, lambda s: s["a"] < q["b"])) - 1
    touched = F.array_sort(F.filter(F.transform(found, lambda q: F.struct(first(q).alias("first"), last(q).alias("last"))), lambda t: t["first"] < t["last"]))
    none = F.array().cast("array<struct<first: int, last: int>>")

    def step(acc: Column, t: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(end["first"].alias("first"), F.greatest(end["last"], t["last"]).alias("last"))
        return F.when((F.size(acc) > 0) & (t["first"] <= end["last"]), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.array_append(acc, t))

    return F.when(F.size(found) > 0, F.aggregate(touched, none, step)).otherwise(none)


def group_of(stretches: Column, i: Column) -> Column:
    """The first sentence of the stretch that sentence i is in, or null."""
    return F.get(F.filter(stretches, lambda g: (g["first"] <= i) & (i <= g["last"])), F.lit(0))["first"]
