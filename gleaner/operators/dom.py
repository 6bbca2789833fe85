"""Pages' streams of items to judged sentences, by expressions on arrays: one row a page, no shuffle.

Python parses a page into its stream and its meta data; every rule is here. What holds for an element's inside is a
difference of running sums at the places where it opens and closes; what holds around an item is a running count of elements that
are open there, or the place of the nearest one. Work is linear in a page's items, times the depth of its elements where an
element's own texts are looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from gleaner.functions import quotes
from gleaner.functions import sqltext as F
from gleaner.functions.columns import BLANK, count_words, let, running, squeeze, staged, strip
from gleaner.functions.sentences import ENDS, LEAD_IN, cleaned, placed, segments
from gleaner.functions.sqltext import Expr as Column
from gleaner.functions.stream import CLOSE, ROOT
from gleaner.plans import values as V
from gleaner.plans.dialect import Spark
from gleaner.plans.sql import account

PART = "array<struct<text: string, link: boolean, bold: boolean>>"


def number(x: Column) -> Column:
    return x.cast("int").cast("long")


def summed(items: Column) -> Column:
    return running(items, F.lit(0).cast("long"))


def dense(x: Column) -> Column:
    """How many characters are no white space."""
    return F.length(F.regexp_replace(x, f"[{BLANK}]+", "")).cast("long")


def named(names: list[str], *values: Column) -> Column:
    """Whether an id or class has one of the names as a whole token, or as a part set off by - or _."""
    pattern = r"(?i)(?<![^\s_-])(?:" + "|".join(names) + r")(?![^\s_-])"
    return F.coalesce(values[0].rlike(pattern), F.lit(False)) | F.coalesce(values[1].rlike(pattern), F.lit(False))


def style_is(style: Column, name: str, value: str) -> Column:
    """Whether the last declaration of a property has a value."""
    stated = F.filter(F.transform(F.split(F.lower(style), ";"), lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))), lambda x: x["k"] == name)
    return F.try_element_at(stated, F.lit(-1))["v"] == value


def flags(x: Column) -> Column:
    """What an item's own tag and attributes tell."""
    a, tag = x["attributes"], x["tag"]
    attr = lambda name: F.try_element_at(a, F.lit(name))
    role, open_ = F.lower(F.coalesce(attr("role"), F.lit(""))), ~tag.isin("", CLOSE)
    has = lambda test: a.isNotNull() & F.coalesce(test, F.lit(False))
    hidden = has(attr("hidden").isNotNull() | (attr("aria-hidden") == "true")) | has(F.lower(attr("contenteditable")) != "false") | has(style_is(attr("style"), "display", "none")) | has(style_is(attr("style"), "visibility", "hidden"))
    roles = has(F.arrays_overlap(F.split(role, f"[{BLANK}]+"), F.array(*V.SKIP_ROLES)))
    works = (tag == "cite") | has(role.isin(V.REFERENCE_ROLES)) | a.isNotNull() & tag.isin("ol", "ul", "div", "section", "dl") & named(V.REFERENCE_NAMES, attr("id"), attr("class"))
    readers = a.isNotNull() & (named(V.UGC_NAMES, attr("id"), attr("class")) | has(F.arrays_overlap(F.split(F.lower(attr("itemprop")), f"[{BLANK}]+"), F.array(*V.UGC_ITEMPROPS))) | has(attr("itemtype").rlike("/(?:" + "|".join(V.UGC_ITEMTYPES) + ")$")))
    return F.struct(
        tag.alias("tag"), x["mate"].alias("mate"), x["parent"].alias("parent"), x["block"].alias("block"), x["table"].alias("table"), x["link"].alias("link"), x["strong"].alias("strong"), x["entry"].alias("entry"), x["main"].alias("main"), x["before"].alias("before"), open_.alias("open"),
        number(open_ & tag.isin(V.FORM_PROSE)).alias("prose"), number(open_ & tag.isin("input", "select", "textarea", "button") & ~has(F.lower(attr("type")) == "hidden")).alias("control"), number(open_ & tag.isin("th", "caption")).alias("headed"), F.when(tag == "", dense(x["text"])).otherwise(0).alias("size"),
        (open_ & (tag.isin(V.SKIP_TAGS) | roles | hidden | works)).alias("skip"), (open_ & (tag.isin([t for t in V.SKIP_TAGS if t not in V.CHROME_TAGS]) | hidden)).alias("refused"), (open_ & (tag.isin(V.CHROME_TAGS) | has(role.isin(V.SKIP_ROLES)))).alias("chrome"),
        (a.isNotNull() & named(V.CHROME_NAMES, attr("id"), attr("class"))).alias("named"), readers.alias("readers"),
    )


def opened(marks: Column, of: Callable[[Column], Column]) -> Column:
    """At each item how many of the marked elements are open there."""

    def steps(known: Column) -> Column:
        return F.transform(F.col("f"), lambda x, i: F.when(x["open"], number(of(F.get(known, i)))).when(x["tag"] == CLOSE, -number(of(F.get(known, x["mate"])))).otherwise(0))

    return let(marks, lambda known: summed(steps(known)))


def within(kind: str, place: Column, mate: Column) -> Column:
    return F.get(F.col(kind), mate) - F.get(F.col(kind), place)


def marked(df: DataFrame) -> DataFrame:
    """f: what items tell themselves; g: which elements are skipped, refused as a container's inside, or chrome, by what is inside them."""
    df = staged(df, f=F.transform(F.col("items"), flags))
    df = staged(df, **{kind: summed(F.col("f")[kind]) for kind in ("prose", "control", "headed", "size")})

    def judged(x: Column, i: Column) -> Column:
        prose = within("prose", i, x["mate"])
        form = (x["tag"] == "form") & ((prose < 3) | (within("control", i, x["mate"]) >= prose))
        cells = F.transform(F.filter(F.transform(F.sequence(i, x["mate"]), lambda j: F.struct(j.alias("j"), F.get(F.col("f"), j).alias("y"))), lambda c: (c["y"]["tag"] == "td") & (c["y"]["table"] == i)), lambda c: within("size", c["j"], c["y"]["mate"]))
        layout = (within("headed", i, x["mate"]) == 0) & let(cells, lambda s: (F.size(s) <= V.LAYOUT_CELLS) | (F.array_max(s) > 0) & (F.array_max(s) >= V.MAIN_CELL_SHARE * F.aggregate(s, F.lit(0).cast("long"), lambda p, q: p + q)))
        table = (x["tag"] == "table") & x["open"]
        return F.struct(F.when(table, ~layout).otherwise(x["skip"] | form).alias("skip"), F.when(table, ~layout).otherwise(x["refused"]).alias("refused"), (x["chrome"] | form).alias("chrome"))

    body = F.array_position(F.transform(F.col("f"), lambda x: x["tag"] == "body"), True).cast("int") - 1
    df = staged(df, g=F.transform(F.col("f"), judged), body=F.greatest(body, F.lit(0)))
    return staged(df, last=F.get(F.col("f"), F.col("body"))["mate"])


def container(df: DataFrame) -> DataFrame:
    """top: the element with the most prose, by two passes over the texts: where prose is, then what each candidate gains by it.

    Text counts for the elements around its block, link text for nothing, text under chrome against at half its length; a
    name makes chrome only of an element with a small share of the prose. Inner elements win ties, but nothing displaces main
    or article at a tie except another such; without a winner it is the body.
    """
    inside = lambda i: (i > F.col("body")) & (i < F.col("last"))
    df = staged(df, numbered=F.transform(F.col("g"), lambda x, i: F.struct(x["refused"].alias("refused"), x["chrome"].alias("chrome"), inside(i).alias("inside"))))
    df = staged(df, refused=opened(F.col("numbered"), lambda x: x["refused"] & x["inside"]), chrome=opened(F.col("numbered"), lambda x: x["chrome"] & x["inside"]))

    def counts(x: Column, i: Column) -> Column:
        block = F.get(F.col("f"), x["block"])["tag"]
        return (x["tag"] == "") & inside(i) & (F.get(F.col("refused"), i) == 0) & (x["block"] > F.col("body")) & F.coalesce(block.isin(V.PARAGRAPH_TAGS), F.lit(False)) & (strip(F.get(F.col("items"), i)["text"]) != "")

    df = staged(df, shown=F.transform(F.col("f"), counts))
    places = F.filter(F.sequence(F.lit(0), F.size(F.col("f")) - 1), lambda i: F.get(F.col("shown"), i))
    texts = F.transform(places, lambda i: let(F.get(F.col("f"), i), lambda x: F.struct(x["block"].alias("block"), (x["link"] > x["block"]).alias("link"), F.length(strip(F.get(F.col("items"), i)["text"])).cast("double").alias("length"))))
    df = staged(df, rank=summed(F.transform(F.col("shown"), number)), texts=texts)
    total = F.aggregate(F.filter(F.col("texts"), lambda t: F.get(F.col("chrome"), t["block"]) == 0), F.lit(0.0), lambda a, t: a + t["length"])
    df = staged(df, total=total)

    def below(name: str, i: Column, mate: Column) -> Column:
        return F.slice(F.col(name), (F.get(F.col("rank"), i) + 1).cast("int"), (F.get(F.col("rank"), mate) - F.get(F.col("rank"), i)).cast("int"))

    def chromeish(x: Column, i: Column) -> Column:
        f = F.get(F.col("f"), i)
        share = F.when(F.col("total") > 0, F.aggregate(F.filter(below("texts", i, f["mate"]), lambda t: t["block"] >= i), F.lit(0.0), lambda a, t: a + t["length"]) / F.col("total")).otherwise(0.0)
        by_name = F.when(f["named"] | f["readers"], f["named"] & (share < V.CHROME_SHARE) | f["readers"] & (share < V.UGC_SHARE)).otherwise(False)
        return F.struct((x["inside"] & f["open"] & (f["main"] != i) & (x["chrome"] | by_name)).alias("on"))

    df = staged(df, ish=opened(F.transform(F.col("numbered"), chromeish), lambda x: x["on"]))

    def gain(t: Column) -> Column:
        main = F.get(F.col("f"), t["block"])["main"]
        under = F.get(F.col("ish"), t["block"]) > F.when(main > F.col("body"), F.get(F.col("ish"), main)).otherwise(0)
        return F.struct(t["block"].alias("block"), F.when(under, -t["length"] / 2).when(t["link"], 0.0).otherwise(t["length"]).alias("gain"))

    df = staged(df, gains=F.transform(F.col("texts"), gain))

    def scored(i: Column) -> Column:
        own = F.filter(below("gains", i, F.get(F.col("f"), i)["mate"]), lambda t: t["block"] > i)
        return let(own, lambda o: F.struct(F.aggregate(o, F.lit(0.0), lambda a, t: a + t["gain"]).alias("score"), (F.get(F.col("f"), i)["main"] == i).alias("main"), i.alias("place"), F.size(F.array_distinct(F.transform(o, lambda t: t["block"]))).alias("paragraphs")))

    fit = F.filter(F.sequence(F.lit(0), F.size(F.col("f")) - 1), lambda i: let(F.get(F.col("f"), i), lambda x: x["open"] & inside(i) & (F.get(F.col("refused"), i) == 0) & ((x["main"] == i) | x["tag"].isin("div", "section", "td"))))
    best = F.array_max(F.filter(F.transform(fit, scored), lambda c: (c["score"] > 0) & (c["main"] | (c["paragraphs"] >= 3))))
    df = staged(df, top=F.coalesce(best["place"], F.col("body")))
    return df.drop("numbered", "refused", "chrome", "shown", "rank", "texts", "total", "ish", "gains")


def blocks(df: DataFrame) -> DataFrame:
    """blocks: the judged blocks of the container in document order, with their parts; a break between parts is a part of its own."""
    df = staged(df, end=F.get(F.col("f"), F.col("top"))["mate"], whole=F.get(F.col("f"), F.col("top"))["tag"].isin("body", ROOT))
    df = staged(df, all_of_it=within("size", F.col("top"), F.col("end")))

    def left(x: Column, i: Column) -> Column:
        f = F.get(F.col("f"), i)
        share = within("size", i, f["mate"])
        by_name = F.col("whole") & f["named"] & (share < V.CHROME_SHARE * F.col("all_of_it")) | f["readers"] & (share < V.UGC_SHARE * F.col("all_of_it"))
        return F.struct((x["skip"] | f["open"] & (i > F.col("top")) & (i < F.col("end")) & by_name).alias("out"))

    df = staged(df, left=F.transform(F.col("g"), left))
    df = staged(df, outside=opened(F.col("left"), lambda x: x["out"]))
    judged = lambda b: (b >= F.col("top")) & F.coalesce(F.get(F.col("f"), b)["tag"].isin(V.JUDGED_TAGS), F.lit(False))

    def event(i: Column) -> Column:
        x, up = F.get(F.col("f"), i), F.get(F.col("f"), F.get(F.col("f"), i)["parent"])
        is_block = x["tag"].isin(V.BLOCK_LEVEL)
        kind = F.when((x["tag"] == "") & (F.get(F.col("outside"), i) == 0), "text").when(x["open"] & (F.get(F.col("outside"), x["parent"]) == 0) & is_block, "block").when((x["tag"] == "br") & (F.get(F.col("outside"), x["parent"]) == 0) & ~F.get(F.col("left"), i)["out"], "line")
        text = reduce(lambda x, c: F.replace(x, c, " "), "\r\n\t\f\x0b", F.get(F.col("items"), i)["text"])
        return F.struct(up["block"].alias("block"), i.alias("place"), kind.alias("kind"), F.when(kind == "text", text).alias("text"), (x["link"] >= F.col("top")).alias("link"), (x["strong"] > up["block"]).alias("bold"))

    events = F.filter(F.transform(F.when(F.col("end") - F.col("top") > 1, F.sequence(F.col("top") + 1, F.col("end") - 1)).otherwise(F.array().cast("array<int>")), event), lambda e: e["kind"].isNotNull() & judged(e["block"]))
    df = staged(df, events=F.array_sort(events))
    starts = F.filter(F.when(F.size(F.col("events")) > 0, F.sequence(F.lit(0), F.size(F.col("events")) - 1)).otherwise(F.array().cast("array<int>")), lambda k: (k == 0) | (F.get(F.col("events"), k)["block"] != F.get(F.col("events"), k - 1)["block"]))
    df = staged(df, starts=starts)
    groups = F.transform(F.col("starts"), lambda s, j: F.slice(F.col("events"), s + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.size(F.col("events"))) - s))

    def parts(own: Column) -> Column:
        """A block's texts; a break before one that isn't the first is a line end."""
        first = F.array_position(F.transform(own, lambda e: e["kind"] == "text"), True) - 1
        part = lambda text, link, bold: F.struct(text.alias("text"), link.alias("link"), bold.alias("bold"))
        line = lambda e, k: F.when((k > first) & (F.get(own, k - 1)["kind"] != "text"), F.array(part(F.lit("\n"), F.lit(False), e["bold"]))).otherwise(F.array().cast(PART))
        return F.flatten(F.transform(own, lambda e, k: F.when(e["kind"] == "text", F.concat(line(e, k), F.array(part(e["text"], e["link"], e["bold"])))).otherwise(F.array().cast(PART))))

    def content(b: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.slice(F.col("items"), b + 1, F.get(F.col("f"), b)["mate"] - b + 1), lambda x: x["tag"] == ""), lambda x: x["text"]), "")

    def continues(b: Column) -> Column:
        """Whether a block is in a list behind a text that ends in a colon."""
        entry = F.get(F.col("f"), b)["entry"]
        before = F.get(F.col("f"), F.get(F.col("f"), entry)["parent"])["before"]
        return F.when((entry >= 0) & (before >= 0), strip(content(before)).rlike(LEAD_IN)).otherwise(False)

    block = lambda own: let(own[0]["block"], lambda b: F.struct(F.get(F.col("f"), b)["tag"].alias("tag"), parts(own).alias("parts"), F.exists(own, lambda e: e["kind"] == "block").alias("nested"), continues(b).alias("continues")))
    texted = F.filter(groups, lambda own: F.exists(own, lambda e: e["kind"] == "text"))
    return staged(df, blocks=F.transform(texted, block)).drop("items", "f", "g", "prose", "control", "headed", "size", "body", "last", "top", "end", "whole", "all_of_it", "left", "outside", "events", "starts")


def label_end(parts: Column, tag: Column, text: Column) -> Column:
    """Where a label that runs into the block's text ends (0: there is none): a bold one, or a short one with a colon in a unit."""
    solid = F.array_position(F.transform(parts, lambda p: (strip(p["text"]) != "") | p["bold"]), True).cast("int")

    def bold_end(first: Column) -> Column:
        plain = F.array_position(F.transform(F.slice(parts, first, F.size(parts) - first + 1), lambda p: ~p["bold"]), True).cast("int")
        head = F.array_join(F.transform(F.slice(parts, F.lit(1), F.when(plain == 0, F.size(parts)).otherwise(first + plain - 2)), lambda p: p["text"]), "")
        return let(F.length(head), lambda n: n + F.length(F.regexp_extract(F.substring(text, n + 1, F.length(text)), rf"^([{BLANK}]*[:–—-])", 1)))

    plain = F.regexp_extract(text, rf"^([{BLANK}]*[^\n.!?:]{{1,48}}:)(?=[{BLANK}])", 1)
    by_colon = F.when(tag.isin(V.UNIT_TAGS) & (plain != "") & (count_words(plain) <= V.PLAIN_LABEL_WORDS), F.length(plain)).otherwise(0)
    end = let(solid, lambda first: F.when((first > 0) & F.coalesce(F.get(parts, first - 1)["bold"], F.lit(False)), bold_end(first)).otherwise(by_colon))
    return let(end, lambda n: F.when((n > 0) & count_words(F.left(text, n)).between(1, V.LABEL_WORDS) & (count_words(F.substring(text, n + 1, F.length(text))) >= V.LABEL_REST_WORDS), n).otherwise(0))


def is_prose(b: Column, text: Column) -> Column:
    """Whether a block's text is prose: neither links nor a heading, a caption, a question over its answer or the rest of a lead-in."""
    shown = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + dense(p["text"]))
    visible, linked = shown(b["parts"]), shown(F.filter(b["parts"], lambda p: p["link"]))
    ended, unit = text.rlike(ENDS), b["tag"].isin(V.UNIT_TAGS)
    bold = F.forall(b["parts"], lambda p: p["bold"] | (strip(p["text"]) == ""))

    def by_words(n: Column) -> Column:
        heading = ~unit & ((n <= V.QUESTION_WORDS) & text.rlike(r"^[^.!]*\?[\"'”’»)\]]*" + f"[{BLANK}]*$") | ~ended & (n <= F.when(bold, V.BOLD_HEADING_WORDS).otherwise(V.HEADING_WORDS)))
        structure = text.rlike(rf"(?i)^[{BLANK}]*" + V.CAPTION.removeprefix(r"\s*")) | (b["tag"] == "figcaption") & (n <= V.CAPTION_WORDS) | ~ended & b["continues"] | heading
        return ~(b["tag"].isin(V.LAYOUT_TAGS) & (b["nested"] | (n < V.LAYOUT_WORDS)) | (n < V.MIN_WORDS) | structure)

    return (visible > 0) & (linked < V.LINK_RATIO * visible) & let(count_words(text), by_words)


def spans(tag: Column, text: Column) -> Column:
    """A block's sentences as places (a, b) of its text; a short unit is one sentence."""
    cut = F.when(tag.isin(V.UNIT_TAGS) & (F.length(strip(text)) <= V.UNIT_CHARS), F.array(strip(text))).otherwise(segments(text))
    return F.filter(placed(text, cut), lambda s: ~s["text"].rlike(LEAD_IN))


SENTENCES = "array<struct<text: string, wrap_start: int, quote: int>>"


def block_sentences(b: Column) -> Column:
    """The sentences of a block: text, where the part behind a label begins in it, and the first sentence (of the block) of its quotation."""

    def of(text: Column) -> Column:
        def tied(found: Column, label: Column, stretches: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                begin = F.greatest(s["a"], F.least(label, s["b"]))
                rest = squeeze(F.substring(text, begin + 1, s["b"] - begin))
                behind = lambda clean: F.when(begin > s["a"], F.length(clean) - F.length(rest)).otherwise(0).cast("int")
                return let(squeeze(s["text"]), lambda clean: F.struct(clean.alias("text"), behind(clean).alias("wrap_start"), quotes.group_of(stretches, i).alias("quote")))

            return F.transform(found, one)

        found = lambda s: let(label_end(b["parts"], b["tag"], text), lambda label: let(quotes.pairs(text), lambda q: let(quotes.groups(s, q), lambda g: tied(s, label, g))))
        return F.when(is_prose(b, text), let(spans(b["tag"], text), found)).otherwise(F.array().cast(SENTENCES))

    return let(cleaned(F.array_join(F.transform(b["parts"], lambda p: p["text"]), "")), of)


def sentences(streams: DataFrame, cap: int = V.MAX_SENTENCES) -> DataFrame:
    """``streams`` (with items) with sentences: sent_id, block_id, text, wrap_start, quote_id, withheld. The cap falls between blocks."""
    df = blocks(container(marked(streams)))
    df = staged(df, found=F.transform(F.col("blocks"), block_sentences)).drop("blocks")
    df = staged(df, upto=summed(F.transform(F.col("found"), lambda s: F.size(s).cast("long"))))
    base = lambda b: F.coalesce(F.get(F.col("upto"), b - 1), F.lit(0))
    kept = F.transform(F.col("found"), lambda s, b: F.when(base(b) < cap, F.transform(s, lambda x, k: F.struct((base(b) + k).cast("int").alias("sent_id"), b.cast("int").alias("block_id"), x["text"].alias("text"), x["wrap_start"].alias("wrap_start"), (base(b) + x["quote"]).cast("int").alias("quote_id")))).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("sent_id"), F.lit(0).alias("block_id"), F.lit("").alias("text"), F.lit(0).alias("wrap_start"), F.lit(0).alias("quote_id"))), F.lit(1), F.lit(0))))
    df = staged(df, sentences=F.flatten(kept)).drop("found", "upto")
    withheld = S.expr(f"transform(sentences, s -> named_struct('sent_id', s.sent_id, 'block_id', s.block_id, 'text', s.text, 'wrap_start', s.wrap_start, 'quote_id', s.quote_id, 'withheld', s.text RLIKE '[0-9]' AND {account(Spark(), 's.text')}))")
    return df.withColumn("sentences", withheld)
