"""Operator 4: a low-discrepancy schedule that mixes sources to target weights.

Sources in code-point order (null last) get the weights in turn. They share ``share`` times all words; a target stops
at ``most`` times its source and the excess is shared again by weight, until none is above. Slot i of the schedule is
the i-th golden-ratio point (an exact 64-bit rotation); the cumulative targets map it to a source. Slots are ranked per
source, in parts, and slot r of a source takes block r of the source's documents, shuffled by a hash and cut into
blocks of equal words; after the last block the next pass begins. The slot that reaches the target is cut there; a
source whose slots end before its target gets the few that it lacks at the schedule's end.

Cases: null or empty texts have size 0 and are never taken; a null source is a source of its own; with no words at all
targets are 0; an empty table gives no rows; a row listed twice counts and is taken as two documents; extra columns are
ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, checkpointed, shuffle_partitions

GOLDEN = 11400714819323198485  # 2**64 divided by the golden ratio, odd
WEIGHTS = (5, 2, 1)
GUIDE = 1024


def sized(docs: DataFrame) -> DataFrame:
    """(row key, doc_id, source, size); rows that agree in all of them are interchangeable."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sub"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source_no, source, source_size, target, low, high): one row per source; windows run over these few rows only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_rows = Window.partitionBy(F.lit(0))
    by_name = all_rows.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = all_rows.orderBy("ratio", "source_no")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    per = per.withColumn("water", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(all_rows))
    per = per.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")))
    every = F.sum("target").over(all_rows)
    high = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("high", F.when(every > 0, high / every).otherwise(0.0)).withColumn("low", F.when(every > 0, (high - F.col("target")) / every).otherwise(0.0))
    return per.select("source_no", "source", "source_size", "target", "low", "high")


def schedule(docs: DataFrame, block_words: int = 2048, slots_at_least: int = 1 << 18) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized rows with keys, sources, takes): takes says which words of which row each slot takes.

    takes: slot, source_no, row, pass, from, to — words of the document, in its own count.
    """
    spark = docs.sparkSession
    base = checkpointed(sized(docs))
    rows, words = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = checkpointed(targets(base))
    total = 1.5 * words
    block = int(max(1, min(block_words, total // slots_at_least)))
    slots = -(-int(total) // block)
    parts = max(64, 4 * shuffle_partitions(spark), rows // 20_000)

    keyed = base.join(sources.select("source_no", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    order = F.xxhash64("doc_id", "sub", F.lit(4))
    keyed = keyed.withColumn("part", F.pmod(order, F.lit(parts))).withColumn("order", order)
    own = Window.partitionBy("source_no", "part").orderBy("order", "doc_id", "sub")
    within = keyed.withColumn("copy", F.row_number().over(own)).withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    part_sizes = keyed.groupBy("source_no", "part").agg(F.sum("size").alias("n"))
    part_sizes = part_sizes.select("source_no", "part", (F.sum("n").over(Window.partitionBy("source_no").orderBy("part")) - F.col("n")).alias("before"))
    placed = within.join(part_sizes, ["source_no", "part"]).select(F.struct("source_no", "part", "copy").alias("row"), "doc_id", "sub", "source_no", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("begin"))
    placed = checkpointed(placed)

    block_no = F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)))
    pieces = placed.where("size > 0").select("row", "source_no", "size", "begin", block_no.alias("block"))

    grain = 4096
    point = ((F.col("id").cast("decimal(18,0)") * F.lit(Decimal(GOLDEN))) % F.lit(Decimal(1 << 64))).cast("double") / float(1 << 64)
    guide = sources.where("target > 0").select("*", F.explode(F.sequence(F.floor(F.col("low") * GUIDE), F.floor(F.col("high") * GUIDE))).alias("cell"))
    chosen = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * GUIDE))
    chosen = chosen.join(guide, "cell").where("point >= low AND point < high").select("slot", "source_no", "source_size", "target", F.floor(F.col("slot") / grain).alias("part"))
    counts = chosen.groupBy("source_no", "part").agg(F.count("*").alias("n"))
    counts = counts.select("source_no", "part", "n", (F.sum("n").over(Window.partitionBy("source_no").orderBy("part")) - F.col("n")).alias("before"))
    ranked = chosen.withColumn("own", F.row_number().over(Window.partitionBy("source_no", "part").orderBy("slot")) - 1).join(counts.drop("n"), ["source_no", "part"])
    ranked = ranked.select("slot", "source_no", "source_size", "target", (F.col("before") + F.col("own")).alias("rank"))
    # short last blocks use up whole slots: the few that a source lacks to reach its target follow at the end
    whole, blocks = F.floor(F.floor("target") / F.col("source_size")), F.ceil(F.col("source_size") / block)
    need = whole * blocks + F.ceil((F.floor("target") - whole * F.col("source_size")) / block)
    have = F.coalesce("have", F.lit(0))
    lacking = sources.where("target > 0").join(counts.groupBy("source_no").agg(F.sum("n").alias("have")), "source_no", "left").where(need > have)
    lacking = lacking.select("source_no", "source_size", "target", F.explode(F.sequence(have, need - 1)).alias("rank"))
    late = F.lit(slots) + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_no", "rank")) - 1
    ranked = ranked.unionByName(lacking.withColumn("slot", late)).withColumn("blocks", blocks)
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    ranked = ranked.withColumn("stop", F.least(F.lit(block), F.floor(F.col("target")) - F.col("pass") * F.col("source_size") - F.col("block") * block)).where("stop > 0")
    takes = pieces.join(ranked.select("slot", "source_no", "block", "pass", "stop"), ["source_no", "block"])
    first = F.greatest(F.col("begin"), F.col("block") * block)
    last = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("stop"))
    takes = takes.where(last > first).select("slot", "source_no", "row", "pass", (first - F.col("begin")).alias("from"), (last - F.col("begin")).alias("to"))
    return placed, sources, takes


def mixture(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its size, its source's size and target, and how many of its words the mix takes."""
    placed, sources, takes = schedule(docs)
    taken = takes.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    out = placed.join(taken, "row", "left").join(sources, "source_no")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns as in ``docs``; a cut one has the words that are taken, as they stand in its text.

    Cases: null and empty texts have no words, so they are in no mix; rows that agree in doc_id and text are interchangeable, what
    is taken of them is pooled; a null doc_id is an id like any other; columns of any name are passed on; an empty table gives no rows.
    """
    placed, _, takes = schedule(docs)
    spans = takes.groupBy("row", "pass").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    taken = placed.join(spans, "row").groupBy("doc_id", "sub").agg(F.collect_list(F.struct("from", "to")).alias("spans"), F.first("size").alias("size"))
    taken = taken.select(F.xxhash64("doc_id", "sub").alias("key"), "spans", "size")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    once = whole.join(taken, "key").groupBy("key").agg(F.first("row").alias("row"), F.first("spans").alias("spans"), F.first("size").alias("size"))
    each = once.select("row", "size", F.explode("spans").alias("span"))
    first, n = F.col("span.from").cast("int") + 1, (F.col("span.to") - F.col("span.from")).cast("int")
    words, gaps = F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), first, n), F.slice(F.split("row.text", WORD, -1), first, n)
    part = F.expr("substring(part, length(element_at(gaps, 1)) + 1)")
    cut = each.withColumn("gaps", gaps).withColumn("part", F.array_join(F.zip_with("gaps", words, lambda gap, word: F.concat(gap, word)), ""))
    text = F.when((F.col("span.from") == 0) & (F.col("span.to") == F.col("size")), F.col("row.text")).otherwise(part)
    out = cut.select("row", text.alias("text"))

    def column(c: str):
        if c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("text") if c == "text" else F.col(f"row.`{c}`")

    return out.select(*(column(c) for c in docs.columns))
