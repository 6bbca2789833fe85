"""Quotations across the sentences of texts: stretches that they tie, and what of a stretch stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from gleaner.functions import quotes
from gleaner.functions import sqltext as F
from gleaner.functions.columns import let, staged
from gleaner.functions.sentences import cleaned, placed, segments
from gleaner.functions.sqltext import Expr
from gleaner.plans import values as V
from gleaner.sources.pages import spread


def tied(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) with its sentences (a, b, text), and the stretches (first, last) of them that quotations tie."""
    own = let(cleaned(F.col("text")), lambda text: let(placed(text, segments(text)), lambda found: F.struct(found.alias("sentences"), quotes.groups(found, quotes.pairs(text)).alias("stretches"))))
    return staged(docs, own=own).select(*[c for c in docs.columns if c != "text"], "own.sentences", "own.stretches")


def stub(text: Expr) -> Expr:
    """The stub judge's probability for a text: the first 16 bits of its MD5."""
    return F.conv(F.substr(F.md5(text), 1, 4), 16, 10).cast("int") / F.lit(65535.0)


def decided(df: DataFrame, keep_at: float = V.KEEP_AT) -> DataFrame:
    """``df`` (tied) with states: a stretch is kept if any of its sentences is, undecided while one is; here a score tells both."""
    scores = F.transform(F.col("sentences"), lambda s: let(stub(s["text"]), lambda p: F.struct((p >= keep_at).alias("kept"), (F.floor(p * 1000) % 50 == 0).alias("pending"))))
    df = staged(df, scores=scores)
    part = lambda g: F.slice(F.col("scores"), g["first"] + 1, g["last"] - g["first"] + 1)
    df = staged(df, groups=F.transform(F.col("stretches"), lambda g: let(part(g), lambda own: F.struct(g["first"].alias("first"), g["last"].alias("last"), F.struct(F.exists(own, lambda s: s["kept"]).alias("kept"), F.exists(own, lambda s: s["pending"]).alias("pending")).alias("all")))))
    whole = lambda x, i: F.coalesce(F.get(F.filter(F.col("groups"), lambda g: (g["first"] <= i) & (i <= g["last"])), 0)["all"], x)
    return staged(df, states=F.transform(F.col("scores"), lambda x, i: let(whole(x, i), lambda y: F.when(y["pending"], "undecided").when(y["kept"], "kept").otherwise("faded"))))


def quoting_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations whose second half is a quotation, so that the tables' texts have some."""
    text = S.coalesce("text", S.lit(""))
    half = S.floor(S.length(text) / 2).cast("int")
    quoting = S.concat(S.left(text, half), S.lit("“"), S.substring(text, half + 1, S.length(text)), S.lit("”"))
    return spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(S.col("conv_id").alias("page_id"), "turn", quoting.alias("text")))


def q_quote_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tied(quoting_turns(spark, sf_dir)).select("page_id", "turn", S.explode("stretches").alias("g"))
    return found.select("page_id", "turn", S.col("g.first").alias("group_id"), S.col("g.last").alias("last_id"))


def q_quote_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(tied(quoting_turns(spark, sf_dir))).select("page_id", "turn", S.posexplode("states").alias("sent_id", "state"))


QUERIES = {"quote_islands": q_quote_islands, "quote_keep": q_quote_keep}
