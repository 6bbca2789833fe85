"""Words worth asking about, those that stand out, and the stretches that they become: expressions on a sentence's arrays, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from gleaner.functions import sqltext as F
from gleaner.functions.columns import let, running, staged
from gleaner.functions.sentences import split
from gleaner.functions.sqltext import Expr
from gleaner.operators.quotations import stub
from gleaner.plans import values as V
from gleaner.sources.pages import spread

EDGE = ".,'’-"


def worth_asking(word: Expr) -> Expr:
    return ((F.length(word) > 1) | word.rlike(r"^\p{N}$")) & ~F.lower(word).isin(V.STOP_WORDS)


def asked_words(text: Expr) -> Expr:
    """The words of a text that are worth asking about, as (a, b, word): places and the word without what trails it."""
    words, upto = F.regexp_extract_all(text, V.ASKED_WORD, 0), F.regexp_extract_all(text, rf"[\s\S]*?(?:{V.ASKED_WORD})", 0)

    def of(found: Expr, ends: Expr) -> Expr:
        one = lambda w, i: let(F.get(ends, i) - F.length(w), lambda a: let(F.trim(w, EDGE, "TRAILING"), lambda bare: F.struct(a.cast("int").alias("a"), (a + F.length(bare)).cast("int").alias("b"), bare.alias("word"))))
        return F.filter(F.transform(found, one), lambda w: worth_asking(w["word"]))

    return let(words, lambda found: let(running(F.transform(upto, lambda x: F.length(x).cast("long")), F.lit(0).cast("long")), lambda ends: of(found, ends)))


def standing_out(scores: Expr) -> Expr:
    """Whether a word is chosen: by its own score, or as one of the best of its request."""
    best = lambda i: F.array_max(F.slice(scores, F.floor(i / V.WORDS_PER_REQUEST).cast("int") * V.WORDS_PER_REQUEST + 1, V.WORDS_PER_REQUEST))
    return F.transform(scores, lambda p, i: (p >= V.MARK_AT) | (p >= V.MARK_FLOOR) & (p >= V.STANDOUT * best(i)))


def stitched(text: Expr, marks: Expr, asked: Expr) -> Expr:
    """Marks (a, b) in order become one stretch unless much, punctuation or a whole word that was asked and refused is between them."""

    def apart(end: Expr, start: Expr) -> Expr:
        refused = F.exists(asked, lambda w: (w["a"] >= end) & (w["b"] <= start))
        return (start >= end) & (refused | (start - end > V.STITCH_GAP) | F.substring(text, end + 1, start - end).rlike(V.STITCH_BREAK))

    def joined(own: Expr, reach: Expr) -> Expr:
        opens = F.filter(F.sequence(0, F.size(own) - 1), lambda k: (k == 0) | apart(F.get(reach, k - 1), F.get(own, k)["a"]))
        return let(opens, lambda o: F.transform(o, lambda k, j: F.struct(F.get(own, k)["a"].alias("start"), F.get(reach, F.coalesce(F.get(o, j + 1), F.size(own)) - 1).alias("end"))))

    ends = lambda own: F.transform(own, lambda m, k: F.array_max(F.transform(F.slice(own, 1, k + 1), lambda x: x["b"])))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return let(F.array_sort(marks), lambda own: F.when(F.size(own) == 0, none).otherwise(let(ends(own), lambda reach: joined(own, reach))))


def marked(df: DataFrame) -> DataFrame:
    """``df`` (with a sentence, text) with its asked words, which of them stand out by the stub's scores, and the stretches that these become."""
    df = staged(df, asked=asked_words(F.col("text")))
    df = staged(df, chosen=let(F.transform(F.col("asked"), lambda w, i: stub(F.concat(w["word"], "/", i.cast("string")))), standing_out))
    marks = F.transform(F.filter(F.transform(F.col("asked"), lambda w, i: F.struct(w["a"].alias("a"), w["b"].alias("b"), F.get(F.col("chosen"), i).alias("on"))), lambda m: m["on"]), lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b")))
    return staged(df, stretches=let(marks, lambda m: stitched(F.col("text"), m, F.col("asked"))))


def q_stitch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(S.col("doc_id").alias("page_id"), "text"))
    found = docs.select("page_id", S.posexplode(split(F.col("text")).column()).alias("sent_id", "text"))
    return marked(found).select("page_id", "sent_id", S.posexplode("stretches").alias("span_no", "s")).select("page_id", "sent_id", "span_no", "s.start", "s.end")


def q_pick_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line of a document how many of its asked words stand out, and the first and last of them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(S.col("doc_id").alias("page_id"), "text"))
    lines = docs.select("page_id", S.posexplode(S.split("text", "\n")).alias("sent_id", "text")).where("text <> ''")
    bare = F.transform(F.regexp_extract_all(F.col("text"), V.ASKED_WORD, 0), lambda w: F.trim(w, EDGE, "TRAILING"))
    scores = F.transform(F.filter(bare, worth_asking), lambda w, i: stub(F.concat(w, i.cast("string"), F.col("page_id").cast("string"))))
    places = lambda chosen: F.filter(F.transform(chosen, lambda on, i: F.when(on, i.cast("bigint"))), lambda i: i.isNotNull())
    found = staged(lines, marks=let(scores, lambda p: let(standing_out(p), places))).where("size(marks) > 0")
    return found.select("page_id", "sent_id", S.size("marks").cast("long").alias("marked"), S.get("marks", S.lit(0)).alias("first_word"), S.element_at("marks", -1).alias("last_word"))


QUERIES = {"pick_words": q_pick_words, "stitch_spans": q_stitch_spans}
