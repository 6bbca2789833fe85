"""Judging pages through the cache: what is known by the hash of a page's sentences is not asked again.

Pages with one hash are one page: the first of them is asked, the others get its answer. What was asked and answered in full is put
into the cache, hits are touched, and the cache keeps the most recently used pages. All of it is joins on the hash; a hash
that many pages share is split by the engine as in any skewed join, and is cut to one row before anything is asked.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import cache
from gleaner.operators.judge import Judge
from gleaner.plans import values as V
from gleaner.sources.pages import content_hash
from gleaner.sources.store import Store

JUDGMENTS = "array<struct<sent_id: int, keep: double, kind: string, kind_conf: double, failed: boolean>>"
SCHEMA = f"content_hash string, tick long, page_kind string, page_kind_conf double, judgments {JUDGMENTS}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only in local mode, where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir()


def page_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, SCHEMA, ["content_hash"])


def answered(missing: DataFrame, judge: Judge, size: int) -> DataFrame:
    """(content_hash, page_kind, page_kind_conf, judgments, requests, tokens, error): one row for each page that was asked."""
    from gleaner.operators.pipeline import judged

    got = judged(missing, judge, size).where(F.size("judgments") > 0)
    parts = F.array_sort(F.collect_list(F.struct("chunk", "judgments")))
    return got.groupBy("content_hash").agg(
        F.max("page_kind").alias("page_kind"), F.max("page_kind_conf").alias("page_kind_conf"), F.flatten(F.transform(parts, lambda p: p["judgments"])).alias("judgments"),
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.first("error", ignorenulls=True).alias("error"),
    )


def judge_cached(found: DataFrame, judge: Judge, store: Store, tick: int, capacity: int = V.CACHE_PAGES, size: int = V.PER_REQUEST) -> DataFrame:
    """``found`` (guarded pages) with content_hash, cached, requests, tokens, error, page_kind, page_kind_conf and judgments; the store is brought up to date.

    A page that is not to be judged has no judgments and asks nothing. Pages with failed sentences stay out of the cache.
    """
    spark = found.sparkSession
    shared_folder(spark)
    # the parsed pages and the answers are used more than once; neither is worked out, or paid for, again
    pages = content_hash(found).checkpoint()
    known = store.read().checkpoint()
    asked = pages.where("status = 'judging'")
    order = Window.partitionBy("content_hash").orderBy("page_id")
    first = asked.join(known, "content_hash", "left_anti").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    new = answered(first, judge, size).checkpoint()
    whole = new.where(~F.exists("judgments", lambda j: j["failed"])).withColumn("tick", F.lit(tick).cast("long"))
    _, moved = cache.looked_up(known, asked.select("content_hash", F.lit(tick).cast("long").alias("tick")).distinct())
    columns = known.columns
    store.write(cache.kept(moved.select(*columns).unionByName(whole.select(*columns)), capacity))

    none = F.lit(0).cast("long")
    facts = known.select("content_hash", F.lit(True).alias("cached"), none.alias("requests"), none.alias("tokens"), F.lit(None).cast("string").alias("error"), "page_kind", "page_kind_conf", "judgments")
    facts = facts.unionByName(new.withColumn("cached", F.lit(False)))
    asks = F.when(~F.col("cached") & (F.row_number().over(order) == 1), F.col("requests")).otherwise(0)
    told = asked.join(facts, "content_hash", "left")
    told = told.withColumn("asks", asks).withColumn("tokens", F.when(F.col("asks") > 0, F.col("tokens")).otherwise(0)).drop("requests").withColumnRenamed("asks", "requests")
    rest = pages.where("status <> 'judging'")
    missing = {c: F.lit(None).cast(dict(told.dtypes)[c]).alias(c) for c in told.columns if c not in rest.columns} | {"cached": F.lit(False).alias("cached"), "requests": none.alias("requests"), "tokens": none.alias("tokens")}
    return told.unionByName(rest.select("*", *missing.values()))


def counts(judged: DataFrame, threshold: float = V.KEEP_AT) -> DataFrame:
    """(page_id, status, content_hash, cached, requests, kept, faded, failed) of pages judged through the cache."""
    number = lambda test: F.coalesce(F.size(F.filter("judgments", test)), F.lit(0))
    return judged.select(
        "page_id", "status", "content_hash", "cached", "requests", number(lambda j: ~j["failed"] & (j["keep"] >= threshold)).alias("kept"),
        number(lambda j: ~j["failed"] & (j["keep"] < threshold)).alias("faded"), number(lambda j: j["failed"]).alias("failed"),
    )
