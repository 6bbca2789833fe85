"""Judgments by the hash of a page's sentences: kept, touched, extended and let go.

Tables: pages (content_hash, tick, page_kind, failed), judgments by sentence, rule results (content_hash, rule, sent_id, p)
and spans (content_hash, term, sent_id, span_no, start, end, version). A tick is a logical time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans import values as V


def admitted(judgments: DataFrame) -> DataFrame:
    """Hashes of whole pages without failed sentences: (content_hash, sent_id, failed, full_page); pages where nothing was judged stay out."""
    per = judgments.groupBy("content_hash").agg(F.min("full_page").alias("full"), F.max("failed").alias("any_failed"))
    return per.where("full AND NOT any_failed").select("content_hash")


def kept(pages: DataFrame, capacity: int = V.CACHE_PAGES) -> DataFrame:
    """The most recently used pages; later rows of a hash count."""
    latest = pages.groupBy("content_hash").agg(F.max_by(F.struct(*pages.columns), "tick").alias("page")).select("page.*")
    return latest.orderBy(F.col("tick").desc(), "content_hash").limit(capacity)


def put(pages: DataFrame, new: DataFrame, capacity: int = V.CACHE_PAGES) -> DataFrame:
    """The cache after ``new`` pages of which something was judged."""
    return kept(pages.unionByName(new.where("judged > 0").select(*pages.columns)), capacity)


def after_refusal(pages: DataFrame) -> DataFrame:
    """The newer half, for another attempt at a write that the store refused."""
    return kept(pages, -(-pages.count() // 2))


def looked_up(pages: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked with ``cached``, the cache with hits touched at their tick): asked is content_hash, tick."""
    first = asked.groupBy("content_hash").agg(F.max("tick").alias("touched"))
    hits = asked.join(pages.select("content_hash", F.lit(True).alias("hit")), "content_hash", "left").select(*asked.columns, F.coalesce("hit", F.lit(False)).alias("cached"))
    moved = pages.join(first, "content_hash", "left").withColumn("tick", F.greatest("tick", F.coalesce("touched", "tick"))).select(*pages.columns)
    return hits, moved


def merged_rules(pages: DataFrame, rules: DataFrame, more: DataFrame) -> DataFrame:
    """Rule results with more of them for pages that are kept; a rule's results of a page are replaced as a whole. No page is touched."""
    new = more.join(pages.select("content_hash"), "content_hash", "left_semi")
    return rules.join(new.select("content_hash", "rule").distinct(), ["content_hash", "rule"], "left_anti").unionByName(new.select(*rules.columns))


def merged_highlights(pages: DataFrame, spans: DataFrame, more: DataFrame, version: int = V.SPANS_VERSION) -> DataFrame:
    """Spans with more of them; spans of another version are let go, a term's spans of a page are replaced as a whole."""
    new = more.join(pages.select("content_hash"), "content_hash", "left_semi").withColumn("version", F.lit(version))
    current = spans.where(F.col("version") == version)
    return current.join(new.select("content_hash", "term").distinct(), ["content_hash", "term"], "left_anti").unionByName(new.select(*spans.columns))


def missing(active: DataFrame, answered: DataFrame, on: list[str]) -> DataFrame:
    """What has to be asked: active items of a page that have no answer yet."""
    return active.join(answered.select(*on).distinct(), on, "left_anti")


def recent(requests: DataFrame, capacity: int = V.RECENT) -> DataFrame:
    """The sentences of the latest requests, kept so that rules added later need no page again."""
    last = requests.groupBy("content_hash").agg(F.max("tick").alias("last")).orderBy(F.col("last").desc(), "content_hash").limit(capacity)
    order = Window.partitionBy("content_hash").orderBy(F.col("tick").desc())
    newest = requests.withColumn("place", F.dense_rank().over(order)).where("place = 1").drop("place")
    return newest.join(F.broadcast(last.select("content_hash")), "content_hash", "left_semi")  # at most ``capacity`` hashes
