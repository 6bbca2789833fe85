"""Where pages come from, and what is known of each after one parse."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import sqltext as X
from gleaner.functions.hashes import fnv1a
from gleaner.functions.stream import ITEM, items
from gleaner.operators import dom
from gleaner.operators.judge import by_rows
from gleaner.plans import values as V

ADDRESS = re.compile(r"https?://(?:[^/?#@]*@)?(?P<host>\[[^\]]*\]|[^/?#:]*)(?::\d*)?(?P<path>[^?#]*)", re.IGNORECASE)
META = "title string, lang string, json_ld_types array<string>, og_type string, unlisted boolean, signed_in boolean, personal_form boolean, never boolean, app_like boolean"
STREAM = f"page_id long, url string, host string, path string, {META}, items array<{ITEM}>"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a web address; the filter reaches the scan before any page is parsed."""
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("url").startswith("http:") | F.col("url").startswith("https:")))


#: Bytes of a table for each part; for pages some seconds of work.
PART = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table in even parts, as many for each core, for work that costs far more than the shuffle.

    Where a file is split says nothing of where its rows are, as one task reads a whole row group; a table of many files stays as it is.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if min(len(df.inputFiles()), plan.toRdd().getNumPartitions()) >= 4 * cores:
        return df
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * max(1, -(-size // (PART * cores))))


def streams(scanned: DataFrame) -> DataFrame:
    """One row a page: its meta data, the signs of pages that are not to be read, and its stream of items. Each page is parsed once."""

    def work(rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            page = H.Page(row["html"] or "")
            where = ADDRESS.match(row["url"] or "")
            host, path = (where["host"].lower().removeprefix("www.").strip("[]"), where["path"]) if where else ("", "")
            out.append({"page_id": row["page_id"], "url": row["url"], "host": host, "path": path} | H.meta(page) | {"items": items(page)})
        return out

    return by_rows(scanned.select("page_id", "url", "html"), work, STREAM)


def parsed(scanned: DataFrame) -> DataFrame:
    """One row a page: its meta data, a sample of its text and its sentences."""
    found = dom.sentences(streams(scanned))
    sample = F.left(F.array_join(F.transform("sentences", lambda s: s["text"]), "\n"), F.lit(V.SAMPLE_CHARS))
    first = ["page_id", "url", "host", "path"]
    return found.select(*first, sample.alias("sample"), *[c for c in found.columns if c not in first])


def content_hash(df: DataFrame, sentences: str = "sentences") -> DataFrame:
    """``df`` with the hash of its sentences' texts, joined by line breaks."""
    return df.withColumn("content_hash", fnv1a(X.array_join(X.transform(X.col(sentences), lambda s: s["text"]), "\n")).column())
