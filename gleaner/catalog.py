"""All registered queries of the engine, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import oracle, oracle_pages, sql
from gleaner.plans.dialect import Duck, Spark

TABLES = ("pages", "documents", "labels", "events", "conversations")


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def planned(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(sql.PLANS[name](Spark()))

    return run


def queries() -> dict:
    from gleaner.operators import pipeline, quotations, stitching

    return {name: planned(name) for name in sql.PLANS} | pipeline.QUERIES | quotations.QUERIES | stitching.QUERIES


def oracle_sql() -> dict[str, str]:
    from gleaner.operators import pipeline

    # plans without SQL of their own for the check are checked by their text in the other dialect
    return {name: plan(Duck()) for name, plan in sql.PLANS.items() if name not in oracle.ORACLES} | oracle.ORACLES | oracle_pages.ORACLES | pipeline.ORACLES
