"""Readers for the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.shared import written

#: Keys delivered more than once are broadcast up to so many.
ROWS_SENT = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus directory, as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: of repeated deliveries the first by `order` (nulls last) is kept.

    Keys delivered more than once are counted from the key column alone.  If they are few enough to
    be broadcast, only their rows travel; else all rows do, reduced before the shuffle (min_by is a
    partial aggregate), so that a key of a third of all rows is no single task.  Rows with a null
    key are dropped.
    """
    rest = [c for c in df.columns if c != key]
    given = df.filter(F.col(key).isNotNull())
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.coalesce(F.col(order).cast("string"), F.lit("~")))

    def reduced(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(first.alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])

    again = written(given.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), "delivered-again")
    if again.count() > ROWS_SENT:
        return reduced(given)
    sent = F.broadcast(again)
    return given.join(sent, key, "left_anti").select(key, *rest).unionByName(reduced(given.join(sent, key, "left_semi")))
