"""The usage log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.usage import CALLS_A_MINUTE

LATE = "3 days"


def deduplicated(log: DataFrame, late: str = LATE) -> DataFrame:
    """Calls once each, though delivered again or up to `late` late; later ones are dropped by the watermark."""
    return log.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def calls_by_minute(log: DataFrame, limit: int = CALLS_A_MINUTE, late: str = LATE) -> DataFrame:
    """(client, minute, n, n_rejected) of each client's calls in tumbling minutes, put out when a minute can no longer change."""
    windowed = deduplicated(log, late).groupBy(F.window("at", "1 minute"), "client").agg(F.count("*").alias("n"))
    return windowed.select("client", F.col("window.start").alias("minute"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("n_rejected"))


def append_log(log: DataFrame, path: str, checkpoint: str):
    """Writes arriving calls to a log by day of call; a batch that is delivered again replaces nothing and adds nothing.

    The file sink commits each batch once; `available now` runs what has arrived and ends, as a
    scheduled job does.
    """
    daily = deduplicated(log).withColumn("day", F.to_date("at"))
    return daily.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
