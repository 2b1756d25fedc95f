"""Writing the library: replaced works, caches, merged drafts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Pointers written to their end, oldest first."""
    fs, p = _file_system(spark, f"{root}/{POINTER}-*/_SUCCESS")
    return sorted(x.getPath().getParent().toString() for x in fs.globStatus(p) or [])


def current(spark: SparkSession, root: str) -> str | None:
    """The snapshot folder that readers use now: the newest pointer that is whole."""
    found = _pointers(spark, root)
    return spark.read.text(found[-1]).first()[0] if found else None


def _next(spark: SparkSession, root: str) -> int:
    found = _pointers(spark, root)
    return int(found[-1].rpartition("-")[2]) + 1 if found else 0


def replace_works(spark: SparkSession, root: str, new: dict[str, DataFrame], works: DataFrame, whole: bool = False) -> str:
    """A new snapshot of several tables in which the given works' rows are replaced, seen by readers all at once.

    Tables hold a work_id.  Everything is written under a new folder first; a new pointer is
    added last and counts once it is whole, so at every moment there is a snapshot to read.  Running twice gives the same
    tables.  `whole`: nothing of the old tables stays (they need no work_id).
    """
    old, folder = current(spark, root), f"{root}/snapshot-{uuid.uuid4().hex}"
    for name, rows in new.items():
        if old and not whole:
            kept = spark.read.parquet(f"{old}/{name}").join(works.select("work_id").distinct(), "work_id", "left_anti")
            rows = kept.select(rows.columns).unionByName(rows)
        rows.write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(folder,)], "value string").coalesce(1).write.text(f"{root}/{POINTER}-{_next(spark, root):012d}")
    return folder


def cached_values(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """A cache (model, hash, value) with fresh rows added; of two values for a hash the cached one stays."""
    return cache.unionByName(fresh.join(cache, ["model", "hash"], "left_anti")).dropDuplicates(["model", "hash"])


def indexed(passages: DataFrame, cache: DataFrame, model: str, column: str) -> DataFrame:
    """passages with `column` set from the cache by the hash of their body; null where the cache has none."""
    values = cache.filter(F.col("model") == model).select("hash", F.col("value").alias(column))
    return passages.drop(column).withColumn("hash", F.sha2(F.col("body").cast("binary"), 256)).join(values, "hash", "left").drop("hash")


def merged_drafts(drafts: DataFrame, present: DataFrame) -> DataFrame:
    """Readings (unit, pos, char, ...): a new draft wins unless the present entry was reviewed; present entries without a draft go."""
    key = ["unit", "pos", "char"]
    rest = [c for c in drafts.columns if c not in key]
    reviewed = present.filter("reviewed").select(*key, F.struct(*rest).alias("kept"))
    out = drafts.select(*key, F.struct(*rest).alias("draft")).join(reviewed, key, "left").withColumn("r", F.coalesce("kept", "draft"))
    return out.select(*key, "r.*")
