"""Where intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most so many bytes may be broadcast; beyond that a join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where none is set, one machine (a local master, as in tests) gets a temporary folder; a cluster
    is refused, since a folder of each machine's own would give wrong results.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-textloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, survives lost executors, has known size for the planner."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application; to be called when its results have been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if it takes at most `limit` bytes as 8-byte columns, else as it is."""
    rows = df.count()
    return F.broadcast(df) if rows * (8 * len(df.columns) + 16) <= limit else df


def hash_sample(df: DataFrame, keys: list[str], n: int, total: int) -> DataFrame:
    """About n of the `total` rows of df, those of least key hash: a filter, so nothing is ordered or gathered.  All rows if there are no more than n."""
    if total <= n:
        return df
    bits = (1 << 31) - 1
    return df.filter(F.xxhash64(*keys).bitwiseAND(F.lit(bits)) < F.lit(max(1, round(n / total * bits))))
