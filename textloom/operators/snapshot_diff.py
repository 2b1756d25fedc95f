"""What changed between full snapshots of a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.sources.tables import table

#: Keys (over all snapshots) that one numpy task sorts at a time: 40 bytes each.
BUCKET_ROWS = 1_000_000


def squashed(c: Column) -> Column:
    """Runs of white space of any kind as one space, none at either end."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _sorted_keys(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    k = np.empty(len(part), dtype=[("a", ">i8"), ("b", ">i8")])
    k["a"], k["b"] = part["kh"].to_numpy(), part["kh2"].to_numpy()
    keys = k.view("S16")
    order = np.argsort(keys)
    return order, keys[order]


def _bucket_changes(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of compact rows -> the keys that differ between each snapshot and the next."""
    found = []
    pairs = pd.concat([
        pdf[["snapshot_no", "next_no"]].dropna().rename(columns={"snapshot_no": "a", "next_no": "b"}),
        pdf[["prev_no", "snapshot_no"]].dropna().rename(columns={"prev_no": "a", "snapshot_no": "b"}),
    ]).drop_duplicates()
    parts = {no: part for no, part in pdf.groupby("snapshot_no")}
    ready = {no: _sorted_keys(part) for no, part in parts.items()}
    none = (np.zeros(0, np.int64), np.zeros(0, "S16"))
    for a, b in pairs.itertuples(index=False):
        (old_order, old), (new_order, new) = ready.get(a, none), ready.get(b, none)
        at = np.searchsorted(old, new)
        same = np.zeros(len(new), bool)
        if len(old):
            inside = at < len(old)
            same[inside] = old[at[inside]] == new[inside]
        back = np.searchsorted(new, old)
        gone = np.ones(len(old), bool)
        if len(new):
            inside = back < len(new)
            gone[inside] = new[back[inside]] != old[inside]
        if same.any():
            was = parts[a]["rh"].to_numpy()[old_order[at[same]]]
            now = parts[b]["rh"].to_numpy()[new_order[same]]
            differ = np.nonzero(same)[0][was != now]
            found.append(parts[b].iloc[new_order[differ]].assign(change="changed", later=b))
        if len(new):
            found.append(parts[b].iloc[new_order[~same]].assign(change="added", later=b))
        if len(old):
            found.append(parts[a].iloc[old_order[gone]].assign(change="removed", later=b))
    cols = ["snapshot_no", "kh", "kh2", "later", "change"]
    found.append(pdf.iloc[:0].assign(change="", later=0))  # the columns' types, where nothing changed
    return pd.concat([f for f in found if len(f)] or found[-1:])[cols].astype({"later": "int32"})


def snapshot_changes(df: DataFrame, key: str, ignore: tuple[str, ...] = ("delivered_at",), rows: int | None = None) -> DataFrame:
    """(snapshot_no, rec_key, change) for each snapshot after the first, against the next lower number present.

    Compared are all columns but the key, snapshot_no and `ignore`: strings by their squashed form,
    null equal only to null.  A key delivered several times in a snapshot counts once, with the row
    delivered last (of equally late ones the one with the least row hash).  Rows whose key or
    snapshot number is null belong to no record.  An empty table, or one snapshot, has no changes.
    `rows` (default: a count) only sets the number of buckets.
    """
    rest = [f for f in df.schema if f.name not in {key, "snapshot_no", *ignore}]
    value = [squashed(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in rest]
    # a null and its absence are told apart by the string of null flags
    flags = F.concat(F.lit(""), *[F.when(F.col(f"`{f.name}`").isNull(), "0").otherwise("1") for f in rest])
    given = df.filter(F.col(key).isNotNull() & F.col("snapshot_no").isNotNull())
    compact = given.select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        F.xxhash64(F.col(key)).alias("kh"), F.xxhash64(F.col(key), F.lit(1)).alias("kh2"),
        F.xxhash64(*value, flags).alias("rh"),
        (F.col("delivered_at") if "delivered_at" in df.columns else F.lit(None).cast("timestamp")).alias("at"),
    )
    once = compact.groupBy("snapshot_no", "kh", "kh2").agg(F.max_by("rh", F.struct("at", -F.col("rh"))).alias("rh"))

    numbers = given.select(F.col("snapshot_no").cast("int").alias("snapshot_no")).distinct()  # as many rows as snapshots
    w = Window.orderBy("snapshot_no")
    numbers = numbers.withColumn("next_no", F.lead("snapshot_no").over(w)).withColumn("prev_no", F.lag("snapshot_no").over(w))

    buckets = max(1, -(-(df.count() if rows is None else rows) // BUCKET_ROWS) * 2)
    buckets = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    changes = (
        once.join(F.broadcast(numbers), "snapshot_no")
        .withColumn("bucket", F.pmod("kh", F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(lambda _, pdf: _bucket_changes(pdf), "snapshot_no int, kh bigint, kh2 bigint, later int, change string")
    )
    # the key itself is fetched only for what differs
    names = given.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), F.xxhash64(F.col(key)).alias("kh"), F.xxhash64(F.col(key), F.lit(1)).alias("kh2"), F.col(key).alias("rec_key"))
    return (
        names.join(changes, ["snapshot_no", "kh", "kh2"])
        .select(F.col("later").alias("snapshot_no"), "rec_key", "change")
        .distinct()
    )


def change_values(df: DataFrame, key: str, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The changes with the later row's values (of a removed record: the earlier row's).

    Repeated deliveries give the one delivered last.
    """
    w = Window.orderBy("snapshot_no")
    numbers = df.select("snapshot_no").filter("snapshot_no is not null").distinct()
    numbers = numbers.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), F.lag(F.col("snapshot_no").cast("int")).over(w).alias("earlier"))
    at = changes.join(F.broadcast(numbers), "snapshot_no").withColumn("at_no", F.when(F.col("change") == "removed", F.col("earlier")).otherwise(F.col("snapshot_no")))
    rows = df.select(F.col("snapshot_no").cast("int").alias("at_no"), F.col(key).alias("rec_key"), F.struct("delivered_at", *columns).alias("row"))
    last = at.join(rows, ["at_no", "rec_key"]).groupBy("snapshot_no", "rec_key", "change").agg(F.max("row").alias("row"))
    return last.select("snapshot_no", "rec_key", "change", *[F.col(f"row.`{c}`").alias(c) for c in columns])


SNAPSHOT_TABLES = (("wcw_records", "slug"), ("imported_passages", "id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [snapshot_changes(table(spark, sf_dir, name), key).select(F.lit(name).alias("table_name"), "snapshot_no", "rec_key", "change") for name, key in SNAPSHOT_TABLES]
    return parts[0].unionByName(parts[1])


def p5_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by table, snapshot and kind."""
    return p5_found(spark, sf_dir).groupBy("table_name", "snapshot_no", "change").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_change_counts": p5_change_counts}

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _changes_sql(name: str, key: str, cols: list[str]) -> str:
    row = ", ".join(f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')) AS {c}" if c != "block" else c for c in cols)
    differs = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in cols)
    return f"""
      SELECT '{name}' AS table_name, coalesce(b.snapshot_no, a.next_no) AS snapshot_no, coalesce(b.k, a.k) AS rec_key,
             CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM (SELECT r.*, n.next_no FROM {name}_rows r JOIN {name}_numbers n USING (snapshot_no) WHERE n.next_no IS NOT NULL) a
      FULL JOIN (SELECT r.*, n.prev_no FROM {name}_rows r JOIN {name}_numbers n USING (snapshot_no) WHERE n.prev_no IS NOT NULL) b
        ON a.k = b.k AND a.next_no = b.snapshot_no
      WHERE a.k IS NULL OR b.k IS NULL OR {differs}"""


def _with_sql(name: str, key: str, cols: list[str]) -> str:
    row = ", ".join(f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')) AS {c}" if c != "block" else c for c in cols)
    return f"""{name}_rows AS (SELECT snapshot_no, {key} AS k, {row} FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, {key} ORDER BY delivered_at DESC) AS rn FROM {name}) WHERE rn = 1),
      {name}_numbers AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev_no FROM (SELECT DISTINCT snapshot_no FROM {name}))"""


_COLS = {"wcw_records": ["title", "author", "translator", "tradition", "kind", "text"], "imported_passages": ["work_id", "block", "raw"]}
_WITH = "WITH " + ", ".join(_with_sql(n, k, _COLS[n]) for n, k in SNAPSHOT_TABLES)
_FOUND = " UNION ALL ".join(_changes_sql(n, k, _COLS[n]) for n, k in SNAPSHOT_TABLES)
ORACLES = {
    "p5_found": f"{_WITH} {_FOUND}",
    "p5_change_counts": f"{_WITH} SELECT table_name, snapshot_no, change, count(*) AS n FROM ({_FOUND}) GROUP BY ALL",
}
