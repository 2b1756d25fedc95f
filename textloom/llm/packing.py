"""Filling containers of fixed capacity with documents.

The plan is made over the histogram of lengths (at most `capacity` rows a container size, however
many documents there are); documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.shared import broadcast_if_small, written
from textloom.sources.tables import table

TOKENIZER = os.environ.get("TEXTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte-level BPE vocabularies of this kind cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that one task ranks, and ranks that meet the runs of their length in one task, at most about so many.
PER_BUCKET = 100_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens); null and empty texts have 0 tokens.  The vocabulary file is sent to the executors from the driver's path."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for s in batches:
            yield s.map(lambda t: len(encode(t)) if t else 0)

    return df.select(F.col(key), F.coalesce(F.pandas_udf(count, "int")(F.coalesce(F.col(text), F.lit(""))), F.lit(0)).alias("n_tokens"))


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts -> runs (length, first_rank, n_items, per_container, first_container, n_containers).

    A container takes the longest length left, then again and again the longest that still fits.
    The same filling is repeated as often as the counts allow, so the number of fillings follows
    the number of different lengths, not of documents.
    """
    order = np.argsort(lengths)
    size = [int(x) for x in lengths[order]]
    left = [int(x) for x in counts[order]]
    used = [0] * len(size)
    below = list(range(-1, len(size) - 1))  # nearest shorter length that may have items left

    def longest(k: int) -> int:
        """The nearest length at or under k with items left, -1 if none (paths are shortened)."""
        path = []
        while k >= 0 and not left[k]:
            path.append(k)
            k = below[k]
        for p in path:
            below[p] = k
        return k

    at = np.array(size)
    runs, container = [], 0
    top = longest(len(size) - 1)
    while top >= 0:
        room, filling, k = capacity, [], top
        while k >= 0 and room > 0:
            many = min(left[k], room // size[k])
            filling.append((k, many))
            room -= many * size[k]
            k = longest(min(k - 1, int(np.searchsorted(at, room, side="right")) - 1))
        times = min(left[k] // many for k, many in filling)
        for k, many in filling:
            runs.append((size[k], used[k], times * many, many, container, times))
            used[k] += times * many
            left[k] -= times * many
        container += times
        top = longest(top)
    return runs


RUN = "capacity_id int, length int, first_rank bigint, n_items bigint, per_container int, first_container bigint, n_containers bigint"


def _plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    part = pdf[pdf["length"] > 0]
    runs = plan_containers(part["length"].to_numpy(), part["n"].to_numpy(), int(pdf["capacity_tokens"].iloc[0])) if len(part) else []
    out = pd.DataFrame(runs, columns=["length", "first_rank", "n_items", "per_container", "first_container", "n_containers"])
    empty = pdf.loc[pdf["length"] == 0, "n"].sum()
    if empty:  # documents without tokens go round over the containers; one container if there is no other
        total = int((out["first_container"] + out["n_containers"]).max()) if len(out) else 1
        many = -(-int(empty) // total)
        out.loc[len(out)] = (0, 0, int(empty), many, 0, total)
    out.insert(0, "capacity_id", key[0])
    return out


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(capacity_id, container_id, key, piece_no, token_start, n_tokens): a place for every document, for every capacity.

    sizes: (key, n_tokens).  A document longer than the container is cut into full containers and
    one rest, which is packed like a document of that length; no other is cut.  Documents of no
    tokens get a place too.  Null keys or sizes and capacities under one token are left out; equal
    sizes rank by key; rows with equal keys are packed each for itself.
    """
    caps = broadcast_if_small(capacities.filter("capacity_tokens >= 1").select("capacity_id", "capacity_tokens").distinct())
    known = sizes.filter(F.col(key).isNotNull() & F.col("n_tokens").isNotNull()).select(key, "n_tokens")
    buckets = -(-known.count() // PER_BUCKET) or 1
    items = known.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).crossJoin(caps)  # every document for every container size
    pieces = items.withColumn("full", F.expr("n_tokens div capacity_tokens")).withColumn("rest", F.expr("cast(n_tokens % capacity_tokens as int)"))
    # every document brings at most one piece that shares a container; full pieces have one each
    shared = pieces.filter("rest > 0 or full = 0").select("capacity_id", "capacity_tokens", key, F.col("full").cast("int").alias("piece_no"), F.col("rest").alias("length"), "bucket")
    by_bucket = written(shared.groupBy("capacity_id", "capacity_tokens", "length", "bucket").agg(F.count("*").alias("n")), "length-histogram")
    histogram = by_bucket.groupBy("capacity_id", "capacity_tokens", "length").agg(F.sum("n").alias("n"))  # at most capacity_tokens rows a container size
    runs = written(histogram.groupBy("capacity_id").applyInPandas(_plan, RUN), "container-plan")

    # Rank within the length: a bucket's offset plus the rank inside the bucket, so that a length of a third of all documents is ranked by many tasks.
    # The offsets are joined by the keys that the ranks are partitioned by anyway.
    before = Window.partitionBy("capacity_id", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("capacity_id", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Runs of a length and its documents meet in blocks of ranks, as many blocks as runs and none over PER_BUCKET: documents x runs that meet are at most twice the documents.
    step = runs.groupBy("capacity_id", "length").agg(F.least(F.ceil(F.sum("n_items") / F.count("*")), F.lit(PER_BUCKET)).alias("step"))
    offsets = offsets.join(step.hint("merge"), ["capacity_id", "length"])
    inside = Window.partitionBy("capacity_id", "length", "bucket").orderBy(key, "piece_no")
    ranked = (
        shared.withColumn("r", F.row_number().over(inside) - 1)
        .join(offsets.hint("merge"), ["capacity_id", "length", "bucket"])
        .withColumn("rank", F.col("r") + F.col("offset"))
        .withColumn("block", F.expr("rank div step"))
    )
    spread = runs.join(step.hint("merge"), ["capacity_id", "length"]).withColumn("block", F.explode(F.expr("sequence(first_rank div step, (first_rank + n_items - 1) div step)"))).drop("step")
    placed = ranked.join(spread.hint("merge"), ["capacity_id", "length", "block"]).filter("rank >= first_rank and rank < first_rank + n_items")
    placed = placed.select(
        "capacity_id", F.expr("first_container + (rank - first_rank) div per_container").alias("container_id"), key, "piece_no",
        F.expr("piece_no * capacity_tokens").cast("int").alias("token_start"), F.col("length").alias("n_tokens"),
    )

    # Full pieces: containers after the planned ones, numbered by bucket offset and running sum of full pieces.
    whole = pieces.filter("full > 0")
    sums = whole.groupBy("capacity_id", "bucket").agg(F.sum("full").alias("n"))
    planned = runs.groupBy("capacity_id").agg(F.max(F.col("first_container") + F.col("n_containers")).alias("planned"))
    prior = Window.partitionBy("capacity_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("offset", F.coalesce(F.sum("n").over(prior), F.lit(0))).join(planned.hint("merge"), "capacity_id", "left")
    starts = starts.select("capacity_id", "bucket", (F.col("offset") + F.coalesce("planned", F.lit(0))).alias("offset"))
    running = Window.partitionBy("capacity_id", "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    alone = (
        whole.withColumn("r", F.coalesce(F.sum("full").over(running), F.lit(0)))
        .join(starts.hint("merge"), ["capacity_id", "bucket"])
        .select("capacity_id", "capacity_tokens", key, (F.col("offset") + F.col("r")).alias("c0"), F.explode(F.expr("sequence(0, cast(full as int) - 1)")).alias("piece_no"))
        .select("capacity_id", (F.col("c0") + F.col("piece_no")).alias("container_id"), key, "piece_no", F.expr("piece_no * capacity_tokens").cast("int").alias("token_start"), F.col("capacity_tokens").alias("n_tokens"))
    )
    return placed.unionByName(alone)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "token-counts")
    return pack(sizes, table(spark, sf_dir, "capacities"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each capacity is filled; least = the containers that any packing needs at least."""
    caps = table(spark, sf_dir, "capacities")
    by = _packed(spark, sf_dir).groupBy("capacity_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"))
    return by.join(F.broadcast(caps), "capacity_id").select("capacity_id", "capacity_tokens", "n_containers", "n_tokens", "n_documents", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"))


def p6_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any packing must keep, for each capacity: documents that have a place, containers over their capacity, documents cut though they fit, pieces that leave a gap or overlap."""
    packed = written(_packed(spark, sf_dir), "packed")
    caps = broadcast_if_small(table(spark, sf_dir, "capacities").select("capacity_id", "capacity_tokens"))
    over = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(caps, "capacity_id").groupBy("capacity_id").agg(F.count_if(F.expr("n > capacity_tokens")).alias("n_overfull"))
    docs = packed.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.countDistinct("piece_no").alias("numbers"))
    docs = docs.join(caps, "capacity_id").groupBy("capacity_id", "capacity_tokens").agg(
        F.count("*").alias("n_documents"), F.count_if(F.expr("k > 1 and n <= capacity_tokens")).alias("n_needless_cuts"), F.count_if(F.expr("n <> end or k <> numbers")).alias("n_broken")
    )
    return docs.join(over, "capacity_id").select("capacity_id", "capacity_tokens", "n_documents", "n_overfull", "n_needless_cuts", "n_broken")


PROPERTIES_SQL = """
    SELECT capacity_id, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_needless_cuts, 0::BIGINT AS n_broken
    FROM capacities"""
