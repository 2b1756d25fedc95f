"""The usage log: counts, retention, rate limits, drift of imports; batch forms (streams: textloom.streaming.usage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.sources.tables import table

RETENTION_DAYS, CALLS_A_MINUTE, SEARCHES_A_DAY = 30, 30, 200


def log_once(log: DataFrame) -> DataFrame:
    """Each logged call once: exact duplicates go; of rows delivered again under an id the one received first stays."""
    rest = [c for c in log.columns if c not in ("id", "received_at")]
    first = F.min(F.struct("received_at", *rest))
    return log.filter("id is not null").groupBy("id").agg(first.alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in ("received_at", *rest)])


def retained(log: DataFrame, now: Column) -> DataFrame:
    """Queries of rows older than RETENTION_DAYS become their SHA-256; hashing again changes nothing."""
    old = (F.col("at") < now - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")) & F.col("query").isNotNull()
    hashed = F.when(old, F.sha2(F.col("query").cast("binary"), 256)).otherwise(F.col("query_hash"))
    return log.withColumn("query_hash", hashed).withColumn("query", F.when(~old, F.col("query")))


def over_limit(calls: DataFrame, client: str, at: str, limit: int, unit: str) -> DataFrame:
    """calls + (nth, rejected): the nth call of a client in its calendar minute or day.

    Fixed windows of the calendar, an approximation of windows that begin with a client's first
    call.  A window holds one client's calls of one minute or day, so a busy client is many groups.
    """
    w = Window.partitionBy(client, F.date_trunc(unit, F.col(at))).orderBy(at, "id")
    return calls.withColumn("nth", F.row_number().over(w)).withColumn("rejected", F.col("nth") > limit)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_once(table(spark, sf_dir, "usage_log"))


def usage_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("tool").agg(
        F.count("*").alias("n"), F.sum("hits").alias("hits"), F.max("duration_ms").cast("bigint").alias("slowest_ms"),
        F.count(F.when(F.col("keyword_only"), 1)).alias("n_degraded"), F.sum("embedding_tokens").alias("tokens"), F.countDistinct("client").alias("n_clients"),
    )


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "tool").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


def retention_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the newest call."""
    log = _log(spark, sf_dir)
    newest = log.agg(F.max("at").alias("now"))
    return retained(log.join(F.broadcast(newest)), F.col("now")).select("id", "query", "query_hash")


def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retention_hash(spark, sf_dir)
    return kept.agg(F.count("*").alias("n"), F.count("query").alias("n_plain"), F.count("query_hash").alias("n_hashed"))


def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's calls, those beyond a limit of 1 a minute, and the most it made in a minute."""
    got = over_limit(_log(spark, sf_dir).select("id", "client", "at"), "client", "at", 1, "minute")
    return got.groupBy("client").agg(F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected"), F.max("nth").cast("bigint").alias("most"))


def rate_limit_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by day beyond a limit of 3; only searches count."""
    got = over_limit(_log(spark, sf_dir).filter("tool = 'search_passages'").select("id", "client", "at"), "client", "at", 3, "day")
    return got.filter("rejected").select("id", "client", F.col("nth").cast("bigint").alias("nth"))


def rate_limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected share by event type at 2 events a user and minute."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    got = over_limit(ev, "user_id", "ts", 2, "minute")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("rejected"), 1)).alias("n_rejected"))


def most_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each passage was returned, with its work (the part of the id in front of the colon)."""
    ids = _log(spark, sf_dir).filter("passage_ids is not null").select(F.explode(F.from_json("passage_ids", "array<string>")).alias("pid"))
    return ids.filter("pid is not null").groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.split("pid", ":")[0].alias("work_id"), "n")


def import_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose newest import differs from the present passages: blocks missing on either side and blocks whose text is no longer part of the passage."""
    snap = table(spark, sf_dir, "imported_passages")
    newest = snap.agg(F.max("snapshot_no").alias("newest"))
    up = snap.join(F.broadcast(newest)).filter("snapshot_no = newest").select("work_id", "block", "raw").groupBy("work_id", "block").agg(F.min("raw").alias("raw"))
    here = table(spark, sf_dir, "passages").filter("work_id is not null").select("work_id", F.regexp_extract("id", r":(\d+)", 1).cast("int").alias("block"), "body").groupBy("work_id", "block").agg(F.min("body").alias("body"))
    both = up.join(here, ["work_id", "block"], "full")
    edited = F.col("raw").isNotNull() & F.col("body").isNotNull() & ~F.contains("body", "raw")
    by = both.groupBy("work_id").agg(
        F.count("raw").alias("n_imported"), F.count("body").alias("n_here"), (F.max(F.when(F.col("raw").isNotNull(), F.col("block"))) + 1).cast("bigint").alias("blocks_imported"), F.count(F.when(edited, 1)).alias("n_edited")
    )
    return by.filter("n_imported <> n_here or n_edited > 0")


def new_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of the newest delivery whose title is no work of the catalogue."""
    snap = table(spark, sf_dir, "wcw_records")
    newest = snap.agg(F.max("snapshot_no").alias("newest"))
    rec = snap.join(F.broadcast(newest)).filter("snapshot_no = newest and kind = 'full-text'").select("slug", "title", "author").distinct()
    works = table(spark, sf_dir, "works").select(F.lower("title").alias("t"))
    return rec.join(works, F.lower(F.trim("title")) == F.col("t"), "left_anti").groupBy("slug").agg(F.min("title").alias("title"), F.min("author").alias("author"))


QUERIES = {
    "usage_by_tool": usage_by_tool, "usage_by_day": usage_by_day, "retention_hash": retention_hash, "retention_counts": retention_counts, "rate_limit_minute": rate_limit_minute,
    "rate_limit_day": rate_limit_day, "rate_limit_events": rate_limit_events, "most_read": most_read, "import_drift": import_drift, "new_works": new_works,
}

_LOG = "lg AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS rn FROM usage_log WHERE id IS NOT NULL) WHERE rn = 1)"
_KEPT = f'''WITH {_LOG}, k AS (SELECT id, CASE WHEN "at" < (SELECT max("at") FROM lg) - INTERVAL 30 DAY AND query IS NOT NULL THEN NULL ELSE query END AS query, CASE WHEN "at" < (SELECT max("at") FROM lg) - INTERVAL 30 DAY AND query IS NOT NULL THEN sha256(query) ELSE query_hash END AS query_hash FROM lg)'''
ORACLES = {
    "usage_by_tool": f"WITH {_LOG} SELECT tool, count(*) AS n, sum(hits)::BIGINT AS hits, max(duration_ms)::BIGINT AS slowest_ms, count(*) FILTER (WHERE keyword_only) AS n_degraded, sum(embedding_tokens)::BIGINT AS tokens, count(DISTINCT client) AS n_clients FROM lg GROUP BY tool",
    "usage_by_day": f'''WITH {_LOG} SELECT strftime("at", '%Y-%m-%d') AS day, tool, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms FROM lg GROUP BY ALL''',
    "retention_hash": f"{_KEPT} SELECT * FROM k",
    "retention_counts": f"{_KEPT} SELECT count(*) AS n, count(query) AS n_plain, count(query_hash) AS n_hashed FROM k",
    "rate_limit_minute": f'''WITH {_LOG}, x AS (SELECT id, client, row_number() OVER (PARTITION BY client, date_trunc('minute', "at") ORDER BY "at", id) AS nth FROM lg) SELECT client, count(*) AS n, count(*) FILTER (WHERE nth > 1) AS n_rejected, max(nth) AS most FROM x GROUP BY client''',
    "rate_limit_day": f'''WITH {_LOG}, x AS (SELECT id, client, row_number() OVER (PARTITION BY client, date_trunc('day', "at") ORDER BY "at", id) AS nth FROM lg WHERE tool = 'search_passages') SELECT * FROM x WHERE nth > 3''',
    "rate_limit_events": "WITH x AS (SELECT event_type, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS nth FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE nth > 2) AS n_rejected FROM x GROUP BY event_type",
    "most_read": f"WITH {_LOG}, x AS (SELECT unnest(from_json(passage_ids, '[\"VARCHAR\"]')) AS pid FROM lg WHERE passage_ids IS NOT NULL) SELECT pid, split_part(pid, ':', 1) AS work_id, count(*) AS n FROM x WHERE pid IS NOT NULL GROUP BY pid",
    "import_drift": "WITH up AS (SELECT work_id, block, min(raw) AS raw FROM imported_passages WHERE snapshot_no = (SELECT max(snapshot_no) FROM imported_passages) GROUP BY ALL), he AS (SELECT work_id, CAST(regexp_extract(id, ':(\\d+)', 1) AS INT) AS block, min(body) AS body FROM passages WHERE work_id IS NOT NULL GROUP BY ALL), b AS (SELECT coalesce(up.work_id, he.work_id) AS work_id, up.block AS ub, raw, body FROM up FULL JOIN he ON up.work_id = he.work_id AND up.block = he.block), r AS (SELECT work_id, count(raw) AS n_imported, count(body) AS n_here, (max(CASE WHEN raw IS NOT NULL THEN ub END) + 1)::BIGINT AS blocks_imported, count(*) FILTER (WHERE raw IS NOT NULL AND body IS NOT NULL AND NOT contains(body, raw)) AS n_edited FROM b GROUP BY work_id) SELECT * FROM r WHERE n_imported <> n_here OR n_edited > 0",
    "new_works": "SELECT slug, min(title) AS title, min(author) AS author FROM wcw_records WHERE snapshot_no = (SELECT max(snapshot_no) FROM wcw_records) AND kind = 'full-text' AND lower(trim(title)) NOT IN (SELECT lower(title) FROM works) GROUP BY slug",
}
