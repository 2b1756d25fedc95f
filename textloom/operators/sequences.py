"""Order-dependent assignments: each work is one ordered walk, works run side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.romanise import romanised
from textloom.functions.text import squash
from textloom.operators.library import carried
from textloom.operators.reading import originals_once
from textloom.operators.search import ONCE, passages_once


def anchored(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """blocks (work_id, n, body), anchors (work_id, k, unit, at) -> (work_id, n, ref, apparatus): blocks under the unit of the last anchor before them.

    An anchor stands in the first block that begins with its words and comes after the first such
    blocks of all anchors before it (by k); one that stands nowhere is an error.  A null unit drops
    its block and what follows.  Blocks before any anchor are apparatus, null bodies are empty.
    Anchors meet blocks by work and first word; order is kept by windows over ranges of a work.
    """
    b = blocks.select("work_id", "n", squash(F.coalesce("body", F.lit(""))).alias("body")).withColumn("first", F.split("body", " ")[0])
    a = anchors.select("work_id", "k", "unit", squash(F.col("at")).alias("at")).withColumn("first", F.split("at", " ")[0])
    cut = F.contains("at", F.lit(" "))  # of several words the first is whole
    hits = a.filter(cut).join(b, ["work_id", "first"]).filter(F.startswith("body", "at")).select("work_id", "k", "n")
    short = a.filter(~cut).drop("first").join(b.drop("first"), "work_id").filter(F.startswith("body", "at")).select("work_id", "k", "n")
    hits = hits.unionByName(short)
    known = a.select("work_id", "k", "unit").join(hits.groupBy("work_id", "k").agg(F.min("n").alias("m")), ["work_id", "k"], "left")
    known = carried(known, "work_id", "k", ["k"], F.col("m"), "upto", largest=True)
    # the largest of those in front: one's own place counts only from the next one on
    known = known.withColumn("upto", F.coalesce(F.lag("upto").over(Window.partitionBy("work_id").orderBy("k")), F.lit(-1)))
    at = known.join(hits, ["work_id", "k"], "left").filter("n is null or n > upto").groupBy("work_id", "k", "unit").agg(F.min("n").alias("n"))
    at = known.select("work_id", "k", "unit").join(at.select("work_id", "k", "n"), ["work_id", "k"], "left")
    at = at.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.concat_ws(" ", F.lit("anchor not found:"), "work_id", "k")).cast("int")).otherwise(F.col("n")))
    begins = at.groupBy("work_id", "n").agg(F.max_by(F.struct("unit"), "k").alias("begin"))
    rows = carried(b.select("work_id", "n").join(begins, ["work_id", "n"], "left"), "work_id", "n", ["n"], F.col("begin"), "unit_of")
    return rows.select("work_id", "n", F.col("unit_of.unit").alias("ref"), F.col("unit_of.unit").isNull().alias("apparatus"))


def carried_readings(slots: DataFrame, events: DataFrame) -> DataFrame:
    """slots (book, unit, pos, char) and events (book, pos, char, reading, scope) -> slots + reading: an own event, else the last carried one of that character in scope (book or unit)."""
    s = slots.join(events.drop("char").select("book", "pos", "reading", "scope"), ["book", "pos"], "left")
    order = ["pos"]
    by_book = Window.partitionBy("book", "char").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by_unit = Window.partitionBy("book", "unit", "char").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    book = F.last(F.when(F.col("scope") == "book", F.col("reading")), ignorenulls=True).over(by_book)
    unit = F.last(F.when(F.col("scope") == "unit", F.col("reading")), ignorenulls=True).over(by_unit)
    return s.withColumn("reading", F.coalesce("reading", unit, book)).select("book", "unit", "pos", "char", "reading")


def pinyin(units: DataFrame, base: DataFrame, readings: DataFrame) -> DataFrame:
    """units (unit, body), base (char, pinyin, several), readings (unit, pos, char, pinyin) -> (unit, pinyin, open): transcription in order, `open` the polyphonic characters without a reading.

    A reading at another character than the text has is an error.
    """
    chars = units.select("unit", F.posexplode(F.split("body", "")).alias("pos", "char")).filter("char <> ''")
    r = readings.select("unit", "pos", F.col("char").alias("r_char"), F.col("pinyin").alias("r_pinyin"))
    joined = chars.join(r, ["unit", "pos"], "left").join(base, "char", "left")
    checked = F.when(F.col("r_char").isNotNull() & (F.col("r_char") != F.col("char")), F.raise_error(F.concat(F.lit("misplaced reading in "), "unit")))
    sound = F.coalesce(checked, F.col("r_pinyin"), F.col("pinyin"), F.col("char"))
    is_open = F.col("several") & F.col("r_pinyin").isNull()
    return joined.groupBy("unit").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", sound.alias("s")))), lambda x: x["s"]), " ").alias("pinyin"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_open, F.col("char")))), "").alias("open"),
    )


def complete(units: DataFrame, sources: DataFrame) -> DataFrame:
    """units (work_id, ref_unit, source_unit, ord) with the bodies of their source units joined in order; any that is missing is one error that names them all."""
    joined = units.join(sources.select("work_id", F.col("unit").alias("source_unit"), "body"), ["work_id", "source_unit"], "left")
    missing = joined.filter("body is null").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "work_id", "source_unit"))), ", ").alias("missing"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "\n")
    whole = joined.groupBy("work_id", "ref_unit").agg(body.alias("body"))
    checked = whole.join(F.broadcast(missing))  # one row
    return checked.withColumn("body", F.when(F.col("missing") != "", F.raise_error(F.concat(F.lit("missing units: "), "missing"))).otherwise(F.col("body"))).drop("missing")


# ---- queries ----------------------------------------------------------------------------------------


def romanised_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return originals_once(spark, sf_dir).select("id", "language", romanised(F.col("language"), F.col("body")).alias("romanised"))


def anchored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of passages found again from the opening words of each unit's first passage."""
    p = passages_once(spark, sf_dir).filter("not is_apparatus and ref_unit is not null and body is not null and length(body) > 0")
    p = p.groupBy("work_id", "position").agg(F.min(F.struct("id", "body", "ref_unit")).alias("p")).select("work_id", F.col("position").alias("n"), "p.body", "p.ref_unit")
    firsts = p.groupBy("work_id", "ref_unit").agg(F.min(F.struct("n", "body")).alias("f")).select("work_id", F.col("f.n").alias("k"), F.col("ref_unit").alias("unit"), F.substring(squash(F.col("f.body")), 1, 60).alias("at"))
    got = anchored(p.select("work_id", "n", "body"), firsts)
    return got.select("work_id", F.col("n").cast("bigint").alias("n"), "ref", "apparatus")


QUERIES = {"romanised_originals": romanised_originals, "anchored_units": anchored_units}

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ORACLES = {
    "anchored_units": f"""
  WITH {ONCE}, b AS (SELECT work_id, position AS n, trim(regexp_replace(arg_min(body, id), '{_WS}', ' ', 'g')) AS body, arg_min(ref_unit, id) AS ref_unit FROM pas WHERE NOT is_apparatus AND ref_unit IS NOT NULL AND length(body) > 0 GROUP BY ALL),
  a AS (SELECT work_id, ref_unit AS unit, min(n) AS k, substring(arg_min(body, n), 1, 60) AS opening FROM b GROUP BY ALL),
  h AS (SELECT a.work_id, k, unit, n FROM a JOIN b ON a.work_id = b.work_id AND starts_with(body, opening)),
  m0 AS (SELECT work_id, k, min(n) AS n FROM h GROUP BY work_id, k),
  m AS (SELECT work_id, k, coalesce(max(n) OVER (PARTITION BY work_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS upto FROM m0),
  c AS (SELECT h.work_id, h.k, h.unit, min(n) AS n FROM h JOIN m USING (work_id, k) WHERE n > upto GROUP BY ALL),
  s AS (SELECT work_id, n, arg_max(unit, k) AS unit FROM c GROUP BY ALL),
  r AS (SELECT b.work_id, b.n, last_value(s.unit IGNORE NULLS) OVER (PARTITION BY b.work_id ORDER BY b.n ROWS UNBOUNDED PRECEDING) AS ref FROM b LEFT JOIN s ON s.work_id = b.work_id AND s.n = b.n)
  SELECT work_id, n::BIGINT AS n, ref, ref IS NULL AS apparatus FROM r""",
}
