"""Main text of works, parts of blocks, characters of originals, counts of imports, and the stored concept graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import squash
from textloom.operators.library import _concepts, _edges, segments_once
from textloom.operators.reading import originals_once
from textloom.operators.search import ONCE, passages_once, searchable
from textloom.operators.sinks import replace_works
from textloom.sources.tables import table

# ---- main text and parts --------------------------------------------------------------------------


def main_text(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """blocks (work_id, n, raw) + inside: from the first block that matches its work's `start` up to the next later one that matches `end`.

    bounds: (work_id, start, end), regular expressions over the trimmed block, end null for none.  A
    work whose start is not found is an error; a work without bounds is inside throughout.  Null
    blocks match nothing.
    """
    marked = blocks.join(bounds, "work_id").withColumn("_t", squash(F.col("raw")))
    begins = marked.groupBy("work_id").agg(F.min(F.when(F.rlike("_t", F.col("start")), F.col("n"))).alias("_a"))
    later = marked.join(begins, "work_id").filter("n > _a").groupBy("work_id").agg(F.min(F.when(F.rlike("_t", F.col("end")), F.col("n"))).alias("_z"))
    window = begins.join(later, "work_id", "left").withColumn("_found", F.lit(True))
    a = F.when(F.col("_found") & F.col("_a").isNull(), F.raise_error(F.concat(F.lit("main text not found: "), "work_id")).cast("int")).otherwise(F.col("_a"))
    rows = blocks.join(window, "work_id", "left").withColumn("_a", a)
    return rows.withColumn("inside", F.col("_found").isNull() | ((F.col("n") >= F.col("_a")) & (F.col("_z").isNull() | (F.col("n") < F.col("_z"))))).drop("_a", "_z", "_found")


def sub_split(blocks: DataFrame, raw: str, at: str) -> DataFrame:
    """blocks + (piece_no, piece): each block cut where the pattern stands (a look-ahead keeps it); null blocks have no piece."""
    return blocks.select("*", F.posexplode(F.split(raw, at)).alias("piece_no", "piece"))


def labelled_parts(parts: DataFrame, keys: list[str], order: str, label: Column, text: Column) -> DataFrame:
    """keys + text: the parts of a group in order, each under its label if there is more than one."""
    one = F.struct(F.col(order).alias("o"), label.alias("l"), text.alias("t"))
    got = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("ps"))
    several = F.array_join(F.transform("ps", lambda p: F.concat(p["l"], F.lit(" "), p["t"])), "\n")
    return got.select(*keys, F.when(F.size("ps") > 1, several).otherwise(F.col("ps")[0]["t"]).alias("text"))


def char_slots(originals: DataFrame, body: str = "body") -> DataFrame:
    """originals + (pos, char): the Han characters of each body by their number among them."""
    return originals.select("*", F.posexplode(F.filter(F.split(body, ""), lambda c: c.rlike(r"^\p{IsHan}$"))).alias("pos", "char")).drop(body)


# ---- concepts --------------------------------------------------------------------------------------


def domain_list(text: Column) -> Column:
    """The domains of a concept as stored, split; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r",\s*"), lambda d: F.length(d) > 0)


def domain_text(domains: Column) -> Column:
    return F.array_join(domains, ", ")


def concept(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) + the concept of that id, nulls where there is none."""
    return ids.join(concepts, "id", "left")


def first_links(edges: DataFrame) -> DataFrame:
    """Edges (source, target, type, note, ord) once each: the first in order stays."""
    return edges.groupBy("source", "target", "type").agg(F.min_by("note", "ord").alias("note"))


def replace_concepts(spark: SparkSession, root: str, concepts: DataFrame, passages: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole concept graph as a new snapshot under root; (concepts, passages, links) written.  A link given twice is written once."""
    links = first_links(edges)
    tables = {"concepts": concepts, "concept_passages": passages, "concept_links": links}
    folder = replace_works(spark, root, tables, spark.createDataFrame([], "work_id string"), whole=True)
    return concept_stats(*[spark.read.parquet(f"{folder}/{name}") for name in tables])


def concept_stats(concepts: DataFrame, passages: DataFrame, links: DataFrame) -> DataFrame:
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((concepts, "concepts"), (passages, "passages"), (links, "links"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


# ---- queries ----------------------------------------------------------------------------------------

_START, _END = r"^(?:CHAPTER|BOOK) ", r"^(?:CHAPTER|BOOK) (?:III|3)\b"


def main_text_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from the first heading of a work up to that of its third chapter; works without headings are inside throughout."""
    s = segments_once(spark, sf_dir).select("work_id", "n", "part", "raw")
    headed = s.filter(squash(F.col("raw")).rlike(_START)).select("work_id").distinct()
    bounds = headed.select("work_id", F.lit(_START).alias("start"), F.lit(_END).alias("end"))
    return main_text(s, bounds).groupBy("work_id", "inside").agg(F.count("*").alias("n_segments"), F.min("n").cast("bigint").alias("first_n"), F.max("n").cast("bigint").alias("last_n"))


def block_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages' raw text cut in front of every numbered line."""
    p = passages_once(spark, sf_dir, "raw").select("id", "raw")
    got = sub_split(p, "raw", r"\n(?=[0-9]+\. )")
    return got.groupBy("id").agg(F.count("*").alias("n_pieces"), F.max(F.length("piece")).cast("bigint").alias("longest"))


def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' blocks with their parts put together again, labelled where there are several."""
    s = segments_once(spark, sf_dir).select("work_id", "n", "part", "text")
    got = labelled_parts(s, ["work_id", "n"], "part", F.concat(F.lit("("), F.char(F.col("part") + 97), F.lit(")")), F.coalesce("text", F.lit("")))
    return got.select("work_id", F.col("n").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


def original_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many Han characters each original has, and how often its most used one stands in it."""
    slots = char_slots(originals_once(spark, sf_dir).select("id", "body"))
    by = slots.groupBy("id", "char").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    return by.groupBy("id").agg(F.sum("n").alias("n_chars"), F.max("n").alias("most"), F.max("last").cast("bigint").alias("last_pos"))


def work_import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, shown ones and originals of every work."""
    p = searchable(spark, sf_dir, "work_id").groupBy("work_id").agg(F.count("*").alias("n_passages"), F.count_if("shown").alias("n_shown"))
    o = originals_once(spark, sf_dir).groupBy("work_id").agg(F.count("*").alias("n_originals"))
    out = table(spark, sf_dir, "works").select(F.col("id").alias("work_id")).join(p, "work_id", "left").join(o, "work_id", "left")
    return out.na.fill(0, ["n_passages", "n_shown", "n_originals"])


def concept_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept behind each work id that the usage log names, nulls for unknown ones; domains as a list and as text again."""
    log = table(spark, sf_dir, "usage_log").filter("passage_ids is not null").select(F.explode(F.from_json("passage_ids", "array<string>")).alias("ref"))
    ids = log.select(F.split("ref", ":")[0].alias("id")).filter("id is not null").distinct()
    named = _concepts(spark, sf_dir).withColumn("domains", domain_text(F.array_compact(F.array("tradition", "school"))))
    got = concept(named, ids).withColumn("listed", domain_list(F.col("domains")))
    return got.select("id", "name", F.size("listed").cast("bigint").alias("n_domains"), F.when(F.col("name").isNotNull(), domain_text(F.col("listed"))).alias("domains"))


def concept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts, their passages and links, each link once."""
    edges = _edges(spark, sf_dir).withColumn("note", F.lit("")).withColumn("ord", F.lit(0))
    return concept_stats(_concepts(spark, sf_dir), passages_once(spark, sf_dir, "work_id").filter("work_id is not null"), first_links(edges.unionByName(edges)))


def passage_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference each passage is cited by, and the units of both sides under the name of their side."""
    p = passages_once(spark, sf_dir, "work_id", "ref", "ref_unit").select("work_id", F.concat(F.lit("translation:"), F.coalesce("ref", "ref_unit")).alias("unit"))
    o = originals_once(spark, sf_dir).select("work_id", F.concat(F.lit("original:"), "ref_unit").alias("unit"))
    return p.unionByName(o).filter("unit is not null").groupBy("work_id", "unit").agg(F.count("*").alias("n"))


QUERIES = {
    "main_text_window": main_text_window, "block_pieces": block_pieces, "joined_parts": joined_parts, "original_slots": original_slots, "work_import_stats": work_import_stats,
    "concept_lookup": concept_lookup, "concept_counts": concept_counts, "passage_references": passage_references,
}

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SEG = "seg AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY work_id, n, part ORDER BY raw) AS rn FROM segments) WHERE rn = 1)"
_ORIG = "orig AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM originals) WHERE rn = 1)"
_HAN = r"[\x{2E80}-\x{2FDF}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
ORACLES = {
    "main_text_window": rf"WITH {_SEG}, t AS (SELECT *, trim(regexp_replace(raw, '{_WS}', ' ', 'g')) AS t FROM seg), a AS (SELECT work_id, min(n) AS a FROM t WHERE regexp_matches(t, '^(?:CHAPTER|BOOK) ') GROUP BY work_id), z AS (SELECT t.work_id, min(n) AS z FROM t JOIN a ON t.work_id = a.work_id AND n > a WHERE regexp_matches(t, '^(?:CHAPTER|BOOK) (?:III|3)\b') GROUP BY t.work_id), x AS (SELECT seg.work_id, n, a.a IS NULL OR (n >= a.a AND (z.z IS NULL OR n < z.z)) AS inside FROM seg LEFT JOIN a USING (work_id) LEFT JOIN z USING (work_id)) SELECT work_id, inside, count(*) AS n_segments, min(n)::BIGINT AS first_n, max(n)::BIGINT AS last_n FROM x GROUP BY ALL",
    "block_pieces": rf"WITH {ONCE}, x AS (SELECT id, unnest(string_split(regexp_replace(raw, '\n([0-9]+\. )', chr(1) || '\1', 'g'), chr(1))) AS piece FROM pas WHERE raw IS NOT NULL) SELECT id, count(*) AS n_pieces, max(length(piece)) AS longest FROM x GROUP BY id",
    "joined_parts": f"WITH {_SEG}, g AS (SELECT work_id, n, count(*) AS k, string_agg('(' || chr(97 + part) || ') ' || coalesce(text, ''), chr(10) ORDER BY part) AS many, arg_min(coalesce(text, ''), part) AS one FROM seg GROUP BY ALL) SELECT work_id, n::BIGINT AS n, md5(CASE WHEN k > 1 THEN many ELSE one END) AS text_md5 FROM g",
    "original_slots": f"WITH {_ORIG}, c AS (SELECT id, unnest(regexp_extract_all(body, '{_HAN}')) AS c FROM orig WHERE body IS NOT NULL), n AS (SELECT id, c, count(*) AS n FROM c GROUP BY ALL) SELECT id, sum(n)::BIGINT AS n_chars, max(n) AS most, (sum(n) - 1)::BIGINT AS last_pos FROM n GROUP BY id",
    "work_import_stats": f"WITH {ONCE}, {_ORIG}, p AS (SELECT p.work_id, count(*) AS n_passages, count(*) FILTER (WHERE NOT coalesce(p.is_apparatus, false) AND coalesce(t.quotable, false)) AS n_shown FROM pas p LEFT JOIN texts t ON t.id = p.text_id GROUP BY p.work_id), o AS (SELECT work_id, count(*) AS n_originals FROM orig GROUP BY work_id) SELECT w.id AS work_id, coalesce(n_passages, 0) AS n_passages, coalesce(n_shown, 0) AS n_shown, coalesce(n_originals, 0) AS n_originals FROM works w LEFT JOIN p ON p.work_id = w.id LEFT JOIN o ON o.work_id = w.id",
    "concept_lookup": "WITH l AS (SELECT DISTINCT split_part(ref, ':', 1) AS id FROM (SELECT unnest(from_json(passage_ids, '[\"VARCHAR\"]')) AS ref FROM usage_log WHERE passage_ids IS NOT NULL) WHERE ref IS NOT NULL) SELECT l.id, w.title AS name, (CASE WHEN w.id IS NULL THEN 0 ELSE (w.tradition IS NOT NULL)::INT + (w.original_language IS NOT NULL)::INT END)::BIGINT AS n_domains, CASE WHEN w.id IS NOT NULL THEN concat_ws(', ', w.tradition, w.original_language) END AS domains FROM l LEFT JOIN works w ON w.id = l.id",
    "concept_counts": f"WITH {ONCE}, ph AS (SELECT DISTINCT work_id, md5(body) AS h FROM pas WHERE body IS NOT NULL AND NOT is_apparatus), fi AS (SELECT h, min(work_id) AS source FROM ph GROUP BY h), ed AS (SELECT DISTINCT * FROM (SELECT source, work_id AS target, 'shares' AS type FROM ph JOIN fi USING (h) WHERE work_id <> source UNION ALL SELECT w.id, b.target, 'broader' FROM works w JOIN (SELECT tradition, min(id) AS target FROM works GROUP BY tradition) b USING (tradition) WHERE w.id <> b.target)) SELECT (SELECT count(*) FROM works) AS concepts, (SELECT count(*) FROM pas WHERE work_id IS NOT NULL) AS passages, (SELECT count(*) FROM ed) AS links",
    "passage_references": f"WITH {ONCE}, {_ORIG} SELECT work_id, unit, count(*) AS n FROM (SELECT work_id, 'translation:' || coalesce(ref, ref_unit) AS unit FROM pas UNION ALL SELECT work_id, 'original:' || ref_unit FROM orig) WHERE unit IS NOT NULL GROUP BY ALL",
}
