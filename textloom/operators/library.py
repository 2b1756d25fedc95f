"""Building the library: blocks, references, ids, units, the concept graph, index bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import passage_id, roman, slug, squash
from textloom.operators.search import ONCE, passages_once, searchable
from textloom.sources.tables import table

KEYWORD_BATCH, EMBED_BATCH, EMBED_CHARS = 20, 32, 40_000


# ---- blocks and references ------------------------------------------------------------------------


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, block): the text cut at blank lines, blank blocks dropped, indentation kept; null and blank texts have none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: b.rlike(r"\S"))
    return df.select(key, F.posexplode(parts).alias("n", "block"))


#: Anchors of notes as the sources print them.
NOTE_ANCHOR = r"\[(?:FN#)?\d+\]"


def is_verse(block: Column) -> Column:
    """More than one line with text, all of them indented."""
    written = F.regexp_count(block, F.lit(r"(?md)^.*\S"))
    return (written > 1) & (written == F.regexp_count(block, F.lit(r"(?md)^[^\S\n]+\S")))


def normalised(block: Column) -> Column:
    """Prose on one line, a line's end after a hyphen dropped, note anchors and italics gone; verse line by line."""
    plain = F.regexp_replace(F.regexp_replace(block, NOTE_ANCHOR, ""), r"(?<!\w)_([^_]+)_(?!\w)", "$1")
    lines = F.filter(F.transform(F.split(plain, "\n"), squash), lambda line: F.length(line) > 0)
    return F.when(is_verse(block), F.array_join(lines, "\n")).otherwise(squash(F.regexp_replace(plain, r"(?<=\w-)\n\s*(?=\w)", "")))


def carried(df: DataFrame, group: str, at: str, order: list[str], value: Column, name: str, largest: bool = False, size: int = 1_000) -> DataFrame:
    """df + name: the last value that is not null (or the largest) among the rows of a group up to this one.

    Groups are cut into ranges of `size` numbers of `at`; what a range ends with is carried into the
    next ones from the short list of ranges, so that a group of a third of all rows is many tasks.
    """
    rows = df.withColumn("_v", value).withColumn("_b", F.expr(f"`{at}` div {size}"))
    inside = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if largest:
        rows = rows.withColumn("_c", F.max("_v").over(inside))
        ends = rows.groupBy(group, "_b").agg(F.max("_v").alias("_l")).select(group, "_b", F.max("_l").over(before).alias("_carry"))
        out = F.greatest("_c", "_carry")
    else:
        rows = rows.withColumn("_c", F.last("_v", ignorenulls=True).over(inside))
        ends = rows.groupBy(group, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_l")).select(group, "_b", F.last("_l", ignorenulls=True).over(before).alias("_carry"))
        out = F.coalesce("_c", "_carry")
    return rows.join(ends, [group, "_b"]).withColumn(name, out).drop("_v", "_b", "_c", "_carry")


def running_chapters(segments: DataFrame, size: int = 1_000) -> DataFrame:
    """segments + chapter: the last own heading at or before a segment, by number."""
    head = F.when(F.col("apparatus") & F.col("raw").rlike(r"^\s*(?:CHAPTER|BOOK)\s+(?:[IVXLC]+|\d+)\.?(?:\s|$)") & ~F.col("raw").rlike(r"^[^\n]*\d+\s*$"), F.regexp_extract("raw", r"^\s*(?:CHAPTER|BOOK)\s+([IVXLC]+|\d+)", 1))
    number = F.when(head.rlike("^[0-9]+$"), head.cast("int")).otherwise(roman(head))
    return carried(segments, "work_id", "n", ["n", "part"], number, "chapter", size=size)


def segments_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments").filter("work_id is not null and n is not null and part is not null")
    return s.groupBy("work_id", "n", "part").agg(F.min(F.struct("raw", "text", "ref", "ref_unit", "apparatus")).alias("r")).select("work_id", "n", "part", "r.*")


def unit_expand(units: DataFrame, unit: str) -> DataFrame:
    """units + (source_unit, ord): numeric ranges as their members, anything else itself; reversed ranges are an error."""
    a, b = F.regexp_extract(unit, r"^(\d+)-(\d+)$", 1), F.regexp_extract(unit, r"^(\d+)-(\d+)$", 2)
    is_range = F.col(unit).rlike(r"^\d{1,9}-\d{1,9}$")
    low, high = F.when(is_range, a.cast("int")), F.when(is_range, b.cast("int"))
    members = F.when(is_range & (low > high), F.raise_error(F.concat(F.lit("reversed range "), F.col(unit)))).when(is_range, F.transform(F.sequence(low, high), lambda x: x.cast("string"))).otherwise(F.array(F.col(unit)))
    return units.select("*", F.posexplode(members).alias("ord", "source_unit"))


def band_join(rows: DataFrame, value: str, starts: DataFrame, start: str, width: int) -> DataFrame:
    """rows + the band whose start is the last at or before the value; values before the first band have none.

    Bands become intervals by lead; both sides meet on buckets of `width`, each band in every bucket it covers.
    """
    keyed_starts = starts.select(start).filter(F.col(start).isNotNull()).distinct().withColumn("_bucket", F.expr(f"`{start}` div {width}"))
    firsts = keyed_starts.groupBy("_bucket").agg(F.min(start).alias("_first"))
    after = firsts.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_after"))  # as many rows as the values' range has buckets
    bands = keyed_starts.withColumn("_end", F.lead(start).over(Window.partitionBy("_bucket").orderBy(start))).join(after, "_bucket")
    bands = bands.withColumn("_end", F.coalesce("_end", "_after")).drop("_after", "_bucket")
    top = rows.agg(F.max(value).alias("_top"))
    spread = bands.join(F.broadcast(top)).withColumn("_bucket", F.explode(F.sequence(F.expr(f"`{start}` div {width}"), F.greatest(F.expr(f"`{start}` div {width}"), F.expr(f"(coalesce(_end, _top + 1) - 1) div {width}"))))).drop("_top")
    keyed = rows.withColumn("_bucket", F.expr(f"`{value}` div {width}"))
    inside = (keyed["_bucket"] == spread["_bucket"]) & (keyed[value] >= spread[start]) & (spread["_end"].isNull() | (keyed[value] < spread["_end"]))
    return keyed.join(spread, inside, "left").drop("_bucket", "_end")


# ---- concepts --------------------------------------------------------------------------------------


def concept_filter(concepts: DataFrame, text: str | None) -> DataFrame:
    """Concepts that contain the text anywhere, without case, taken literally; blank text gives all."""
    if text is None or not text.strip():
        return concepts.orderBy("id")
    hay = F.lower(F.concat_ws(" ", "id", "name", F.coalesce("original", F.lit("")), "gloss", "tradition", "school", "domains"))
    return concepts.filter(F.contains(hay, F.lit(text.strip().lower()))).orderBy("id")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, other, type, name): every edge seen from both ends; `broader` seen from its target is `narrower`; ends without a node are dropped."""
    there = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "type")
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("other"), F.when(F.col("type") == "broader", "narrower").otherwise(F.col("type")).alias("type"))
    return there.unionByName(back).join(nodes.select(F.col("id").alias("other"), "name"), "other").select("id", "other", "type", "name")


def key_snippet(text: Column, phrase: Column, before: int = 8, size: int = 40) -> Column:
    """`size` words from `before` words ahead of the phrase, or from the start where it is absent, with marks at cut ends."""
    flat = squash(text)
    words = F.split(flat, " ")
    at = F.position(phrase, flat)
    ahead = F.when(at > 0, F.size(F.split(F.substr(flat, F.lit(1), F.greatest(at - 1, F.lit(0))), " ")) - F.when(at == 1, 0).otherwise(1)).otherwise(0)
    start = F.greatest(ahead - before, F.lit(0)) + 1
    return F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(F.slice(words, start, F.lit(size)), " "), F.when(start + size - 1 < F.size(words), " …").otherwise(""))


# ---- index bookkeeping ------------------------------------------------------------------------------


def cache_misses(rows: DataFrame, body: str, cache: DataFrame, model: str) -> DataFrame:
    """(hash, body) once for each body whose hash the cache lacks for this model."""
    hashed = rows.filter(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("hash"), F.col(body).alias("body"))
    known = cache.filter(F.col("model") == model).select("hash")
    return hashed.groupBy("hash").agg(F.min("body").alias("body")).join(known, "hash", "left_anti")


def bounded_batches(df: DataFrame, columns: list[str], text: str, generate: Callable[[list[str]], list], out: str, most: int = EMBED_BATCH, chars: int = EMBED_CHARS) -> DataFrame:
    """columns + result of `generate`, which gets at most `most` texts and `chars` characters a call; one longer text is a call of its own.

    A result of None leaves its row out, to be tried again another time.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema) + f", result {out}"

    def run(batches):
        for pdf in batches:
            texts, results, begin, size = pdf[text].tolist(), [], 0, 0
            for k, t in enumerate(texts):
                if k > begin and (k - begin >= most or size + len(t) > chars):
                    results += generate(texts[begin:k])
                    begin, size = k, 0
                size += len(t)
            if texts[begin:]:
                results += generate(texts[begin:])
            keep = [r is not None for r in results]
            yield pdf[columns].assign(result=pd.Series(results, index=pdf.index, dtype=object))[keep]

    return df.select(*dict.fromkeys([*columns, text])).mapInPandas(run, schema)


# ---- queries ----------------------------------------------------------------------------------------


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = table(spark, sf_dir, "wcw_records").select(F.concat_ws("|", "snapshot_no", "slug", "delivered_at").alias("rec"), "text").distinct()
    return blocks(rec, "rec", "text").groupBy("rec").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("chars"))


def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments_once(spark, sf_dir)
    return s.select(passage_id(F.col("work_id"), F.col("n"), F.col("part")).alias("id"), slug(F.col("text")).alias("slug"), squash(F.col("raw")).alias("flat"))


def segment_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_chapters(segments_once(spark, sf_dir)).groupBy("work_id", "chapter").agg(F.count("*").alias("n_segments"), F.min("n").cast("bigint").alias("first_n")).withColumn("chapter", F.col("chapter").cast("bigint"))


def raw_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages_once(spark, sf_dir)
    return p.select("id", normalised(F.col("raw")).alias("body"), is_verse(F.col("raw")).alias("is_verse"))


def unit_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages_once(spark, sf_dir).filter("ref_unit is not null").select("work_id", "ref_unit").distinct()
    return unit_expand(p, "ref_unit").select("work_id", "ref_unit", "source_unit", F.col("ord").cast("bigint").alias("ord"))


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the band of their price; a band starts at each different rounded balance of the customers, twentyfold."""
    orders = table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("price"))
    starts = table(spark, sf_dir, "customer").select(F.floor(F.abs("c_acctbal") * 20).alias("band")).distinct()
    return band_join(orders, "price", starts, "band", 5_000).groupBy("band").agg(F.count("*").alias("n"))


def unit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals between the first and the last unit of a work that has passages, by source order."""
    o = table(spark, sf_dir, "originals").filter("ref_unit is not null and work_id is not null").groupBy("work_id", "ref_unit").agg(F.min("id").alias("pos"))
    used = passages_once(spark, sf_dir).select("work_id", "ref_unit").distinct()
    ends = o.join(used, ["work_id", "ref_unit"], "left_semi").groupBy("work_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return o.join(ends, "work_id").filter("pos between a and b").groupBy("work_id").agg(F.count("*").alias("n_units"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "works")
    return w.select("id", F.col("title").alias("name"), F.col("original_title").alias("original"), F.col("author").alias("gloss"), "tradition", F.col("original_language").alias("school"), F.lit("").alias("domains"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the works their passages were also found in (same body), and with the first work of their tradition as the broader one."""
    p = passages_once(spark, sf_dir).filter("body is not null and not is_apparatus").select("work_id", F.md5("body").alias("h")).distinct()
    firsts = p.groupBy("h").agg(F.min("work_id").alias("source"))
    shared = p.join(firsts, "h").filter("work_id <> source").select("source", F.col("work_id").alias("target"), F.lit("shares").alias("type"))
    w = table(spark, sf_dir, "works")
    broad = w.groupBy("tradition").agg(F.min("id").alias("target"))
    broader = w.join(broad, "tradition").filter("id <> target").select(F.col("id").alias("source"), "target", F.lit("broader").alias("type"))
    return shared.unionByName(broader).dropDuplicates(["source", "target", "type"])


def concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_filter(_concepts(spark, sf_dir), " GREEK ").select("id", "name", "original", "gloss", "tradition", "school")


def concept_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_edges(spark, sf_dir), _concepts(spark, sf_dir))


def concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each concept by type of link."""
    n = concept_neighbours(spark, sf_dir)
    return n.groupBy("id", "type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("other")), ",").alias("others"))


def concept_key_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References work:block taken from the log, resolved where a shown passage with a unit has that id; unresolved ones stay with nulls."""
    log = table(spark, sf_dir, "usage_log").filter("passage_ids is not null").select(F.explode(F.from_json("passage_ids", "array<string>")).alias("ref")).distinct()
    keys = log.select(F.split("ref", ":")[0].alias("work_slug"), F.regexp_extract("ref", r":(\d+)", 1).alias("idx")).filter("work_slug is not null").distinct()
    p = passages_once(spark, sf_dir).filter("not is_apparatus and ref_unit is not null").select(F.col("id").alias("passage_id"), "ref_unit")
    joined = keys.join(p, F.concat("work_slug", F.lit(":"), "idx") == F.col("passage_id"), "left")
    return joined.select("work_slug", "idx", "passage_id", "ref_unit")


def key_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages_once(spark, sf_dir).filter("body is not null")
    return p.select("id", key_snippet(F.col("body"), F.lit("every")).alias("snippet"))


def content_hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies to generate for: hashes of shown passages with how many share one."""
    s = searchable(spark, sf_dir).filter("shown and body is not null")
    return s.groupBy(F.sha2(F.col("body").cast("binary"), 256).alias("hash")).agg(F.count("*").alias("n_passages"), F.min("id").alias("first_id"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = searchable(spark, sf_dir)
    return p.groupBy("work_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("shown"), 1)).alias("n_shown"), F.count(F.when(F.coalesce("keywords", F.lit("")) != "", 1)).alias("n_keywords"), F.countDistinct("ref_unit").alias("n_units"))


def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether more than half of a document's non-space characters are Han."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    han, full = F.regexp_count("text", F.lit("[\\x{4E00}-\\x{9FFF}]")), F.length(F.regexp_replace("text", "[ \\n\\t\\r]", ""))
    return d.select("doc_id", han.cast("bigint").alias("n_han"), (han * 2 > full).alias("is_han"))


def scan_shape(raw: Column) -> tuple[Column, Column, Column]:
    """Letters, share of capitals among them, and the median length of the lines with text."""
    letters, capitals = F.regexp_count(raw, F.lit(r"\p{L}")), F.regexp_count(raw, F.lit(r"\p{Lu}"))
    sizes = F.sort_array(F.transform(F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"\S")), lambda x: F.length(F.trim(x))))
    middle = (F.get(sizes, F.floor((F.size(sizes) - 1) / 2).cast("int")) + F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))) / 2
    return letters, F.when(letters > 0, capitals / letters), middle


def scan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of scans by what they look like: noise (under 4 letters), heading (7 of 10 letters capital), small type (lines over 56), text."""
    s = segments_once(spark, sf_dir)
    letters, capitals, middle = scan_shape(F.col("raw"))
    kind = F.when(letters < 4, "noise").when(capitals >= 0.7, "heading").when(middle > 56, "small").otherwise("text")
    return s.withColumn("kind", kind).groupBy("work_id", "kind").agg(F.count("*").alias("n"), F.sum(letters.cast("bigint")).alias("letters"))


QUERIES = {
    "scan_shapes": scan_shapes, "block_split": block_split, "segment_ids": segment_ids, "segment_chapters": segment_chapters, "raw_normalised": raw_normalised, "unit_members": unit_members, "price_bands": price_bands,
    "unit_ranges": unit_ranges, "concept_filter": concept_search, "concept_neighbours": concept_neighbours, "concept_groups": concept_groups, "concept_key_passages": concept_key_passages,
    "key_snippets": key_snippets, "content_hash_cache": content_hash_cache, "index_stats": index_stats, "script_share": script_share,
}

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SEG = "seg AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY work_id, n, part ORDER BY raw) AS rn FROM segments) WHERE rn = 1)"
_SEA = ONCE + ", sea AS (SELECT p.*, NOT coalesce(p.is_apparatus, false) AND coalesce(t.quotable, false) AS shown FROM pas p LEFT JOIN texts t ON p.text_id = t.id)"


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


_LINES = "list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '\\S'))"
_VERSE = f"(len({_LINES}) > 1 AND len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\\s'))) = 0)"
_BARE = r"regexp_replace(regexp_replace(raw, '\[(?:FN#)?\d+\]', '', 'g'), '(^|\W)_([^_]+)_(\W|$)', '\1\2\3', 'g')"
_EDGES = f"{ONCE}, ph AS (SELECT DISTINCT work_id, md5(body) AS h FROM pas WHERE body IS NOT NULL AND NOT is_apparatus), fi AS (SELECT h, min(work_id) AS source FROM ph GROUP BY h), ed AS (SELECT DISTINCT * FROM (SELECT source, work_id AS target, 'shares' AS type FROM ph JOIN fi USING (h) WHERE work_id <> source UNION ALL SELECT w.id, b.target, 'broader' FROM works w JOIN (SELECT tradition, min(id) AS target FROM works GROUP BY tradition) b USING (tradition) WHERE w.id <> b.target)), nb AS (SELECT x.id, other, type, w.title AS name FROM (SELECT source AS id, target AS other, type FROM ed UNION ALL SELECT target, source, CASE WHEN type = 'broader' THEN 'narrower' ELSE type END FROM ed) x JOIN works w ON w.id = other)"
_LN = "list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '\\S'))"
ORACLES = {
    "scan_shapes": f"WITH {_SEG}, x AS (SELECT work_id, len(regexp_extract_all(raw, '\\p{{L}}')) AS l, len(regexp_extract_all(raw, '\\p{{Lu}}')) AS u, list_median(list_transform({_LN}, lambda y: length(trim(y)))) AS m FROM seg) SELECT work_id, CASE WHEN l < 4 THEN 'noise' WHEN u / l::DOUBLE >= 0.7 THEN 'heading' WHEN m > 56 THEN 'small' ELSE 'text' END AS kind, count(*) AS n, sum(l)::BIGINT AS letters FROM x GROUP BY ALL",
    "block_split": r"WITH r AS (SELECT DISTINCT concat_ws('|', snapshot_no, slug, strftime(delivered_at, '%Y-%m-%d %H:%M:%S')) AS rec, text FROM wcw_records), b AS (SELECT rec, unnest(regexp_split_to_array(coalesce(text, ''), '\n\s*\n')) AS block FROM r) SELECT rec, count(*) AS n_blocks, sum(length(block))::BIGINT AS chars FROM b WHERE regexp_matches(block, '\S') GROUP BY rec",
    "segment_ids": f"WITH {_SEG} SELECT work_id || ':' || n || CASE WHEN part > 0 THEN chr(97 + part) ELSE '' END AS id, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g') AS slug, {_flat('raw')} AS flat FROM seg",
    "segment_chapters": f"WITH {_SEG}, h AS (SELECT *, CASE WHEN apparatus AND regexp_matches(raw, '^\\s*(?:CHAPTER|BOOK)\\s+(?:[IVXLC]+|\\d+)\\.?(?:\\s|$)') AND NOT regexp_matches(raw, '^[^\\n]*\\d+\\s*$') THEN regexp_extract(raw, '^\\s*(?:CHAPTER|BOOK)\\s+([IVXLC]+|\\d+)', 1) END AS hd FROM seg), v AS (SELECT work_id, n, part, CASE WHEN regexp_matches(hd, '^[0-9]+$') THEN hd::INT ELSE (SELECT sum(CASE WHEN nx > dv THEN -dv ELSE dv END)::INT FROM (SELECT dv, coalesce(lead(dv) OVER (ORDER BY i), 0) AS nx FROM (SELECT i, CASE substring(hd, i, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 END AS dv FROM (SELECT unnest(range(1, length(hd) + 1)) AS i)))) END AS hn FROM h), c AS (SELECT work_id, n, last_value(hn IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY n, part ROWS UNBOUNDED PRECEDING) AS chapter FROM v) SELECT work_id, chapter::BIGINT AS chapter, count(*) AS n_segments, min(n)::BIGINT AS first_n FROM c GROUP BY ALL",
    "raw_normalised": f"WITH {ONCE} SELECT id, CASE WHEN {_VERSE} THEN array_to_string(list_filter(list_transform(string_split({_BARE}, chr(10)), lambda x: {_flat('x')}), lambda x: x <> ''), chr(10)) ELSE {_flat(f'''regexp_replace({_BARE}, '(\\w-)\\n\\s*(\\w)', '\\1\\2', 'g')''')} END AS body, {_VERSE} AS is_verse FROM pas",
    "unit_members": f"WITH {ONCE}, u AS (SELECT DISTINCT work_id, ref_unit FROM pas WHERE ref_unit IS NOT NULL), m AS (SELECT *, CASE WHEN regexp_matches(ref_unit, '^\\d{{1,9}}-\\d{{1,9}}$') THEN list_transform(range(split_part(ref_unit, '-', 1)::BIGINT, split_part(ref_unit, '-', 2)::BIGINT + 1), lambda x: x::VARCHAR) ELSE [ref_unit] END AS ms FROM u) SELECT work_id, ref_unit, unnest(ms) AS source_unit, unnest(range(0, len(ms))) AS ord FROM m",
    "price_bands": "WITH s AS (SELECT DISTINCT floor(abs(c_acctbal) * 20)::BIGINT AS band FROM customer), b AS (SELECT band, lead(band) OVER (ORDER BY band) AS e FROM s), o AS (SELECT floor(o_totalprice)::BIGINT AS price FROM orders) SELECT band, count(*) AS n FROM o LEFT JOIN b ON price >= band AND (e IS NULL OR price < e) GROUP BY band",
    "unit_ranges": f"WITH {ONCE}, o AS (SELECT work_id, ref_unit, min(id) AS pos FROM originals WHERE ref_unit IS NOT NULL AND work_id IS NOT NULL GROUP BY ALL), e AS (SELECT work_id, min(pos) AS a, max(pos) AS b FROM o WHERE (work_id, ref_unit) IN (SELECT (work_id, ref_unit) FROM pas WHERE ref_unit IS NOT NULL) GROUP BY work_id) SELECT work_id, count(*) AS n_units, min(pos) AS first_pos, max(pos) AS last_pos FROM o JOIN e USING (work_id) WHERE pos BETWEEN a AND b GROUP BY work_id",
    "concept_filter": "SELECT id, title AS name, original_title AS original, author AS gloss, tradition, original_language AS school FROM works WHERE contains(lower(concat_ws(' ', id, title, coalesce(original_title, ''), author, tradition, original_language, '')), 'greek')",
    "concept_neighbours": f"WITH {_EDGES} SELECT * FROM nb",
    "concept_groups": f"WITH {_EDGES} SELECT id, type, count(*) AS n, string_agg(DISTINCT other, ',' ORDER BY other) AS others FROM nb GROUP BY ALL",
    "concept_key_passages": f"WITH {ONCE}, l AS (SELECT DISTINCT unnest(from_json(passage_ids, '[\"VARCHAR\"]')) AS ref FROM usage_log WHERE passage_ids IS NOT NULL), k AS (SELECT DISTINCT split_part(ref, ':', 1) AS work_slug, regexp_extract(ref, ':(\\d+)', 1) AS idx FROM l WHERE ref IS NOT NULL) SELECT work_slug, idx, p.id AS passage_id, p.ref_unit FROM k LEFT JOIN (SELECT * FROM pas WHERE NOT is_apparatus AND ref_unit IS NOT NULL) p ON p.id = work_slug || ':' || idx",
    "content_hash_cache": f"WITH {_SEA} SELECT sha256(body) AS hash, count(*) AS n_passages, min(id) AS first_id FROM sea WHERE shown AND body IS NOT NULL GROUP BY ALL",
    "index_stats": f"WITH {_SEA} SELECT work_id, count(*) AS n, count(*) FILTER (WHERE shown) AS n_shown, count(*) FILTER (WHERE coalesce(keywords, '') <> '') AS n_keywords, count(DISTINCT ref_unit) AS n_units FROM sea GROUP BY work_id",
    "script_share": r"SELECT doc_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS n_han, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) * 2 > length(regexp_replace(text, '[ \n\t\r]', '', 'g')) AS is_han FROM documents WHERE text IS NOT NULL",
}
