"""Reading whole reference units within a word budget, and checking quotations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.shared import broadcast_if_small, written
from textloom.functions.text import COMPATIBLE, canonical_quote, trigrams, word_count, words
from textloom.operators.index import Index, bm25_many
from textloom.operators.search import _STOP_SQL, _toks, CANDIDATES, ONCE, STOP_WORDS, document_index, searchable
from textloom.sources.tables import delivered_once, table

READ_BUDGET = 6_000
# Marks that end a sentence or a clause at which a text may be cut, and what closes behind them, of scripts with spaces and of Han.
_MARKS, _CLOSE, _HAN_MARKS, _HAN_CLOSE = ".!?;:·׃।॥", "\"'”’»)\\]", "。！？；", "」』”’"
#: A cut may stand behind a mark with its closing quotes, in front of space or the end; behind a mark of Han anywhere.
SENTENCE_END = rf"[{_MARKS}]+[{_CLOSE}]*(?!\S)|[{_HAN_MARKS}]+[{_HAN_CLOSE}]*"
_HAN = "⺀-⿟々〇㐀-䶿一-鿿豈-﫿"
_PLACES = re.compile(rf"[{_HAN}]|[^\s{_HAN}]*[^\W_{_HAN}][^\s{_HAN}]*")
_ENDS = re.compile(SENTENCE_END)


def _cut(text: str | None, limit: int, at_sentence: bool) -> tuple[str | None, bool]:
    if text is None:
        return None, False
    for k, m in enumerate(_PLACES.finditer(text)):
        if k == limit:
            plain = text[: m.start()].rstrip()
            ends = [e.end() for e in _ENDS.finditer(plain)] if at_sentence else []
            return (plain[: ends[-1]] if ends else plain), True
    return text, False


def cut_words(text: Column, limit: Column, at_sentence: bool = False) -> Column:
    """struct(text, cut): the text before word limit + 1; with at_sentence back to the last end mark, if there is one.

    A text of at most `limit` words is not cut, null stays null, nothing of a text stays at limit 0.
    """

    @F.pandas_udf("text string, cut boolean")
    def run(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(x, int(k), at_sentence) for x, k in zip(t, n)], columns=["text", "cut"])

    return run(text, limit)


def unit_aids(shown: DataFrame) -> DataFrame:
    """(work_id, ref_unit, n_passages, first_id, first_position, aid): the shown passages of each unit in order.

    Passages without a unit are left out; positions that tie go by id.
    """
    given = shown.filter("shown and ref_unit is not null and work_id is not null")
    at = F.struct("position", "id", "body")
    return given.groupBy("work_id", "ref_unit").agg(F.count("*").alias("n_passages"), F.sort_array(F.collect_list(at)).alias("ps")).select(
        "work_id", "ref_unit", "n_passages", F.col("ps")[0]["id"].alias("first_id"), F.col("ps")[0]["position"].alias("first_position"),
        F.array_join(F.transform("ps", lambda p: p["body"]), "\n\n").alias("aid"),
    )


def first_passage_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = searchable(spark, sf_dir).filter("shown and ref_unit is not null")
    return given.groupBy("work_id", "ref_unit").agg(F.min_by("id", F.struct("position", "id")).alias("first_id"), F.count("*").alias("n_passages"))


def aid_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_aids(searchable(spark, sf_dir)).select("work_id", "ref_unit", "n_passages", "first_id", F.md5("aid").alias("aid_md5"), F.length("aid").cast("bigint").alias("aid_chars"))


def originals_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered_once(table(spark, sf_dir, "originals"), "id", "created_at")


def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with its aid and, if there is one, its original; header from works and the first quotable text."""
    aids = unit_aids(searchable(spark, sf_dir))
    orig = originals_once(spark, sf_dir).select("work_id", "ref_unit", F.col("id").alias("original_id"), "language").filter("ref_unit is not null")
    orig = orig.groupBy("work_id", "ref_unit").agg(F.min(F.struct("original_id", "language")).alias("o"))
    texts = table(spark, sf_dir, "texts").filter("quotable").groupBy("work_id").agg(F.min(F.struct("id", "translator", "year")).alias("t"))
    works = table(spark, sf_dir, "works").select(F.col("id").alias("work_id"), "author", "title")
    out = aids.join(orig, ["work_id", "ref_unit"], "left").join(works, "work_id", "left").join(texts, "work_id", "left")
    return out.select("work_id", "ref_unit", "author", "title", F.col("t.translator").alias("translator"), F.col("t.year").cast("bigint").alias("year"), "n_passages", F.col("o.original_id").alias("original_id"), F.col("o.language").alias("language"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.coalesce("text", F.lit(""))).alias("n_words"))


def cut_to_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of at most 12 words of every document."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", cut_words(F.col("text"), F.lit(12)).alias("c"))
    return d.select("doc_id", F.col("c.text").alias("opening"), F.col("c.cut").alias("cut"))


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the usage log: the first ten different ids of each logged reading, in order of first place."""
    log = table(spark, sf_dir, "usage_log").filter("passage_ids is not null and tool = 'read_passages'").select("id", "passage_ids").distinct()
    ids = log.select(F.col("id").alias("request_id"), F.posexplode(F.from_json("passage_ids", "array<string>")).alias("pos", "pid")).filter("pid is not null")
    return ids.groupBy("request_id", "pid").agg(F.min("pos").alias("pos"))


def unit_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested passages by request and unit, units in order of their first hit; unknown or hidden ids count as missing; every unit's word share."""
    known = searchable(spark, sf_dir).filter("shown and ref_unit is not null").select(F.col("id").alias("pid"), "work_id", "ref_unit")
    hits = requested(spark, sf_dir).join(known, "pid", "left")
    units = hits.filter("ref_unit is not null").groupBy("request_id", "work_id", "ref_unit").agg(F.min("pos").cast("bigint").alias("first_pos"), F.count("*").alias("n_hits"))
    missing = hits.groupBy("request_id").agg(F.count(F.when(F.col("ref_unit").isNull(), 1)).alias("n_missing"), F.countDistinct("work_id", "ref_unit").alias("n_units"))
    out = units.join(missing, "request_id")
    return out.select("request_id", "work_id", "ref_unit", "first_pos", "n_hits", "n_missing", F.floor(F.lit(READ_BUDGET) / F.greatest("n_units", F.lit(1))).cast("bigint").alias("share"))


def budget_cascade(aids: DataFrame, originals: DataFrame, share: int) -> DataFrame:
    """(work_id, ref_unit, original, transcription, aid, dropped): what of a unit fits in its share of words.

    The original gets the share, cut at a sentence end; the transcription is cut to the original's
    words; the aid gets what is left and is dropped if nothing is.  Without an original the
    translation stands alone.
    """
    o = originals.filter("ref_unit is not null").groupBy("work_id", "ref_unit").agg(F.min_by(F.struct("body", "transcription"), "id").alias("o")).select("work_id", "ref_unit", "o.body", "o.transcription")
    u = aids.join(o, ["work_id", "ref_unit"], "left").withColumn("oc", cut_words(F.coalesce("body", F.lit("")), F.lit(share), True))
    u = u.withColumn("n_original", word_count(F.col("oc.text")).cast("int")).withColumn("tc", cut_words(F.coalesce("transcription", F.lit("")), F.col("n_original")))
    u = u.withColumn("left", F.greatest(F.lit(share) - F.col("n_original") - word_count(F.col("tc.text")).cast("int"), F.lit(0))).withColumn("ac", cut_words(F.col("aid"), F.col("left")))
    return u.select("work_id", "ref_unit", F.col("oc.text").alias("original"), F.col("tc.text").alias("transcription"), F.when(F.col("left") > 0, F.col("ac.text")).otherwise("").alias("aid"), (F.col("left") == 0).alias("dropped"), "n_original")


def read_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = budget_cascade(unit_aids(searchable(spark, sf_dir)), originals_once(spark, sf_dir), 60)
    return got.select("work_id", "ref_unit", F.col("n_original").cast("bigint").alias("n_original"), word_count(F.col("transcription")).alias("n_transcription"), word_count(F.col("aid")).alias("n_aid"), "dropped")


# ---- quotations ----------------------------------------------------------------------------------


def quote_candidates(quotes: DataFrame, index: Index, weights: dict[str, float], k: int = CANDIDATES) -> DataFrame:
    """(item_id, key, score, rnk): for each quotation the k rows with the best BM25 over its distinct words (function words and single letters left out)."""
    terms = quotes.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.filter(words(F.col("quote")), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))).alias("term"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), index.key)
    return bm25_many(index, weights, terms).withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k).withColumnRenamed("query_id", "item_id")


def letter_grams(c: Column) -> Column:
    """Distinct trigrams within each run of letters, in lower case; shorter runs have none."""
    runs = F.split(F.lower(c), r"[\p{P}\p{S}\p{Z}\s]+")
    return F.array_distinct(F.flatten(F.transform(runs, trigrams)))


def gram_candidates(quotes: DataFrame, bodies: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(item_id, id, score, rnk): for each quotation the k bodies (id, body) that share most of its trigrams, rarer ones counting more.

    Trigrams and bodies meet by an inverted join on the gram; works in every script.
    """
    asked = quotes.select("item_id", F.explode(letter_grams(F.col("quote"))).alias("g"))
    wanted = broadcast_if_small(asked.select("g").distinct())
    has = bodies.select("id", F.explode(letter_grams(F.col("body"))).alias("g")).join(wanted, "g", "left_semi")
    n = bodies.agg(F.count("*").alias("n"))
    df = has.groupBy("g").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("g", F.log(1 + F.col("n") / F.col("df")).alias("w"))  # one row
    score = asked.join(has.join(df, "g"), "g").groupBy("item_id", "id").agg(F.sum("w").alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), "id")
    return score.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def quote_matches(quotes: DataFrame, candidates: DataFrame, bodies: DataFrame, most: int = 5) -> DataFrame:
    """(item_id, id, contained, similarity, exact, place): the exact matches of a quotation, else the most similar bodies.

    candidates: (item_id, id, rnk); bodies: (id, body), looked at for candidates only.  similarity:
    1 if the canonical body contains the canonical quotation, else the share of its trigrams that
    the body has.  `contained` tells true containment from all trigrams being there.  Quotations
    under three canonical characters match nothing.
    """
    q = quotes.select("item_id", canonical_quote(F.col("quote")).alias("cq")).filter("length(cq) >= 3").withColumn("grams", trigrams(F.col("cq")))
    found = written(candidates.select("item_id", "id", "rnk"), "quote-candidates")
    texts = bodies.select("id", "body").join(found.select("id").distinct(), "id", "left_semi").select("id", canonical_quote(F.col("body")).alias("cb"))
    texts = texts.withColumn("has", trigrams(F.col("cb")))
    pairs = found.join(q, "item_id").join(texts, "id")
    pairs = pairs.withColumn("contained", F.contains("cb", "cq"))
    share = F.size(F.array_intersect("grams", "has")) / F.size("grams")
    pairs = pairs.withColumn("similarity", F.when(F.col("contained"), 1.0).otherwise(share)).filter("similarity > 0")
    all_ = Window.partitionBy("item_id")
    pairs = pairs.withColumn("exact", F.max("similarity").over(all_) == 1).filter("not exact or similarity = 1")
    order = all_.orderBy(F.desc("similarity"), "rnk")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("item_id", "id", "contained", "similarity", "exact", "place")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").filter("text is not null").select("item_id", F.col("text").alias("quote"))


def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotations, whatever their language, against all documents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    found = quote_candidates(_quotes(spark, sf_dir), document_index(spark, sf_dir), {"text": 1.0}).withColumnRenamed("doc_id", "id")
    got = quote_matches(_quotes(spark, sf_dir), found, docs)
    return got.select("item_id", "id", "contained", F.round("similarity", 6).alias("similarity"), "exact", F.col("place").cast("bigint").alias("place"))


def quote_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of every quotation."""
    return quote_check(spark, sf_dir).filter("place = 1").select("item_id", "id", "similarity", "exact")


def quote_in_originals(quotes: DataFrame, originals: DataFrame, passages: DataFrame, most: int = 5, work: str | None = None) -> DataFrame:
    """(item_id, original_id, id, ref, similarity, exact, place): quotations found in originals, under the first shown passage of the unit.

    originals: (id, work_id, ref_unit, body); passages: (id, work_id, ref_unit, position), shown ones
    only.  An original whose unit has no passage is not shown; of several originals of one passage
    the first counts.  `work` looks in one work only.
    """
    o = originals.filter("body is not null and ref_unit is not null")
    o = o if work is None else o.filter(F.col("work_id") == work)
    first = passages.filter("ref_unit is not null").groupBy("work_id", "ref_unit").agg(F.min_by("id", F.struct("position", "id")).alias("pid"))
    got = quote_matches(quotes, gram_candidates(quotes, o.select("id", "body")), o.select("id", "body"), CANDIDATES)
    got = got.join(o.select("id", "work_id", "ref_unit").join(first, ["work_id", "ref_unit"]), "id")
    once = Window.partitionBy("item_id", "pid").orderBy("place")
    got = got.withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    w = Window.partitionBy("item_id").orderBy("place")
    got = got.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return got.select("item_id", F.col("id").alias("original_id"), F.col("pid").alias("id"), F.col("ref_unit").alias("ref"), "similarity", "exact", "place")


def quote_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotations against the originals of all works."""
    passages = searchable(spark, sf_dir, "work_id", "ref_unit", "position").filter("shown").select("id", "work_id", "ref_unit", "position")
    got = quote_in_originals(_quotes(spark, sf_dir), originals_once(spark, sf_dir), passages)
    return got.select("item_id", "original_id", "id", "ref", F.round("similarity", 6).alias("similarity"), "exact", F.col("place").cast("bigint").alias("place"))


def canonical_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quotes(spark, sf_dir).withColumn("cq", canonical_quote(F.col("quote")))
    return q.select("item_id", "cq", F.size(trigrams(F.col("cq"))).cast("bigint").alias("n_trigrams"))


def work_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the first word of each work's author: the works it names by id, title, original title or author; resolved only if it is one."""
    works = table(spark, sf_dir, "works")
    asked = works.select(F.split("author", " ")[0].alias("asked")).distinct()
    w = works.select("id", F.lower(F.concat_ws("\n", "title", "original_title", "author")).alias("names"))
    hit = asked.join(w, (F.col("asked") == F.col("id")) | F.contains(F.col("names"), F.lower("asked")))  # the catalogue is of fixed size
    return hit.groupBy("asked").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).select("asked", "n", F.when(F.col("n") == 1, F.col("first_id")).alias("resolved"))


QUERIES = {
    "first_passage_per_unit": first_passage_per_unit, "aid_assembly": aid_assembly, "unit_lookup": unit_lookup, "word_count": word_counts, "cut_words": cut_to_share,
    "unit_grouping": unit_grouping, "read_units": read_units, "quote_check": quote_check, "quote_nearest": quote_nearest, "quote_originals": quote_originals, "canonical_quotes": canonical_quotes, "work_resolver": work_resolver,
}

_SEA = ONCE + ", sea AS (SELECT p.*, NOT coalesce(p.is_apparatus, false) AND coalesce(t.quotable, false) AS shown FROM pas p LEFT JOIN texts t ON p.text_id = t.id)"
_ORIG = "orig AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM originals) WHERE rn = 1)"
_AIDS = "aids AS (SELECT work_id, ref_unit, count(*) AS n_passages, string_agg(body, chr(10) || chr(10) ORDER BY position, id) AS aid, arg_min(id, (position, id)) AS first_id FROM sea WHERE shown AND ref_unit IS NOT NULL GROUP BY ALL)"
_RW = r"[\x{2E80}-\x{2FDF}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
_STOP = "(" + _STOP_SQL + ")"
_SAME = "CASE WHEN regexp_matches({0}, '[^\\x00-\\x7F]') THEN translate({0}, '" + COMPATIBLE[0].replace("{", "{{").replace("}", "}}") + "', '" + COMPATIBLE[1].replace("'", "''").replace("{", "{{").replace("}", "}}") + "') ELSE {0} END"
_CANON = r"regexp_replace(lower(regexp_replace(" + _SAME + r", '\([0-9]+(\.[0-9]+)*\)', '', 'g')), '[\p{{P}}\p{{S}}\p{{Z}}\s]+', '', 'g')"
_GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3))) ELSE [] END"
_RANKED = """
  s AS (SELECT item_id, id, rnk, contains(cb, cq) AS contained, CASE WHEN contains(cb, cq) THEN 1.0::DOUBLE ELSE len(list_filter(grams, lambda g: contains(cb, g)))::DOUBLE / len(grams) END AS similarity FROM p),
  x AS (SELECT *, max(similarity) OVER (PARTITION BY item_id) = 1 AS exact FROM s WHERE similarity > 0),
  r AS (SELECT item_id, id, contained, round(similarity, 6) AS similarity, exact, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, rnk) AS place FROM x WHERE NOT exact OR similarity = 1)
"""
_Q = f"q0 AS (SELECT item_id, text, {_CANON.format('text')} AS cq FROM eval_items WHERE text IS NOT NULL), q AS (SELECT *, {_GRAMS.format('cq')} AS grams FROM q0 WHERE length(cq) >= 3)"
_QUOTE_SQL = rf"""
  WITH {_Q}, docs AS MATERIALIZED (SELECT doc_id AS id, text AS body, {_CANON.format('text')} AS cb FROM documents WHERE text IS NOT NULL),
  terms AS (SELECT DISTINCT item_id, t AS term FROM (SELECT item_id, unnest({_toks('text')}) AS t FROM q0) WHERE length(t) > 1 AND t NOT IN {_STOP}),
  tok AS (SELECT id, {_toks('body')} AS ts FROM docs),
  st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
  tf AS (SELECT id, dl, term, count(*) AS f FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT tf.term, id, (CASE WHEN n - df + 0.5 <= df + 0.5 THEN 1e-6 ELSE ln((n - df + 0.5)::DOUBLE / (df + 0.5)::DOUBLE) END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM tf JOIN df USING (term), st),
  sc AS (SELECT item_id, id, sum(w) AS score FROM terms JOIN w USING (term) GROUP BY ALL),
  c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rnk FROM sc),
  p AS (SELECT c.item_id, c.id, c.rnk, cq, grams, cb FROM c JOIN q USING (item_id) JOIN docs ON docs.id = c.id WHERE rnk <= 50),
  {_RANKED}
"""
_RUNS = r"list_distinct(flatten(list_transform(regexp_split_to_array(lower({0}), '[\p{{P}}\p{{S}}\p{{Z}}\s]+'), lambda w: CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) ELSE [] END)))"
_ORIGINAL_SQL = rf"""
  WITH {ONCE}, {_Q}, orig AS MATERIALIZED (SELECT * EXCLUDE (rn), {_CANON.format('body')} AS cb FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM originals) WHERE rn = 1 AND body IS NOT NULL AND ref_unit IS NOT NULL),
  fp AS (SELECT p.work_id, p.ref_unit, arg_min(p.id, (p.position, p.id)) AS pid FROM pas p JOIN texts t ON p.text_id = t.id WHERE t.quotable AND NOT coalesce(p.is_apparatus, false) AND p.ref_unit IS NOT NULL GROUP BY ALL),
  ask AS (SELECT item_id, unnest({_RUNS.format('text')}) AS g FROM q0), has AS (SELECT id, unnest({_RUNS.format('body')}) AS g FROM orig),
  df AS (SELECT g, ln(1 + (SELECT count(*) FROM orig)::DOUBLE / count(*)) AS w FROM has GROUP BY g),
  sc AS (SELECT item_id, id, sum(w) AS score FROM ask JOIN has USING (g) JOIN df USING (g) GROUP BY ALL),
  c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rnk FROM sc),
  p AS (SELECT c.item_id, c.id, c.rnk, cq, grams, cb FROM c JOIN q USING (item_id) JOIN orig ON orig.id = c.id WHERE rnk <= 50),
  {_RANKED},
  y AS (SELECT r.*, pid, o.ref_unit AS ref, row_number() OVER (PARTITION BY item_id, pid ORDER BY place) AS nth FROM (SELECT * FROM r WHERE place <= 50) r JOIN orig o ON o.id = r.id JOIN fp ON fp.work_id = o.work_id AND fp.ref_unit = o.ref_unit)
  SELECT item_id, id AS original_id, pid AS id, ref, similarity, exact, row_number() OVER (PARTITION BY item_id ORDER BY place) AS place FROM y WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY place) <= 5
"""
_WCOUNT = "len(regexp_extract_all(coalesce(text, ''), '" + _RW + r"|[^\s" + _RW[1:-1] + r"]*[\p{L}\p{N}][^\s" + _RW[1:-1] + "]*'))"
ORACLES = {
    "first_passage_per_unit": f"WITH {_SEA} SELECT work_id, ref_unit, arg_min(id, (position, id)) AS first_id, count(*) AS n_passages FROM sea WHERE shown AND ref_unit IS NOT NULL GROUP BY ALL",
    "aid_assembly": f"WITH {_SEA}, {_AIDS} SELECT work_id, ref_unit, n_passages, first_id, md5(aid) AS aid_md5, length(aid) AS aid_chars FROM aids",
    "unit_lookup": f"WITH {_SEA}, {_AIDS}, {_ORIG}, o AS (SELECT work_id, ref_unit, min(id) AS original_id, arg_min(language, id) AS language FROM orig WHERE ref_unit IS NOT NULL GROUP BY ALL), t AS (SELECT work_id, arg_min(coalesce(translator, '~'), id) AS translator, arg_min(coalesce(year, -1), id) AS year FROM texts WHERE quotable GROUP BY ALL) SELECT a.work_id, a.ref_unit, w.author, w.title, nullif(t.translator, '~') AS translator, nullif(t.year, -1)::BIGINT AS year, n_passages, original_id, language FROM aids a LEFT JOIN o USING (work_id, ref_unit) LEFT JOIN works w ON w.id = a.work_id LEFT JOIN t ON t.work_id = a.work_id",
    "word_count": f"SELECT doc_id, {_WCOUNT} AS n_words FROM documents",
    "unit_grouping": f"WITH {_SEA}, lg AS (SELECT DISTINCT id AS request_id, passage_ids FROM usage_log WHERE passage_ids IS NOT NULL AND tool = 'read_passages'), ex AS (SELECT request_id, unnest(range(0, len(ids))) AS pos, unnest(ids) AS pid FROM (SELECT request_id, from_json(passage_ids, '[\"VARCHAR\"]') AS ids FROM lg)), rq AS (SELECT request_id, pid, min(pos) AS pos FROM ex WHERE pid IS NOT NULL GROUP BY ALL), h AS (SELECT rq.*, s.work_id, s.ref_unit FROM rq LEFT JOIN (SELECT * FROM sea WHERE shown AND ref_unit IS NOT NULL) s ON s.id = rq.pid), m AS (SELECT request_id, count(*) FILTER (WHERE ref_unit IS NULL) AS n_missing, count(DISTINCT (work_id, ref_unit)) FILTER (WHERE ref_unit IS NOT NULL) AS n_units FROM h GROUP BY ALL) SELECT request_id, work_id, ref_unit, min(pos) AS first_pos, count(*) AS n_hits, n_missing, (6000 // greatest(n_units, 1))::BIGINT AS share FROM h JOIN m USING (request_id) WHERE ref_unit IS NOT NULL GROUP BY request_id, work_id, ref_unit, n_missing, n_units",
    "quote_check": _QUOTE_SQL + "SELECT * FROM r WHERE place <= 5",
    "quote_nearest": _QUOTE_SQL + "SELECT item_id, id, similarity, exact FROM r WHERE place = 1",
    "quote_originals": _ORIGINAL_SQL,
    "canonical_quotes": f"WITH q AS (SELECT item_id, {_CANON.format('text')} AS cq FROM eval_items WHERE text IS NOT NULL) SELECT item_id, cq, len({_GRAMS.format('cq')}) AS n_trigrams FROM q",
    "work_resolver": "WITH a AS (SELECT DISTINCT split_part(author, ' ', 1) AS asked FROM works), h AS (SELECT asked, id FROM a JOIN works w ON asked = id OR contains(lower(concat_ws(chr(10), title, original_title, author)), lower(asked))) SELECT asked, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS resolved FROM h GROUP BY asked",
}
