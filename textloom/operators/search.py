"""Keyword, vector and fused retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import opening, query_words, words
from textloom.operators.index import Index, Phrase, bm25, bm25_best, kept_index
from textloom.sources.tables import delivered_once, table

CANDIDATES, FUSED, PER_WORK, RRF_K = 50, 20, 3, 60
# Function words that only the second keyword pass leaves out.
STOP_WORDS = (
    "a about am an and are as at be been but by can could did do does for from had has have he "
    "her his how i if in into is it its me my no not of on or our she should so than that the "
    "their them then there these they this those to us was we were what when where which who "
    "why will with would you your"
).split()


def compile_query(text: str, skip_stop_words: bool = False) -> list[Phrase]:
    """Quoted spans and single terms; parts without a letter or digit disappear, inner marks make a phrase.

    Quoted phrases survive the stop-word list even if they consist of stop words.
    """
    out = []
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', text):
        found = tuple(query_words(quoted or bare))
        if found and not (skip_stop_words and bare and "".join(found) in STOP_WORDS):
            out.append(Phrase(found))
    return list(dict.fromkeys(out))


#: Lengths that requests may have.
LIMITS = {"query": (2, 500), "id": (1, 100), "quote": (3, 2_000), "work": (1, 200), "filter": (0, 100), "concept": (1, 100)}


def validated(kind: str, value: str) -> str:
    """The value if its length is allowed for its kind of request, else ValueError."""
    low, high = LIMITS[kind]
    if not low <= len(value) <= high:
        raise ValueError(f"a {kind} has {low} to {high} characters, not {len(value)}")
    return value


def keyword_topk(scored: DataFrame, key: str, n_phrases: int, every: bool, k: int = CANDIDATES) -> DataFrame:
    """Best k rows that match every phrase (or any); equal scores by key."""
    wanted = scored.filter(F.col("hits") == n_phrases) if every else scored
    return wanted.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def two_pass(index: Index, weights: dict[str, float], query: str, shown: DataFrame | None = None, k: int = CANDIDATES) -> DataFrame:
    """(key, tier, score, rnk): rows with every phrase first, filled up with rows with any phrase but stop words.

    shown: (key) of the rows that may be found (default: all); the others count in the statistics
    only.  A query without any phrase finds nothing; one made only of stop words is not thinned.
    """
    key = index.key
    every = compile_query(query)
    some = compile_query(query, skip_stop_words=True) or every
    if not every:
        return index.postings.select(key, F.lit(0).alias("tier"), F.lit(0.0).alias("score"), F.lit(0).alias("rnk")).limit(0)

    def best_of(phrases: list[Phrase], all_of_them: bool, most: int, tier: int) -> DataFrame:
        found = bm25(index, weights, phrases)
        found = found if shown is None else found.join(shown, key, "left_semi")
        return keyword_topk(found, key, len(phrases), all_of_them, most).select(key, "score", F.lit(tier).alias("tier"))

    both = first = best_of(every, True, k, 0)
    if some != every or len(some) > 1:  # a single phrase is the same query either way
        both = first.unionByName(best_of(some, False, 2 * k, 1).join(F.broadcast(first.select(key)), key, "left_anti"))  # at most k rows
    best = both.orderBy("tier", F.desc(F.round("score", 9)), key).limit(k)
    return best.withColumn("rnk", F.row_number().over(Window.orderBy("tier", F.desc(F.round("score", 9)), key)))  # of k rows


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalised(v: Column) -> Column:
    """A vector of unit length; the zero vector stays."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(F.transform(d, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


#: Vectors and query vectors that meet in one task's matrix product.
BLOCK, QUERY_BLOCK = 4_096, 512


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows packed into blocks: (name_keys, name_vectors flat), `size` rows at most; rows with a null key or vector are left out."""
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), size):
                part = pdf[k : k + size]
                yield pd.DataFrame({f"{name}_keys": [part[key].tolist()], f"{name}_vectors": [np.concatenate(part[vector].to_list()).astype(float)]})

    known = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    return known.mapInPandas(pack, f"{name}_keys array<{kind}>, {name}_vectors array<double>")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, k: int = CANDIDATES, itself: bool = True) -> DataFrame:
    """(query_id, key, sim, rnk): for each query (query_id, q) the k vectors nearest by cosine, exact; equal ones by key.

    The stated queries meet all vectors in blocks: a matrix product, of which a block keeps the k
    best for each query.  The zero vector has cosine 0 to all.  `itself`: a query may find the
    vector of its own id.
    """
    kind = vectors.schema[key].dataType.simpleString()
    met = _blocks(vectors, key, "embedding", BLOCK, "v").crossJoin(_blocks(queries, "query_id", "q", QUERY_BLOCK, "q"))  # blocks, not rows

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, asked = np.array(r.v_keys), np.array(r.q_keys)
                sides = []
                for flat, n in ((r.v_vectors, len(ids)), (r.q_vectors, len(asked))):
                    m = np.asarray(flat, float).reshape(n, -1)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    sides.append(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
                sim = sides[1] @ sides[0].T
                if not itself:
                    sim[asked[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, 9)), axis=1)[:, :k]
                best = np.take_along_axis(sim, order, 1)
                flat = pd.DataFrame({"query_id": np.repeat(asked, order.shape[1]), key: ids[order].ravel(), "sim": best.ravel()})
                yield flat[np.isfinite(flat["sim"])]

    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), key)
    return met.mapInPandas(look, f"query_id bigint, `{key}` {kind}, sim double").withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def knn(vectors: DataFrame, query: DataFrame, key: str, k: int = CANDIDATES) -> DataFrame:
    """(key, sim, rnk) of the k vectors nearest to one query vector (column q)."""
    return nearest(vectors, query.select(F.lit(0).cast("bigint").alias("query_id"), "q"), key, k).drop("query_id")


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, fused, first_list, first_rank): reciprocal rank fusion; equal sums keep the earlier list's order."""
    ranked = None
    for n, x in enumerate(lists):
        part = x.select(key, (1.0 / (k + F.col("rnk"))).alias("s"), F.struct(F.lit(n).alias("l"), F.col("rnk").alias("r")).alias("at"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(key).agg(F.sum("s").alias("fused"), F.min("at").alias("at")).select(key, "fused", F.col("at.l").alias("first_list"), F.col("at.r").alias("first_rank"))


def capped(fused: DataFrame, group: str, key: str, per_group: int = PER_WORK, k: int = FUSED) -> DataFrame:
    """At most per_group rows of a group, then the best k."""
    order = [F.desc(F.round("fused", 12)), "first_list", "first_rank"]
    within = fused.withColumn("in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("in_group") <= per_group)
    return within.orderBy(*order).limit(k)


def snippets(rows: DataFrame, text: str, terms: list[str], size: int = 40) -> DataFrame:
    """rows + snippet: the earliest window of `size` words that begins at a match and holds most matches."""
    tokens = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    rows = rows.withColumn("_w", tokens).withColumn("_m", F.transform("_w", lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "").isin(terms).cast("int")))
    at = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.struct(F.aggregate(F.slice("_m", i, size), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("i")))
    start = -F.array_max(F.filter(at, lambda s: (F.element_at("_m", -s["i"]) == 1) | (s["i"] == -1)))["i"]
    rows = rows.withColumn("_at", start)
    body = F.array_join(F.slice("_w", F.col("_at"), size), " ")
    text_out = F.concat(F.when(F.col("_at") > 1, "… ").otherwise(""), body, F.when(F.col("_at") + size - 1 < F.size("_w"), " …").otherwise(""))
    return rows.withColumn("snippet", text_out).drop("_w", "_m", "_at")


# ---- queries ------------------------------------------------------------------------------------

QUERY = "the silver journey of a patient harbour"
ALL_QUERY = "the silver harbour"


WEIGHTS = {"body": 1.0, "keywords": 0.4}


def passages_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    p = table(spark, sf_dir, "passages")
    return delivered_once(p.select(*dict.fromkeys(["id", "created_at", *columns])) if columns else p, "id", "created_at")


def searchable(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Passages with a flag for those that may be shown: no apparatus, of a quotable text."""
    texts = table(spark, sf_dir, "texts").select(F.col("id").alias("text_id"), "quotable")
    p = passages_once(spark, sf_dir, *(["text_id", "is_apparatus", *columns] if columns else []))
    return p.join(texts, "text_id", "left").withColumn("shown", ~F.coalesce("is_apparatus", F.lit(False)) & F.coalesce("quotable", F.lit(False)))


def passage_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> Index:
    rows = lambda: passages_once(spark, sf_dir, "body", "keywords")
    return kept_index(spark, f"{sf_dir}/passages.parquet", rows, "id", ["body", "keywords"], "passages", stemmed)


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    rows = lambda: table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    return kept_index(spark, f"{sf_dir}/documents.parquet", rows, "doc_id", ["text"], "documents")


def _shown(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return searchable(spark, sf_dir, "work_id").filter("shown").select("id", *columns)


def _bm25_query(spark: SparkSession, sf_dir: str, query: str, every: bool, weights: dict[str, float] = WEIGHTS, stemmed: bool = False) -> DataFrame:
    phrases = compile_query(query, skip_stop_words=not every)
    scored = bm25(passage_index(spark, sf_dir, stemmed), weights, phrases).join(_shown(spark, sf_dir, "work_id"), "id")
    return keyword_topk(scored, "id", len(phrases), every).select("id", "work_id", F.round("score", 6).alias("score"))


def bm25_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other documents for the words of every document whose id is divisible by 100."""
    terms = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    terms = terms.filter((F.length("term") > 1) & ~F.col("term").isin(STOP_WORDS))
    best = bm25_best(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", terms, 10)
    return best.select("query_id", F.col("rnk").cast("bigint").alias("rnk"), "doc_id", F.round("score", 4).alias("score"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, col, n_rows, n_places): document and collection frequency."""
    index = passage_index(spark, sf_dir)
    name = F.when(F.col("col") == 0, "body").otherwise("keywords")
    return index.postings.groupBy("term", name.alias("col")).agg(F.count("*").alias("n_rows"), F.sum(F.size("places")).alias("n_places"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.col("longest").cast("bigint").alias("longest"))


def two_pass_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = two_pass(passage_index(spark, sf_dir), WEIGHTS, ALL_QUERY, _shown(spark, sf_dir))
    return out.select("id", F.col("tier").cast("bigint").alias("tier"), F.round("score", 6).alias("score"), F.col("rnk").cast("bigint").alias("rnk"))


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = [Phrase(("the", "silver")), Phrase(("does", "not"))]
    scored = bm25(passage_index(spark, sf_dir), WEIGHTS, phrases).join(_shown(spark, sf_dir), "id", "left_semi")
    return scored.select("id", F.col("hits").cast("bigint").alias("hits"), F.round("score", 6).alias("score"))


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.min_by("embedding", "vec_id").alias("q"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _query_vectors(spark, sf_dir), "vec_id")
    return out.select("query_id", "vec_id", F.round("sim", 6).alias("sim"), F.col("rnk").cast("bigint").alias("rnk"))


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalised(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return e.select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.col("v")[0], 6).alias("v0"))


def _hybrid(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """With vectors, or without as when no query vector can be had."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", "source")
    lists = [two_pass(document_index(spark, sf_dir), {"text": 1.0}, QUERY)]
    if with_vectors:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
        lists.append(knn(vectors, _query_vector(spark, sf_dir), "doc_id"))
    fused = rrf(lists, "doc_id")
    return docs.join(F.broadcast(fused), "doc_id")  # at most 2 x CANDIDATES rows


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused keyword and vector search, at most three documents of a source, with their openings."""
    best = capped(_hybrid(spark, sf_dir), "source", "doc_id")
    return best.select("doc_id", "source", F.round("fused", 9).alias("fused"), opening(F.col("text")).alias("opening"))


def degraded_keyword_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without vectors, as when no embedding can be had."""
    best = capped(_hybrid(spark, sf_dir, False), "source", "doc_id")
    return best.select("doc_id", "source", F.round("fused", 9).alias("fused"), F.lit(True).alias("degraded"))


def cap_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best passages of every work for one query."""
    phrases = compile_query(QUERY, skip_stop_words=True)
    scored = bm25(passage_index(spark, sf_dir), WEIGHTS, phrases).join(_shown(spark, sf_dir, "work_id"), "id")
    w = Window.partitionBy("work_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rnk", F.row_number().over(w)).filter("rnk <= 3").select("work_id", "id", F.col("rnk").cast("bigint").alias("rnk"), F.round("score", 6).alias("score"))


def match_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ["silver", "journey", "harbour"]
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").rlike(r"\b(silver|journey|harbour)\b")).select("doc_id", "text")
    return snippets(docs, "text", terms).select("doc_id", "snippet")


def opening_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", opening(F.col("text")).alias("opening"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10 of every hundredth vector: relevant are the vectors of its label, hits its ten nearest among all others."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    top = nearest(e, _query_vectors(spark, sf_dir), "vec_id", 10, itself=False).withColumnRenamed("query_id", "q_id")
    label = e.select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"))
    top = top.join(e.select("vec_id", "label"), "vec_id").join(label, "q_id")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    hit = top.groupBy("q_id", "q_label").agg(F.count(F.when(F.col("label") == F.col("q_label"), 1)).alias("n_hit"))
    out = hit.join(sizes, hit["q_label"] == sizes["label"])
    return out.select("q_id", "n_hit", "n_relevant", F.round(F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_relevant")), 6).alias("recall"))


def mean_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recall_at_k(spark, sf_dir)
    return r.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count(F.when(F.col("recall") < 0.7, 1)).alias("n_below"))


QUERIES = {
    "postings_stats": postings, "corpus_stats": corpus_stats,
    "bm25_all_terms": lambda s, d: _bm25_query(s, d, ALL_QUERY, True), "bm25_any_terms": lambda s, d: _bm25_query(s, d, QUERY, False),
    "column_filtered_match": lambda s, d: _bm25_query(s, d, QUERY, False, {"body": 1.0}),
    "bm25_stemmed": lambda s, d: _bm25_query(s, d, "journeys of patient harbours", False, stemmed=True), "bm25_query_set": bm25_query_set, "two_pass_fill": two_pass_fill, "phrase_match": phrase_match,
    "knn_cosine": knn_cosine, "l2_normalise": l2_normalise, "rrf_hybrid": rrf_hybrid, "degraded_keyword_only": degraded_keyword_only, "cap_per_work": cap_per_work,
    "match_snippet": match_snippet, "opening_snippet": opening_snippet, "recall_at_k": recall_at_k, "mean_recall": mean_recall,
}

# ---- the same in SQL ------------------------------------------------------------------------------

ONCE = "pas AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM passages WHERE id IS NOT NULL) WHERE rn = 1)"
_SHOWN = ONCE + ", sea AS (SELECT p.*, NOT coalesce(p.is_apparatus, false) AND coalesce(t.quotable, false) AS shown FROM pas p LEFT JOIN texts t ON p.text_id = t.id)"


def _toks(c: str) -> str:
    return rf"regexp_extract_all(replace(strip_accents(lower(coalesce({c}, ''))), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+')"


def _ph(*words_of: str) -> list[Phrase]:
    return [Phrase(tuple(w.split())) for w in words_of]


# The queries' phrases as the oracles take them: written out, not compiled.
_EVERY, _SOME = _ph("the", "silver", "journey", "of", "a", "patient", "harbour"), _ph("silver", "journey", "patient", "harbour")
_ALL_EVERY, _ALL_SOME = _ph("the", "silver", "harbour"), _ph("silver", "harbour")


def _bm25_sql(name: str, source: str, key: str, columns: dict[str, float], phrases: list[Phrase], body_only: bool = False) -> str:
    """CTEs that end in {name}(key, hits, score)."""
    toks = ", ".join(f"{_toks(c)} AS t_{c}" for c in columns)
    dl = " + ".join(f"len(t_{c})" for c in columns)
    counted = list(columns)[:1] if body_only else list(columns)

    def tf(c: str, p: Phrase) -> str:
        if len(p.words) == 1:
            return f"len(list_filter(t_{c}, lambda x: x = '{p.words[0]}'))"
        arr = "[" + ", ".join(f"'{w}'" for w in p.words) + "]"
        return f"len(list_filter(range(1, greatest(len(t_{c}) - {len(p.words) - 2}, 1)), lambda i: list_slice(t_{c}, i, i + {len(p.words) - 1}) = {arr}))"

    raw = ", ".join(f"{tf(c, p)} AS f{k}_{c}" for k, p in enumerate(phrases) for c in counted)
    any_ = {k: " + ".join(f"f{k}_{c}" for c in counted) for k in range(len(phrases))}
    dfs = ", ".join(f"count(*) FILTER (WHERE {any_[k]} > 0) AS df{k}" for k in range(len(phrases)))
    terms = []
    for k in range(len(phrases)):
        f = " + ".join(f"f{k}_{c} * {columns[c]}::DOUBLE" for c in counted)
        idf = f"ln((n - df{k} + 0.5) / (df{k} + 0.5)::DOUBLE)"
        terms.append(f"(CASE WHEN ({f}) > 0 THEN (CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * ({f}) * 2.2::DOUBLE / (({f}) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END)")
    hits = " + ".join(f"(CASE WHEN {any_[k]} > 0 THEN 1 ELSE 0 END)" for k in range(len(phrases)))
    return (
        f"{name}_t AS (SELECT *, {dl} AS dl FROM (SELECT *, {toks} FROM {source})), {name}_r AS (SELECT *, {raw} FROM {name}_t), "
        f"{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM {name}_r), "
        f"{name} AS (SELECT r.*, {hits} AS hits, {' + '.join(terms)} AS score FROM {name}_r r, {name}_s s)"
    )


_W = {"body": 1.0, "keywords": 0.4}


def _top_sql(ph: list[Phrase], every: bool, body_only: bool = False) -> str:
    cond = f"hits = {len(ph)}" if every else "hits > 0"
    return f"WITH {_SHOWN}, {_bm25_sql('b', 'sea', 'id', _W, ph, body_only)} SELECT id, work_id, round(score, 6) AS score FROM b WHERE shown AND {cond} ORDER BY round(score, 9) DESC, id LIMIT 50"


def _two_pass_sql(source: str, key: str, columns: dict[str, float], every: list[Phrase], some: list[Phrase], keep: str) -> str:
    return (
        f"{_bm25_sql('e', source, key, columns, every)}, {_bm25_sql('a', source, key, columns, some)}, "
        f"e50 AS (SELECT {key}, 0 AS tier, score FROM e WHERE {keep} AND hits = {len(every)} ORDER BY round(score, 9) DESC, {key} LIMIT 50), "
        f"a50 AS (SELECT {key}, 1 AS tier, score FROM a WHERE {keep} AND hits > 0 AND {key} NOT IN (SELECT {key} FROM e50) ORDER BY round(score, 9) DESC, {key} LIMIT 50), "
        f"kw AS (SELECT *, row_number() OVER (ORDER BY tier, round(score, 9) DESC, {key}) AS rnk FROM (SELECT * FROM e50 UNION ALL SELECT * FROM a50) ORDER BY tier, round(score, 9) DESC, {key} LIMIT 50)"
    )


_DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))"
_Q = "(SELECT min_by(embedding, vec_id) AS q FROM embeddings)"
_DOCS = "docs AS (SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL)"


def _hybrid_sql(vectors: bool) -> str:
    vec = f", vs AS (SELECT doc_id, row_number() OVER (ORDER BY round(sim, 9) DESC, doc_id) AS rnk FROM (SELECT vec_id AS doc_id, {_DOT} AS sim FROM embeddings, {_Q} WHERE vec_id IN (SELECT doc_id FROM docs)) ORDER BY round(sim, 9) DESC, doc_id LIMIT 50)"
    lists = "SELECT doc_id, 0 AS l, rnk FROM kw" + (" UNION ALL SELECT doc_id, 1, rnk FROM vs" if vectors else "")
    return (
        f"WITH {_DOCS}, {_two_pass_sql('docs', 'doc_id', {'text': 1.0}, _EVERY, _SOME, 'true')}{vec if vectors else ''}, "
        f"fu AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rnk)) AS fused, min(l * 1000 + rnk) AS fst FROM ({lists}) GROUP BY doc_id), "
        f"cp AS (SELECT f.*, d.source, d.text, row_number() OVER (PARTITION BY d.source ORDER BY round(fused, 12) DESC, fst) AS ig FROM fu f JOIN docs d USING (doc_id)) "
    )


_RECALL = """
  WITH q AS (SELECT vec_id AS q_id, embedding AS q, label AS q_label FROM embeddings WHERE vec_id % 100 = 0),
  t AS (SELECT q_id, q_label, e.label, row_number() OVER (PARTITION BY q_id ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])), 9) DESC, e.vec_id) AS rnk FROM embeddings e JOIN q ON e.vec_id <> q.q_id),
  h AS (SELECT q_id, q_label, count(*) FILTER (WHERE label = q_label) AS n_hit FROM t WHERE rnk <= 10 GROUP BY ALL),
  s AS (SELECT label, count(*) - 1 AS n_relevant FROM embeddings GROUP BY label),
  r AS (SELECT q_id, n_hit, n_relevant, round(CASE WHEN n_relevant = 0 THEN 1.0::DOUBLE ELSE n_hit / n_relevant::DOUBLE END, 6) AS recall FROM h JOIN s ON q_label = label)
"""
_PHRASES = _ph("the silver", "does not")
_STOP_SQL = "'a','about','am','an','and','are','as','at','be','been','but','by','can','could','did','do','does','for','from','had','has','have','he','her','his','how','i','if','in','into','is','it','its','me','my','no','not','of','on','or','our','she','should','so','than','that','the','their','them','then','there','these','they','this','those','to','us','was','we','were','what','when','where','which','who','why','will','with','would','you','your'"
ORACLES = {
    "postings_stats": f"WITH {ONCE}, x AS (SELECT id, 'body' AS col, unnest({_toks('body')}) AS term FROM pas UNION ALL SELECT id, 'keywords', unnest({_toks('keywords')}) FROM pas) SELECT term, col, count(DISTINCT id) AS n_rows, count(*)::HUGEINT::BIGINT AS n_places FROM x GROUP BY ALL",
    "corpus_stats": f"WITH {ONCE}, x AS (SELECT len({_toks('body')}) + len({_toks('keywords')}) AS dl FROM pas) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, max(dl)::BIGINT AS longest FROM x",
    "bm25_all_terms": _top_sql(_ALL_EVERY, True),
    "bm25_any_terms": _top_sql(_SOME, False),
    "column_filtered_match": _top_sql(_SOME, False, True),
    "two_pass_fill": f"WITH {_SHOWN}, {_two_pass_sql('sea', 'id', _W, _ALL_EVERY, _ALL_SOME, 'shown')} SELECT id, tier::BIGINT AS tier, round(score, 6) AS score, rnk FROM kw",
    "phrase_match": f"WITH {_SHOWN}, {_bm25_sql('b', 'sea', 'id', _W, _PHRASES)} SELECT id, hits::BIGINT AS hits, round(score, 6) AS score FROM b WHERE shown AND hits > 0",
    "knn_cosine": f"SELECT query_id, vec_id, round(sim, 6) AS sim, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rnk FROM (SELECT query_id, vec_id, {_DOT} AS sim FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0))) WHERE rnk <= 50",
    "bm25_query_set": f"WITH {_DOCS}, tk AS (SELECT doc_id, {_toks('text')} AS ts FROM docs), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tk) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT term, doc_id, (CASE WHEN n - df + 0.5 <= df + 0.5 THEN 1e-6 ELSE ln((n - df + 0.5)::DOUBLE / (df + 0.5)::DOUBLE) END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM tf JOIN df USING (term), st), q AS (SELECT DISTINCT doc_id AS query_id, unnest(ts) AS term FROM tk WHERE doc_id % 100 = 0), s AS (SELECT query_id, doc_id, sum(w) AS score FROM q JOIN w USING (term) WHERE query_id <> doc_id AND length(term) > 1 AND term NOT IN ({_STOP_SQL}) GROUP BY ALL) SELECT query_id, rnk, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rnk FROM s) WHERE rnk <= 10",
    "l2_normalise": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda y: (y * 3)::DOUBLE) AS v FROM embeddings), y AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM x) SELECT vec_id, round(list_dot_product(v, v) / (n * n), 6) AS norm2, round(v[1] / n, 6) AS v0 FROM y",
    "rrf_hybrid": _hybrid_sql(True) + "SELECT doc_id, source, round(fused, 9) AS fused, CASE WHEN length(text) < 300 THEN text ELSE concat(substring(text, 1, 300), '…') END AS opening FROM cp WHERE ig <= 3 ORDER BY round(fused, 12) DESC, fst LIMIT 20",
    "degraded_keyword_only": _hybrid_sql(False) + "SELECT doc_id, source, round(fused, 9) AS fused, true AS degraded FROM cp WHERE ig <= 3 ORDER BY round(fused, 12) DESC, fst LIMIT 20",
    "cap_per_work": f"WITH {_SHOWN}, {_bm25_sql('b', 'sea', 'id', _W, _SOME)} SELECT work_id, id, rnk, score FROM (SELECT work_id, id, row_number() OVER (PARTITION BY work_id ORDER BY round(score, 9) DESC, id) AS rnk, round(score, 6) AS score FROM b WHERE shown AND hits > 0) WHERE rnk <= 3",
    "opening_snippet": "SELECT doc_id, CASE WHEN length(text) < 300 THEN text ELSE concat(substring(text, 1, 300), '…') END AS opening FROM documents WHERE text IS NOT NULL",
    "recall_at_k": _RECALL + "SELECT * FROM r",
    "mean_recall": _RECALL + "SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, count(*) FILTER (WHERE recall < 0.7) AS n_below FROM r",
}
