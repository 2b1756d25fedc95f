"""A persisted word index: postings with places, lengths and statistics of a text table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.porter import stem
from textloom.functions.shared import broadcast_if_small, shared_dir, written
from textloom.functions.text import ACCENTS, WORD, words

K1, B = 1.2, 0.75
#: To be raised with any change of what an index holds, so that none of an older kind is read.
FORMAT = 1


@dataclass(frozen=True)
class Phrase:
    """One unit of a keyword query: words that must stand next to each other."""

    words: tuple[str, ...]


@dataclass
class Index:
    """postings: (term, key, col, dl, places), sorted by term so that a query reads the parts its words stand in; stats: one row (n, avgdl, longest)."""

    key: str
    columns: list[str]
    postings: DataFrame
    stats: DataFrame
    stemmed: bool


def write_index(rows: DataFrame, key: str, columns: list[str], path: str, stemmed: bool = False) -> None:
    """Write the index of some text columns.  Null text counts as empty, rows with a null key are left out; keys must be unique.

    Postings are range-partitioned by term and key, so the postings of a word that every row holds
    are spread over many files.  With `stemmed`, terms are Porter stems, which are worked out once
    for each different word and joined in.
    """
    t = rows.filter(F.col(key).isNotNull()).select(F.col(key), *[words(F.col(c)).alias(f"_{k}") for k, c in enumerate(columns)])
    t = t.withColumn("dl", sum((F.size(f"_{k}") for k in range(len(columns))), F.lit(0)))
    t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.max("dl").alias("longest")).write.mode("overwrite").parquet(f"{path}/stats")
    cells = F.array(*[F.struct(F.lit(k).alias("col"), F.col(f"_{k}").alias("ts")) for k in range(len(columns))])
    tokens = t.select(key, "dl", F.explode(cells).alias("c")).select(key, "dl", "c.col", F.posexplode("c.ts").alias("place", "term"))
    if stemmed:
        of = F.pandas_udf(lambda s: s.map(stem), "string")
        vocabulary = tokens.select("term").distinct().select("term", of("term").alias("stem")).filter("stem <> term")
        tokens = tokens.join(vocabulary, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")
    postings = tokens.groupBy("term", key, "col", "dl").agg(F.sort_array(F.collect_list("place")).alias("places"))
    postings.orderBy("term", key).write.mode("overwrite").parquet(f"{path}/postings")


def read_index(spark: SparkSession, key: str, columns: list[str], path: str, stemmed: bool = False) -> Index:
    return Index(key, columns, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), stemmed)


def kept_index(spark: SparkSession, source: str, rows: Callable[[], DataFrame], key: str, columns: list[str], name: str, stemmed: bool = False) -> Index:
    """The index of a table, from the shared folder if it was built for this state of its files, else built now.

    It is written beside its final name and renamed when whole, so a reader sees all of it or none;
    of two that build at once the second finds the first one's.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    status = at.getFileSystem(conf).getFileStatus(at)
    state = f"{source} {status.getLen()} {status.getModificationTime()} {columns} {stemmed} {FORMAT} {WORD} {ACCENTS}"
    path = f"{shared_dir(spark)}/textloom-index/{name}-{hashlib.md5(state.encode()).hexdigest()}"
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    if not fs.exists(final):
        build = f"{path}.{spark.sparkContext.applicationId}"
        write_index(rows(), key, columns, build, stemmed)
        if fs.exists(final) or not fs.rename(jvm.org.apache.hadoop.fs.Path(build), final):
            fs.delete(jvm.org.apache.hadoop.fs.Path(build), True)
    return read_index(spark, key, columns, path, stemmed)


def _back(k: int) -> Callable[[Column], Column]:
    return lambda place: place - k


def _found(row: dict[str, Column], phrase: Phrase) -> Column:
    """How often a phrase stands in a row of places by term; occurrences may overlap."""
    at = row[phrase.words[0]]
    for k, w in enumerate(phrase.words[1:], 1):
        at = F.array_intersect(at, F.transform(row[w], _back(k)))
    return F.coalesce(F.size(at), F.lit(0)) if len(phrase.words) > 1 else F.coalesce(F.size(row[phrase.words[0]]), F.lit(0))


def bm25(index: Index, weights: dict[str, float], phrases: list[Phrase]) -> DataFrame:
    """(key, hits, score) of the rows with at least one of the phrases: Okapi BM25.

    weights: column -> weight; columns without one are not looked at, but lengths and the average
    are those of all columns.  Only the query's postings are read.  No phrase, no row.
    """
    if index.stemmed:
        phrases = [Phrase(tuple(map(stem, p.words))) for p in phrases]
    terms = sorted({w for p in phrases for w in p.words})
    number = {c: k for k, c in enumerate(index.columns)}
    key = index.key
    some = index.postings.filter(F.col("term").isin(terms) & F.col("col").isin([number[c] for c in weights]))
    row = {t: F.col(f"_t{k}") for k, t in enumerate(terms)}
    cells = some.groupBy(key, "dl", "col").agg(F.lit(0).alias("_"), *[F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"_t{k}") for k, t in enumerate(terms)])
    weight = F.coalesce(*[F.when(F.col("col") == number[c], F.lit(float(w))) for c, w in weights.items()], F.lit(0.0))
    cells = cells.select(key, "dl", weight.alias("_w"), *[_found(row, p).alias(f"_f{k}") for k, p in enumerate(phrases)])
    each = cells.groupBy(key, "dl").agg(F.lit(0).alias("_"), *[F.sum(F.col(f"_f{k}") * F.col("_w")).alias(f"_f{k}") for k in range(len(phrases))])
    stats = each.agg(F.lit(0).alias("_0"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_df{k}") for k in range(len(phrases))]).crossJoin(index.stats)  # one row
    t = each.crossJoin(F.broadcast(stats))
    score, hits = F.lit(0.0), F.lit(0)
    for k in range(len(phrases)):
        f = F.col(f"_f{k}")
        idf = F.log((F.col("n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        score = score + F.when(f > 0, F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
        hits = hits + F.when(f > 0, 1).otherwise(0)
    return t.select(key, hits.alias("hits"), score.alias("score")).filter("hits > 0")


def bm25_many(index: Index, weights: dict[str, float], queries: DataFrame) -> DataFrame:
    """(query_id, key, score) for many queries at once: every row that shares a term with a query.

    queries: (query_id, term), a row for each different term.  Terms and postings meet by a join on
    the term; a term of very many rows is spread over parts of its postings by their key.
    """
    key = index.key
    number = {c: k for k, c in enumerate(index.columns)}
    wanted = broadcast_if_small(queries.select("term").distinct())
    some = index.postings.filter(F.col("col").isin([number[c] for c in weights])).join(wanted, "term", "left_semi")
    weight = F.coalesce(*[F.when(F.col("col") == number[c], F.lit(float(w))) for c, w in weights.items()], F.lit(0.0))
    tf = some.groupBy("term", key, "dl").agg(F.sum(F.size("places") * weight).alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(index.stats)).select("term", key, part.alias("w"))  # one row
    return queries.join(weighed, "term").groupBy("query_id", key).agg(F.sum("w").alias("score"))


#: Rows and words of a block of an inverted table, and queries of a block.
BLOCK, BLOCK_WORDS, QUERY_BLOCK = 16_384, 4_000_000, 1_024


def _row(**columns: pa.Array) -> pa.RecordBatch:
    """One row whose columns are lists."""
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns.values()], names=list(columns))


def _inverted(keys: pa.Array, texts: pa.ListArray) -> pa.RecordBatch:
    """Rows of words as one row: for each different word how many rows hold it, and these rows by number with their counts."""
    n, lengths = len(keys), texts.value_lengths().to_numpy(zero_copy_only=False)
    coded = texts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
    df = np.bincount(pairs // max(1, n), minlength=len(coded.dictionary))
    ints = lambda v: pa.array(v.astype(np.int32))
    return _row(keys=keys, dl=ints(lengths), terms=coded.dictionary, df=ints(df), places=ints(pairs % max(1, n)), tf=ints(tf))


def inverted_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(keys, dl, terms, df, places, tf): the words of rows in blocks of at most BLOCK rows and, but for a longer single row, BLOCK_WORDS words.  Null keys and texts are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, many = [], 0, 0
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(batch):
                before = ends[at - 1] if at else 0
                stop = int(min(at + BLOCK - some, np.searchsorted(ends, before + BLOCK_WORDS - many, "right")))
                if stop <= at and not held:
                    stop = at + 1
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    some, many, at = some + stop - at, many + int(ends[stop - 1] - before), stop
                if at < len(batch):
                    yield _inverted(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)))
                    held, some, many = [], 0, 0
        if held:
            yield _inverted(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)))

    known = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, words(F.col(text)).alias("ts"))
    return known.mapInArrow(pack, f"keys array<{kind}>, dl array<int>, terms array<string>, df array<int>, places array<int>, tf array<int>")


def _asked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(query_id, terms, idf) as blocks of queries: the different terms with their idf, and for each query the numbers of its terms."""
    for batch in batches:
        for k in range(0, len(batch), size):
            part = batch.slice(k, size)
            coded = part.column("terms").flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            idf = np.zeros(len(coded.dictionary))
            idf[codes] = part.column("idf").flatten().to_numpy(zero_copy_only=False)
            yield _row(query_ids=part.column("query_id"), n_terms=part.column("terms").value_lengths(), asked=coded.dictionary, idf=pa.array(idf), codes=coded.indices)


def _best_of_block(r: dict[str, pa.Array], avgdl: float, k: int, least: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, score) of the k best rows of a block for each query of another, without those under what the task has already found for it."""
    x = {c: v.to_numpy(zero_copy_only=False) for c, v in r.items() if c not in ("terms", "asked")}
    keys, n = x["keys"], len(x["keys"])
    norm = K1 * (1 - B + B * x["dl"] / (avgdl or 1.0))
    # idf of the block's words, 0 where no query asks for one
    at = pc.index_in(r["asked"], value_set=r["terms"]).fill_null(-1).to_numpy(zero_copy_only=False)
    idf = np.zeros(len(x["df"]))
    idf[at[at >= 0]] = x["idf"][at >= 0]
    weight = np.repeat(idf, x["df"]) * x["tf"] * (K1 + 1) / (x["tf"] + norm[x["places"]])
    places = x["places"].astype(np.int64)
    last = np.cumsum(x["df"])
    first = last - x["df"]
    own: dict[int, list[int]] = {}
    for p in np.flatnonzero(np.isin(keys, x["query_ids"])):
        own.setdefault(keys[p], []).append(p)
    out_q, out_p, out_s, begin = [], [], [], 0
    for q, m in zip(x["query_ids"].tolist(), x["n_terms"].tolist()):
        terms = at[x["codes"][begin : begin + m]]
        begin += m
        terms = np.sort(terms[terms >= 0])
        if not len(terms):
            continue
        some = [slice(a, b) for a, b in zip(first[terms].tolist(), last[terms].tolist())]
        score = np.bincount(np.concatenate([places[s] for s in some]), np.concatenate([weight[s] for s in some]), n)
        score[own.get(q, [])] = 0
        hit = np.flatnonzero(score > least.get(q, 0.0))
        if len(hit) > k:
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - 1e-6]
        hit = hit[np.lexsort((keys[hit], -np.round(score[hit], 6)))[:k]]
        if len(hit) == k:
            least[q] = score[hit].min() - 2e-6
        out_q.append(np.full(len(hit), q))
        out_p.append(hit)
        out_s.append(score[hit])
    place = np.concatenate([np.zeros(0, np.int64), *out_p])
    return np.concatenate([np.zeros(0, np.int64), *out_q]), keys[place], np.concatenate([np.zeros(0), *out_s])


def bm25_best(rows: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rnk): for each query the k best other rows that share a term with it; scores equal in six places by key.

    queries: (query_id bigint, term), a row for each different term; a query does not find the row of
    its own id.  For query sets that grow with the rows: the rows are inverted in blocks that meet
    blocks of queries in one task, which adds up all scores and passes on the k best of each query,
    so what is shuffled are results and never the pairs.
    """
    kind = rows.schema[key].dataType.simpleString()
    blocks = written(inverted_blocks(rows, key, text), "inverted-blocks")
    whole = blocks.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("dl", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("words")).first()
    n = int(whole["n"] or 0)
    avgdl = int(whole["words"] or 0) / max(1, n)
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = queries.join(df, "term").select("query_id", "term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))
    gathered = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("ts")).select("query_id", F.col("ts.term").alias("terms"), F.col("ts.idf").alias("idf"))
    asked = written(gathered.mapInArrow(lambda it: _asked(it, QUERY_BLOCK), "query_ids array<bigint>, n_terms array<int>, asked array<string>, idf array<double>, codes array<int>"), "query-blocks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, float] = {}
        for batch in batches:
            of = batch.schema.field("keys").type.value_type
            for i in range(len(batch)):
                q, found, score = _best_of_block({c: batch.column(c)[i].values for c in batch.schema.names}, avgdl, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found, of), pa.array(score)], names=["query_id", key, "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), key)
    met = blocks.crossJoin(asked)  # blocks, not rows
    return met.mapInArrow(look, f"query_id bigint, `{key}` {kind}, score double").withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)
