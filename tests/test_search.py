import sqlite3

import numpy as np
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.porter import stem
from textloom.functions.text import query_words, words
from textloom.operators.index import Phrase, bm25, bm25_best, bm25_many, read_index, write_index
from textloom.operators.search import capped, compile_query, knn, nearest, rrf, two_pass

WEIGHTS = {"body": 1.0, "keywords": 0.4}
DOCS = [(1, "the red ship sails", "harbour"), (2, "a red harbour", None), (3, "ship and harbour of the red ship", ""), (4, None, "ship"), (5, "", None)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    write_index(spark.createDataFrame([*DOCS, (None, "ship", "ship")], "id int, body string, keywords string"), "id", ["body", "keywords"], path)
    return read_index(spark, "id", ["body", "keywords"], path)


def test_query_compiler():
    assert compile_query("-- !!") == []
    assert compile_query("a-b and*") == [Phrase(("a", "b")), Phrase(("and",))]
    assert compile_query('"to be" or not', skip_stop_words=True) == [Phrase(("to", "be"))]


def test_bm25_is_that_of_sqlite(index):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(body, keywords)")
    con.executemany("insert into t(rowid, body, keywords) values (?, ?, ?)", [(i, b or "", k or "") for i, b, k in DOCS])
    for query, asked in (("red OR ship", "red ship"), ('"red ship"', '"red ship"')):
        want = {i: -s for i, s in con.execute("select rowid, bm25(t, 1.0, 0.4) from t where t match ?", [query])}
        got = {r["id"]: r["score"] for r in bm25(index, WEIGHTS, compile_query(asked)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_queries_score_like_one(spark, index):
    queries = spark.createDataFrame([(1, "red"), (1, "ship"), (2, "harbour"), (3, "nowhere")], "query_id int, term string")
    got = {(r["query_id"], r["id"]): r["score"] for r in bm25_many(index, WEIGHTS, queries).collect()}
    want = {(q, r["id"]): r["score"] for q, text in ((1, "red ship"), (2, "harbour")) for r in bm25(index, WEIGHTS, compile_query(text)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_of_blocks_without_a_shuffle_of_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 30))) if x < 60)) for k in range(150)]
    docs[40] = docs[20] = (20, docs[60][1])  # equal scores are put in order by key
    docs[40] = (40, docs[60][1])
    rows = spark.createDataFrame([*docs, (None, "w1 w2"), (999, None)], "id int, body string").repartition(3)
    monkeypatch.setattr("textloom.operators.index.BLOCK", 7)
    monkeypatch.setattr("textloom.operators.index.BLOCK_WORDS", 60)
    monkeypatch.setattr("textloom.operators.index.QUERY_BLOCK", 4)
    queries = spark.createDataFrame([(k, t) for k, text in docs[::10] for t in sorted(set(text.split()))] + [(7000, "nowhere")], "query_id long, term string")
    best = bm25_best(rows, "id", "body", queries, 4)
    plan = best._jdf.queryExecution().executedPlan().toString()  # what is shuffled comes out of the tasks that score, k rows a query and block
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")
    got = {(r["query_id"], r["rnk"]): (r["id"], round(r["score"], 6)) for r in best.collect()}
    write_index(rows.filter("body is not null"), "id", ["body"], str(tmp_path))
    every: dict[int, list] = {}
    for r in bm25_many(read_index(spark, "id", ["body"], str(tmp_path)), {"body": 1.0}, queries).collect():
        if r["id"] != r["query_id"]:
            every.setdefault(r["query_id"], []).append((-round(r["score"], 6), r["id"]))
    assert got == {(q, n): (i, -s) for q, found in every.items() for n, (s, i) in enumerate(sorted(found)[:4], 1)}


def test_phrases_stand_in_order(index):
    assert sorted(r["id"] for r in bm25(index, {"body": 1.0}, [Phrase(("red", "ship"))]).collect()) == [1, 3]


def test_stems_are_those_of_sqlite(spark, tmp_path):
    vocabulary = sorted(set("caresses ponies ties feed agreed plastered motoring conflated hopping falling fizzed failing happy relational valenci digitizer vietnamization decisiveness formaliti triplicate hopeful goodness revival adjustable replacement adoption effective probate rate cease controll roll generalizations oscillators dying said sky y ab".split()))
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(vocabulary)))
    assert {d: t for t, d in con.execute("select term, doc from v")} == {k: stem(w) for k, w in enumerate(vocabulary)}
    write_index(spark.createDataFrame([(1, "ponies hopping")], "id int, body string"), "id", ["body"], str(tmp_path), stemmed=True)
    assert [r["id"] for r in bm25(read_index(spark, "id", ["body"], str(tmp_path), True), {"body": 1.0}, compile_query("hopped pony")).filter("hits = 2").collect()] == [1]


def test_words_of_any_script(spark):
    texts = ["Café déjà-vu", "ΛΌΓΟΣ λόγος", "שָׁלוֹם עולם", "山水 12 Ａb", "İstanbul", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words(F.col("t"))).collect()]
    assert got[:2] == [["cafe", "deja", "vu"], ["λογοσ", "λογοσ"]] and got[5:] == [[], []]
    assert got == [query_words(t or "") for t in texts]


def test_two_passes(spark, index):
    got = two_pass(index, WEIGHTS, "ship sails").orderBy("rnk").collect()
    assert [r["id"] for r in got][0] == 1 and {r["tier"] for r in got} == {0, 1} and {r["id"] for r in got} == {1, 3, 4}
    assert two_pass(index, WEIGHTS, "ship sails", spark.createDataFrame([(3,)], "id int")).count() == 1
    assert two_pass(index, WEIGHTS, "?!").count() == 0 and two_pass(index, WEIGHTS, "the of").count() == 2


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)).round(1)
    v[7] = v[3] = 0
    v[11] = v[10] * 2
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(None, [1.0] * 5), (99, None)], "id int, embedding array<float>")
    monkeypatch.setattr("textloom.operators.search.BLOCK", 7)
    monkeypatch.setattr("textloom.operators.search.QUERY_BLOCK", 3)
    got = {(r["query_id"], r["rnk"]): r["id"] for r in nearest(df, df.filter("id < 12").select(F.col("id").cast("long").alias("query_id"), F.col("embedding").alias("q")), "id", 4, itself=False).collect()}
    unit = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=np.linalg.norm(v, axis=1, keepdims=True) > 0)
    for q in range(12):
        order = sorted((k for k in range(60) if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 5), k))
        assert [round(float(unit[q] @ unit[got[q, n]]), 4) for n in range(1, 5)] == [round(float(unit[q] @ unit[k]), 4) for k in order[:4]]


def test_fusion_keeps_the_first_list_on_ties(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rnk int")
    two = spark.createDataFrame([("c", 1), ("d", 2)], "id string, rnk int")
    got = rrf([one, two], "id").orderBy(F.desc("fused"), "first_list", "first_rank").collect()
    assert [r["id"] for r in got] == ["c", "a", "b", "d"]


def test_cap(spark):
    f = spark.createDataFrame([(k, "w" if k < 6 else "v", 1.0 / k, 0, k) for k in range(1, 9)], "id int, work string, fused double, first_list int, first_rank int")
    assert [r["id"] for r in capped(f, "work", "id", 3, 4).collect()] == [1, 2, 3, 6]


def test_knn_zero_vector(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 2.0])], "id int, embedding array<double>")
    q = spark.createDataFrame([([3.0, 0.0],)], "q array<double>")
    assert [r["id"] for r in knn(v, q, "id", 2).orderBy("rnk").collect()] == [1, 3]


@settings(max_examples=30, deadline=None)
@given(st.text())
def test_compiler_never_fails(text):
    assert all(p.words for p in compile_query(text))
