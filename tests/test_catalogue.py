import pytest
from pyspark.sql import functions as F

from textloom.operators.catalogue import char_slots, concept, domain_list, domain_text, labelled_parts, main_text, replace_concepts, sub_split
from textloom.operators.sinks import current


def test_main_text(spark):
    b = spark.createDataFrame([("w", n, x) for n, x in enumerate(["title", " CHAPTER I", "text", None, "NOTES", "note"])] + [("v", 0, "x")], "work_id string, n int, raw string")
    bounds = spark.createDataFrame([("w", "^CHAPTER", "^NOTES")], "work_id string, start string, end string")
    got = {(r["work_id"], r["n"]): r["inside"] for r in main_text(b, bounds).collect()}
    assert got == {("w", 0): False, ("w", 1): True, ("w", 2): True, ("w", 3): True, ("w", 4): False, ("w", 5): False, ("v", 0): True}
    open_ = bounds.withColumn("end", F.lit(None).cast("string"))
    assert main_text(b, open_).filter("inside and work_id = 'w'").count() == 5
    with pytest.raises(Exception, match="main text not found: w"):
        main_text(b, bounds.withColumn("start", F.lit("^PART"))).collect()
    assert main_text(b.limit(0), bounds).count() == 0


def test_parts(spark):
    df = spark.createDataFrame([("a", "1. x\n2. y"), ("b", "z"), ("c", None)], "id string, raw string")
    assert sorted((r["id"], r["piece_no"], r["piece"]) for r in sub_split(df, "raw", r"\n(?=[0-9]+\. )").collect()) == [("a", 0, "1. x"), ("a", 1, "2. y"), ("b", 0, "z")]
    p = spark.createDataFrame([("w", 0, "x"), ("w", 1, "y"), ("v", 0, "z")], "k string, part int, t string")
    assert sorted(map(tuple, labelled_parts(p, ["k"], "part", F.col("part").cast("string"), F.col("t")).collect())) == [("v", "z"), ("w", "0 x\n1 y")]
    o = spark.createDataFrame([(1, "學a而 時"), (2, ""), (3, None)], "id int, body string")
    assert [tuple(r) for r in char_slots(o).orderBy("id", "pos").collect()] == [(1, 0, "學"), (1, 1, "而"), (1, 2, "時")]


def test_concept_graph(spark, tmp_path):
    concepts = spark.createDataFrame([("a", "A", "x, y"), ("b", "B", "")], "id string, name string, domains string")
    passages = spark.createDataFrame([("a", 0, "w:1")], "concept string, position int, ref string")
    edges = spark.createDataFrame([("a", "b", "broader", "late", 1), ("a", "b", "broader", "first", 0), ("b", "a", "tension", "t", 2)], "source string, target string, type string, note string, ord int")
    for _ in range(2):  # a second time replaces all of it
        assert tuple(replace_concepts(spark, str(tmp_path), concepts, passages, edges).first()) == (2, 1, 2)
    links = spark.read.parquet(current(spark, str(tmp_path)) + "/concept_links")
    assert {(r["source"], r["type"], r["note"]) for r in links.collect()} == {("a", "broader", "first"), ("b", "tension", "t")}
    got = {r["id"]: r["name"] for r in concept(concepts, spark.createDataFrame([("a",), ("zz",)], "id string")).collect()}
    assert got == {"a": "A", "zz": None}
    lists = {r["id"]: (r["l"], r["t"]) for r in concepts.select("id", domain_list(F.col("domains")).alias("l"), domain_text(domain_list(F.col("domains"))).alias("t")).collect()}
    assert lists == {"a": (["x", "y"], "x, y"), "b": ([], "")}
