import pytest
from pyspark.sql import functions as F

from textloom.functions.romanise import greek, han_number, hebrew, sanskrit
from textloom.functions.text import LANGUAGES, canonical_quote, labelled, roman, squash, trigrams, word_count
from textloom.operators.library import band_join, blocks, bounded_batches, cache_misses, concept_filter, is_verse, key_snippet, neighbours, normalised, running_chapters, unit_expand
from textloom.operators.reading import cut_words, gram_candidates, quote_in_originals, quote_matches
from textloom.operators.search import validated
from textloom.operators.sequences import anchored, carried_readings, complete, pinyin
from textloom.operators.sinks import cached_values, current, merged_drafts, replace_works
from textloom.operators.usage import log_once, over_limit, retained


def one(spark, col, *values):
    return spark.createDataFrame([(v,) for v in values], "x string").select(col(F.col("x")).alias("y")).toPandas()["y"].tolist()


def test_scalar_functions(spark):
    assert one(spark, squash, " a　 b \n", "") == ["a b", ""]
    assert one(spark, word_count, "two words", "兩字 a-b", "") == [2, 3, 0]
    assert [len(x) for x in one(spark, trigrams, "ab", "abc", "aaaa")] == [0, 1, 1]
    assert one(spark, canonical_quote, "(1.2) Ab, c!", "「子曰」") == ["abc", "子曰"]
    assert [int(x) if x == x else None for x in one(spark, roman, "XIV", "xc", "hello")] == [14, 90, None]


def test_verse_and_prose(spark):
    assert one(spark, is_verse, "  a;\n   b;", "  a", "a\n  b") == [True, False, False]
    assert one(spark, normalised, "  a;\n   b;", "half-\n  done _it_[3]", "snake_case stays") == ["a;\nb;", "half-done it", "snake_case stays"]


def test_blocks(spark):
    df = spark.createDataFrame([("k", "a\n \n\n  b\n\n"), ("n", None), ("e", "")], "k string, t string")
    assert [tuple(r) for r in blocks(df, "k", "t").orderBy("n").collect()] == [("k", 0, "a"), ("k", 1, "  b")]


def test_cut_words(spark):
    df = spark.createDataFrame([("One two. Three four five",), ("short",), ("無標點文",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(cut_words(F.col("t"), F.lit(3), True)).collect()]
    assert got == [("One two.", True), ("short", False), ("無標點", True), (None, False)]


def test_quotes(spark):
    bodies = spark.createDataFrame([(1, "The old ship came home, late."), (2, "The old sheep came home late"), (3, None)], "id int, body string")
    quotes = spark.createDataFrame([(7, "old ship came home late"), (8, "old ships came home"), (9, "?")], "item_id int, quote string")
    found = gram_candidates(quotes, bodies.filter("body is not null"))
    got = {(r["item_id"], r["id"]): r["exact"] for r in quote_matches(quotes, found, bodies).collect()}
    assert got == {(7, 1): True, (8, 1): False, (8, 2): False}


def test_quotes_of_originals(spark):
    originals = spark.createDataFrame([(1, "w", "1", "学而时习之，不亦说乎"), (2, "w", "2", "λόγος καὶ ἔργον"), (3, "v", "1", "学而时习之"), (4, "w", None, "学而时习之")], "id long, work_id string, ref_unit string, body string")
    passages = spark.createDataFrame([("w:1b", "w", "1", 2), ("w:1", "w", "1", 1), ("w:2", "w", "2", 3)], "id string, work_id string, ref_unit string, position int")
    quotes = spark.createDataFrame([(1, "學而「时习之」"), (2, "ΛΌΓΟΣ καὶ"), (3, "时习之"), (4, "xy")], "item_id long, quote string")
    got = {(r["item_id"], r["original_id"], r["id"], r["exact"]) for r in quote_in_originals(quotes, originals, passages).collect()}
    assert got == {(1, 1, "w:1", False), (2, 2, "w:2", False), (3, 1, "w:1", True)} or got == {(1, 1, "w:1", False), (2, 2, "w:2", True), (3, 1, "w:1", True)}
    assert quote_in_originals(quotes, originals, passages, work="v").count() == 0


def test_bands(spark):
    rows = spark.createDataFrame([(0,), (5,), (9,), (10,), (47,), (None,)], "v int")
    starts = spark.createDataFrame([(5,), (10,), (40,), (40,), (None,)], "s int")
    assert {(r["v"], r["s"]) for r in band_join(rows, "v", starts, "s", 4).collect()} == {(0, None), (5, 5), (9, 5), (10, 10), (47, 40), (None, None)}


def test_units(spark):
    df = spark.createDataFrame([("w", "58-59"), ("w", "2a-c"), ("w", "7")], "w string, u string")
    assert sorted((r["u"], r["source_unit"]) for r in unit_expand(df, "u").collect()) == [("2a-c", "2a-c"), ("58-59", "58"), ("58-59", "59"), ("7", "7")]
    with pytest.raises(Exception, match="reversed range"):
        unit_expand(spark.createDataFrame([("9-3",)], "u string"), "u").collect()


def test_running_chapters_over_block_seams(spark):
    rows = [("w", n, 0, "CHAPTER II.\nOf x" if n == 1 else "CHAPTER III.\nOf y" if n == 7 else "text", n in (1, 7)) for n in range(12)]
    df = spark.createDataFrame(rows, "work_id string, n int, part int, raw string, apparatus boolean")
    got = [r["chapter"] for r in running_chapters(df, size=3).orderBy("n").collect()]
    assert got == [None] + [2] * 6 + [3] * 5


def test_concepts(spark):
    c = spark.createDataFrame([("a", "Alpha 50%", None, "g", "t", "s", ""), ("b", "Beta", "x", "g", "t", "s", "")], "id string, name string, original string, gloss string, tradition string, school string, domains string")
    assert [r["id"] for r in concept_filter(c, " ALPHA ").collect()] == ["a"] and concept_filter(c, "%").count() == 1 and concept_filter(c, " ").count() == 2
    e = spark.createDataFrame([("a", "b", "broader"), ("a", "zz", "tension")], "source string, target string, type string")
    assert sorted(map(tuple, neighbours(e, c).select("id", "other", "type").collect())) == [("a", "b", "broader"), ("b", "a", "narrower"), ("zz", "a", "tension")]
    text = " ".join(f"w{k}" for k in range(60))
    assert one(spark, lambda x: key_snippet(x, F.lit("w20 w21")), text)[0].startswith("… w12 w13")
    assert one(spark, lambda x: key_snippet(x, F.lit("absent")), text)[0] == " ".join(f"w{k}" for k in range(40)) + " …"


def test_index_bookkeeping(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, body string")
    none = spark.createDataFrame([], "model string, hash string, value string")
    miss = cache_misses(rows, "body", none, "m")
    assert miss.count() == 2
    cache = cached_values(none, miss.select(F.lit("m").alias("model"), "hash", F.upper("body").alias("value")))
    assert cache_misses(rows, "body", cache, "m").count() == 0
    got = bounded_batches(rows.filter("body is not null").coalesce(1), ["id"], "body", lambda ts: [len(ts)] * len(ts), "int", most=2, chars=100)
    assert sorted(r["result"] for r in got.collect()) == [1, 2, 2]


def test_usage(spark):
    log = spark.sql("select * from values (1, timestamp'2026-01-01', timestamp'2026-01-02', 'q', null), (1, timestamp'2026-01-01', timestamp'2026-01-01', 'q', null), (2, timestamp'2026-01-03', timestamp'2026-01-03', 'r', null) as t(id, at, received_at, query, query_hash)")
    once = log_once(log)
    assert once.count() == 2
    now = F.lit("2026-02-01").cast("timestamp")
    kept = retained(once.withColumn("query_hash", F.col("query_hash").cast("string")), now)
    assert [(r["query"], bool(r["query_hash"])) for r in kept.orderBy("id").collect()] == [(None, True), ("r", False)]
    assert retained(kept, now).exceptAll(kept).count() == 0
    calls = spark.sql("select id, 'c' as client, timestamp'2026-01-01 10:00:00' + make_interval(0,0,0,0,0,0,id) as at from range(4) as t(id)")
    assert [r["rejected"] for r in over_limit(calls, "client", "at", 3, "minute").orderBy("id").collect()] == [False, False, False, True]


def test_anchors(spark):
    rows = [("w", n, x) for n, x in enumerate(["preface", "Once upon a time", "there was", "Once upon a time again", "The end", None, "notes"])]
    blocks_ = spark.createDataFrame(rows + [("v", 0, "none")], "work_id string, n int, body string")
    anchors = spark.createDataFrame([("w", 1, "1", "Once  upon a"), ("w", 2, "2", "Once upon"), ("w", 3, None, "notes")], "work_id string, k int, unit string, at string")
    got = {(r["work_id"], r["n"]): r["ref"] for r in anchored(blocks_, anchors).collect()}
    assert got == {("w", 0): None, ("w", 1): "1", ("w", 2): "1", ("w", 3): "2", ("w", 4): "2", ("w", 5): "2", ("w", 6): None, ("v", 0): None}
    with pytest.raises(Exception, match="anchor not found"):
        anchored(blocks_, anchors.withColumn("at", F.concat(F.col("at"), F.lit(" nowhere")))).collect()


def test_readings(spark):
    slots = spark.createDataFrame([("b", "1", 0, "好"), ("b", "1", 1, "好"), ("b", "2", 2, "好"), ("b", "2", 3, "行")], "book string, unit string, pos int, char string")
    ev = spark.createDataFrame([("b", 0, "好", "hào", "book"), ("b", 3, "行", "xìng", "unit")], "book string, pos int, char string, reading string, scope string")
    assert [r["reading"] for r in carried_readings(slots, ev).orderBy("pos").collect()] == ["hào", "hào", "hào", "xìng"]
    u = spark.createDataFrame([("1", "好行")], "unit string, body string")
    base = spark.createDataFrame([("好", "hǎo", True), ("行", "xíng", False)], "char string, pinyin string, several boolean")
    r = spark.createDataFrame([("1", 0, "好", "hào")], "unit string, pos int, char string, pinyin string")
    assert [tuple(x) for x in pinyin(u, base, r).collect()] == [("1", "hào xíng", "")]
    assert [tuple(x) for x in pinyin(u, base, r.limit(0)).collect()] == [("1", "hǎo xíng", "好")]


def test_transcriptions():
    assert greek("ῥῆμα ἄγγελος, ὁ τῷ;") == "rhêma ángelos, ho tôi?" and greek(None) is None
    assert hebrew("הַכֹּל הָבֶל") == "hakkol havel"
    assert sanskrit("धर्मः ।") == "dharmaḥ |"
    assert [han_number(x) for x in ("十二", "四七", "x")] == [12, 47, None]


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    t = spark.createDataFrame([("a", 1), ("b", 2)], "work_id string, v int")
    works = t.select("work_id")
    replace_works(spark, root, {"t": t}, works)
    replace_works(spark, root, {"t": t.filter("work_id = 'a'").withColumn("v", F.lit(9))}, works.filter("work_id = 'a'"))
    for _ in range(2):
        assert sorted(map(tuple, spark.read.parquet(current(spark, root) + "/t").collect())) == [("a", 9), ("b", 2)]
    d = spark.createDataFrame([("1", 0, "x", "new", False), ("1", 1, "y", "new", False)], "unit string, pos int, char string, pinyin string, reviewed boolean")
    p = spark.createDataFrame([("1", 0, "x", "old", True), ("1", 1, "y", "old", False)], d.schema)
    assert sorted((r["pos"], r["pinyin"]) for r in merged_drafts(d, p).collect()) == [(0, "old"), (1, "new")]


def test_units_must_be_complete(spark):
    u = spark.createDataFrame([("w", "1-2", "1", 0), ("w", "1-2", "2", 1)], "work_id string, ref_unit string, source_unit string, ord int")
    s = spark.createDataFrame([("w", "1", "a"), ("w", "2", "b")], "work_id string, unit string, body string")
    assert [r["body"] for r in complete(u, s).collect()] == ["a\nb"]
    with pytest.raises(Exception, match="missing units: w:2"):
        complete(u, s.limit(1)).collect()


def test_labels_and_limits(spark):
    assert one(spark, lambda c: labelled(c, LANGUAGES), "grc", "xx") == ["Ancient Greek", "xx"]
    assert validated("query", "ab") == "ab"
    with pytest.raises(ValueError):
        validated("quote", "ab")
