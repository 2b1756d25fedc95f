import gzip
import json

import pytest

from textloom.sources.readers import clean_html, clean_wikitext, corpus_records, delimited, filled_templates, json_documents, licences, numbered_sections, pages, paragraphs, tei_milestones, tei_units
from textloom.streaming.usage import append_log, calls_by_minute


def test_dump(spark, tmp_path):
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps({"slug": s, "text": "t"}) for s in "ab") + "\n\n")
    wanted = spark.createDataFrame([("a",)], "slug string")
    assert [r["slug"] for r in corpus_records(spark, str(tmp_path), wanted).collect()] == ["a"]
    with pytest.raises(ValueError, match="zz"):
        corpus_records(spark, str(tmp_path), spark.createDataFrame([("zz",)], "slug string"))


def test_tei(spark):
    xml = '<TEI><text><body><div type="edition"><head>X</head><div type="textpart" n="5"><div type="textpart" n="3"><p>one <pb n="1"/>two<note>no</note> &amp;</p></div><div type="textpart" n="4"><p>three</p></div></div></div></body></text></TEI>'
    df = spark.createDataFrame([(1, xml), (2, None)], "id int, xml string")
    assert [(r["unit"], r["body"]) for r in tei_units(df, "id", "xml").orderBy("pos").collect()] == [("5.3", "one two &"), ("5.4", "three")]
    assert [(r["unit"], r["body"]) for r in tei_units(df, "id", "xml", 1).collect()] == [("5", "one two &\nthree")]


def test_markup(spark, tmp_path):
    assert clean_wikitext("a{{x|{{y}}}}b <ref>n</ref>[[p|q]] -{zh:c;zh-hant:d}-\n\n'''e'''") == "ab q d\ne"
    assert clean_html("a<br>b <i>c</i>&amp;&#65;") == "a b c&A"
    w = spark.createDataFrame([("p", "intro\n==One==\nx\n==Two==\ny")], "page string, t string")
    assert [(r["section"], r["body"]) for r in numbered_sections(w, "page", "t").orderBy("pos").collect()] == [("One", "x"), ("Two", "y")]
    s = spark.createDataFrame([("g", 0, "<h1>{}</h1>", "T"), ("g", 1, "<p>{}", "a "), ("g", 2, "{}</p>", "b"), ("g", 3, "<p>{}</p>", "c")], "g string, o int, html string, text string")
    assert [(r["text"], r["heading"]) for r in paragraphs(s, "g", "o").orderBy("par").collect()] == [("T", True), ("a b", False), ("c", False)]
    (tmp_path / "t.txt").write_text("# c\n1 a x\n2 b\n")
    assert [tuple(r) for r in delimited(spark, str(tmp_path / "t.txt"), ["n", "c", "z"]).orderBy("n").collect()] == [("1", "a", "x"), ("2", "b", None)]
    (tmp_path / "j.json").write_text('{"v": [\n1, 2]}')
    assert json_documents(spark, str(tmp_path / "j.json"), "v array<int>").first()["v"] == [1, 2]


def test_pages(spark):
    t = spark.createDataFrame([("v", 1, "a<noinclude>x</noinclude>"), ("v", 2, "b")], "volume string, page int, text string")
    v = spark.createDataFrame([("v", 1, 2)], "volume string, first int, last int")
    assert [tuple(r) for r in pages(t, v).collect()] == [("v", "ab")]
    with pytest.raises(Exception, match="missing pages"):
        pages(t, spark.createDataFrame([("v", 1, 3)], "volume string, first int, last int")).collect()


def test_stream(spark, tmp_path):
    rows = spark.sql("select id, 'c' as client, timestamp'2026-01-01 10:00:00' + make_interval(0,0,0,0,0,0,id * 10) as at from range(9) as t(id)")
    rows.unionByName(rows.limit(3)).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_log(log, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    q = calls_by_minute(log, limit=4, late="0 seconds").writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n"], r["n_rejected"]) for r in spark.table("minutes").collect()] == [(6, 2)]


def test_milestones(spark):
    xml = '<text><body><p><milestone unit="section" n="3d"/>One <del>two</del></p><p>three <milestone unit="page" n="4"/><milestone unit="section" n="4a"/>four<note>x</note></p></body></text>'
    df = spark.createDataFrame([(1, xml), (2, None)], "id int, xml string")
    assert [(r["unit"], r["body"]) for r in tei_milestones(df, "id", "xml").orderBy("pos").collect()] == [("3d", "One [two]\nthree"), ("4a", "four")]


def test_licences_and_templates(spark):
    x = spark.createDataFrame([("a", '<licence target="u">'), ("a", '<licence target="u">'), ("b", "none")], "w string, x string")
    assert sorted(map(tuple, licences(x, "w", "x").collect()), key=str) == [("a", "u"), ("b", None)]
    with pytest.raises(Exception, match="disagree"):
        licences(x.unionByName(spark.createDataFrame([("a", '<licence target="v">')], x.schema)), "w", "x").collect()
    t = spark.createDataFrame([(1, "a{{x}}b{{y}}")], "k int, t string")
    assert filled_templates(t, "k", "t", spark.createDataFrame([("x", "山")], "code string, glyph string")).first()["t"] == "a山b{{y}}"
