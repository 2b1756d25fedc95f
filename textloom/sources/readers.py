"""Readers of the corpus' source families; markup is taken apart inside tasks, a document a row."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD = "slug string, title string, author string, translator string, tradition string, kind string, text string"


def corpus_records(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Records of a (gzipped) JSON-lines dump; with `wanted` (slug) only those, and an error naming every slug that is missing."""
    records = spark.read.schema(RECORD).json(path).filter("slug is not null")
    if wanted is None:
        return records
    missing = [r[0] for r in wanted.join(records, "slug", "left_anti").select("slug").distinct().orderBy("slug").limit(1000).collect()]
    if missing:
        raise ValueError("not in the dump: " + ", ".join(missing))
    return records.join(wanted.select("slug").distinct(), "slug", "left_semi")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def delimited(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Space-separated tables; # begins a comment; rows with fewer fields have nulls."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).filter("v <> ''")
    parts = F.split("v", r"\s+")
    return lines.select(*[F.get(parts, k).alias(n) for k, n in enumerate(names)])


def pages(table: DataFrame, volumes: DataFrame) -> DataFrame:
    """volumes (volume, first, last) -> (volume, text): numbered pages in order, regions that are not included left out."""
    wanted = volumes.select("volume", F.explode(F.sequence("first", "last")).alias("page"))
    text = F.regexp_replace("text", r"(?s)<noinclude>.*?</noinclude>", "")
    joined = wanted.join(table, ["volume", "page"], "left").groupBy("volume")
    missing = F.sort_array(F.collect_list(F.when(F.col("text").isNull(), F.col("page"))))
    got = joined.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", text.alias("t")))), lambda p: p["t"]), "").alias("text"), missing.alias("missing"))
    return got.withColumn("text", F.when(F.size("missing") > 0, F.raise_error(F.concat(F.lit("missing pages of "), "volume"))).otherwise(F.col("text"))).select("volume", "text")


class _Tei(HTMLParser):
    """Leaf texts of the numbered text parts of a body, without notes, heads, labels and bibliography."""

    SKIP = {"note", "head", "bibl", "label"}
    EMPTY = {"pb", "lb", "milestone", "cb", "gap"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.body, self.skipping = False, 0
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.body = True
        if not self.body or tag in self.EMPTY:
            return
        a = dict(attrs)
        part = a.get("n") if tag == "div" and a.get("type") == "textpart" or tag == "l" and a.get("n") else None
        self.stack.append((tag, part))
        self.skipping += tag in self.SKIP

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag == "body":
            self.body = False
        while self.body and self.stack:
            top, _ = self.stack.pop()
            self.skipping -= top in self.SKIP
            if top == tag:
                break

    def handle_data(self, data):
        path = ".".join(p for _, p in self.stack if p)
        if self.body and path and not self.skipping:
            self.found.setdefault(path, []).append(data)


def tei_units(documents: DataFrame, key: str, xml: str, depth: int | None = None) -> DataFrame:
    """(key, unit, pos, body): text by citation path in document order; with depth grouped by the leading levels."""
    kind = documents.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[xml]):
                if x is None:
                    continue
                p = _Tei()
                p.feed(x)
                grouped: dict[str, list[str]] = {}
                for path, parts in p.found.items():
                    if body := " ".join("".join(parts).split()):
                        grouped.setdefault(".".join(path.split(".")[:depth]), []).append(body)
                rows += [(k, u, n, "\n".join(bs)) for n, (u, bs) in enumerate(grouped.items())]
            yield pd.DataFrame(rows, columns=[key, "unit", "pos", "body"])

    return documents.select(key, xml).mapInPandas(parse, f"`{key}` {kind}, unit string, pos int, body string")


class _Milestones(HTMLParser):
    """Text from one section milestone to the next, a line a paragraph or speech, editorial brackets kept."""

    SKIP = {"note", "head", "bibl"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body, self.skipping, self.section = False, 0, None
        self.found: dict[str, list[list[str]]] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.body |= tag == "body"
        if not self.body:
            return
        if tag == "milestone" and a.get("unit") == "section":
            self.section = a.get("n")
            self.found.setdefault(self.section, [[]])
        elif tag in ("p", "said") and self.section:
            self.found[self.section].append([])
        self.skipping += tag in self.SKIP
        if tag in ("del", "add"):
            self.handle_data("[")

    def handle_startendtag(self, tag, attrs):
        if tag == "milestone":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.skipping -= tag in self.SKIP and self.skipping > 0
        if tag in ("del", "add"):
            self.handle_data("]")
        if tag == "body":
            self.body = False

    def handle_data(self, data):
        if self.body and self.section and not self.skipping:
            self.found[self.section][-1].append(data)


def tei_milestones(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, unit, pos, body) by section milestones in document order; a section that is stated again goes on."""
    kind = documents.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[xml]):
                if x is not None:
                    p = _Milestones()
                    p.feed(x)
                    bodies = {u: "\n".join(t for t in (" ".join("".join(parts).split()) for parts in lines) if t) for u, lines in p.found.items()}
                    rows += [(k, u, n, b) for n, (u, b) in enumerate(bodies.items()) if b]
            yield pd.DataFrame(rows, columns=[key, "unit", "pos", "body"])

    return documents.select(key, xml).mapInPandas(parse, f"`{key}` {kind}, unit string, pos int, body string")


def licences(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, licence) from the headers of a work's editions; editions of one work that disagree are an error, none gives null."""
    found = F.nullif(F.regexp_extract(xml, r'<licen[cs]e\b[^>]*\btarget="([^"]+)"', 1), F.lit(""))
    by = documents.groupBy(key).agg(F.collect_set(found).alias("ls"))
    return by.select(key, F.when(F.size("ls") > 1, F.raise_error(F.concat(F.lit("editions disagree: "), F.array_join("ls", ", ")))).otherwise(F.get("ls", F.lit(0))).alias("licence"))


def filled_templates(texts: DataFrame, key: str, text: str, glyphs: DataFrame) -> DataFrame:
    """texts with each {{code}} put in from glyphs (code, glyph); unknown codes stay."""
    parts = F.split(F.col(text), r"(?=\{\{)|(?<=\}\})")
    pieces = texts.select(key, F.posexplode(parts).alias("pos", "p")).withColumn("code", F.regexp_extract("p", r"^\{\{([^{}]+)\}\}$", 1))
    filled = pieces.join(glyphs, "code", "left").withColumn("p", F.coalesce("glyph", "p"))
    return filled.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]), "").alias(text))


_INNER = re.compile(r"\{\{[^{}]*\}\}")


def _variant(m: re.Match[str]) -> str:
    """-{...}-: the traditional form if given, else the plain Chinese, else the first."""
    forms = dict(p.split(":", 1) for p in m.group(1).split(";") if ":" in p)
    return next((forms[k] for k in ("zh-hant", "zh") if k in forms), next(iter(forms.values()), m.group(1)))


def _template(m: re.Match[str]) -> str:
    parts = m.group()[2:-2].split("|")
    return parts[1] if len(parts) > 1 and parts[0].startswith("另") else ""


def clean_wikitext(text: str) -> str:
    """Plain text: no notes, templates (a variant reading keeps its first form), link targets, tags or bold marks."""
    text = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", "", text, flags=re.S)
    text = re.sub(r"-\{(.*?)\}-", _variant, text)
    text = re.sub(r"\[\[(?:Category|分類|[a-z]{2,3}):[^\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", text)
    while _INNER.search(text):
        text = _INNER.sub(_template, text)
    text = re.sub(r"<[^>]+>|'{2,}", "", text)
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


def clean_html(text: str) -> str:
    """Text of a verse: breaks become spaces, tags go, entities are read, white space is squashed."""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", text))).split())


def cleaned(documents: DataFrame, text: str, how: str) -> DataFrame:
    """documents with `text` cleaned as 'wikitext' or 'html'; null stays null."""
    clean = {"wikitext": clean_wikitext, "html": clean_html}[how]
    return documents.withColumn(text, F.pandas_udf(lambda s: s.map(clean, na_action="ignore"), "string")(F.col(text)))


def numbered_sections(pages_: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, pos, body) of wikitext by its level-two headings; text before the first belongs to none."""
    part = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n==(?=[^=])")
    return pages_.select(key, F.posexplode(part).alias("pos", "p")).filter("pos > 0").select(
        key, F.trim(F.regexp_extract("p", r"^([^=\n]+)==", 1)).alias("section"), "pos", F.trim(F.regexp_replace("p", r"^[^\n]*\n?", "")).alias("body")
    )


def paragraphs(segments: DataFrame, group: str, order: str) -> DataFrame:
    """segments (group, order, html, text) -> (group, par, text, heading): a paragraph begins where the markup opens p, li or h1 to h9."""
    opens = F.col("html").rlike(r"<(?:p|li|h[1-9])\b")
    w = Window.partitionBy(group).orderBy(order)
    par = segments.withColumn("par", F.sum(opens.cast("int")).over(w))
    return par.groupBy(group, "par").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.max(F.col("html").rlike(r"<h[1-9]\b")).alias("heading")
    )
