"""One consistent form for texts that look the same.

Only the segments that a quick check finds unstable (plus the character in front of a combining
mark, which may compose with it) are normalised; the rest of a text is copied as it stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written
from textloom.sources.tables import delivered_once, table

#: Rows of one text that a task pairs at most.
PART = 200_000

# Letters that look like a Latin one.
LOOKS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ϲ": "c", "Ϲ": "C", "Ӏ": "I", "к": "κ", "օ": "o", "Օ": "O", "ո": "n", "հ": "h", "ց": "g", "ս": "u",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "‐": "-", "ı": "i", "ɑ": "a", "ɡ": "g", "∶": ":", "׀": "|", "ǀ": "|", "∣": "|",
}
# What is not seen at all.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿ㅤﾠ︀-️\U000e0000-\U000e007f\U000e0100-\U000e01ef"
JOINERS = "‌‍"
# Compatibility forms that a reader does tell apart (raised, lowered, fractions, encircled, squared) stay.
SEEN = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")
# CJK radicals that have no compatibility mapping but look like the character.
RADICALS = {"⺟": "母", "⻄": "西", "⻅": "見", "⻑": "長", "⻓": "长", "⻘": "青", "⻝": "食", "⻤": "鬼", "⻩": "黄", "⻫": "斉", "⻱": "亀", "⻣": "骨", "⻢": "马", "⻨": "麦", "⻲": "亀"}


def _one(c: str) -> str:
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in SEEN or c in LOOKS_LATIN:
        return LOOKS_LATIN.get(c, c)
    return "".join(LOOKS_LATIN.get(x, RADICALS.get(x, x)) for x in unicodedata.normalize("NFKD", c))


_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_LOOSE_JOINER = re.compile(f"(?<![ऀ-෿])[{JOINERS}]|[{JOINERS}](?![ऀ-෿])")


@lru_cache(1 << 16)
def _segment(s: str) -> str:
    s = _HIDDEN.sub("", "".join(map(_one, _HIDDEN.sub("", s))))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s))


def _unstable() -> str:
    """The quick check as a character class: every character that alone is not its own canonical form, or that may combine with its neighbour."""
    spans: list[list[int]] = []
    for k in range(0x80, 0x30000):
        if 0xD800 <= k < 0xE000 or 0x3400 <= k < 0xA000 or 0xAC00 <= k < 0xD7A4 or 0x20000 <= k < 0x2F800:
            continue  # surrogates and letters that are stable by rule
        c = chr(k)
        if unicodedata.combining(c) or (unicodedata.category(c) != "Cn" and unicodedata.normalize("NFC", _one(c)) != c) or unicodedata.normalize("NFC", "a" + c) != "a" + c:
            if spans and spans[-1][1] == k - 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in spans)


@lru_cache(1)
def _pattern() -> re.Pattern[str]:
    # marks that combine with what is in front of them, by themselves or in their consistent form
    marks = "".join(chr(k) for k in (*range(0x300, 0x3100), *range(0xF900, 0x10000)) if unicodedata.combining(_one(chr(k))[:1] or " "))
    changing = f"[{_unstable()}{INVISIBLE}ᅠ-ᇿ]"
    # the character in front is context: it may compose with what follows, also across what is not seen
    return re.compile(rf"[^\s{marks}](?=[{INVISIBLE}]*[{marks}])(?:{changing})+|(?:{changing})+")


_SPACES = re.compile(r"\s+")
# Devanagari vowels and signs that look like two signs in a row.
MATRAS = {"ाे": "ो", "ाै": "ौ", "अाे": "ओ", "अाै": "औ", "अा": "आ", "एे": "ऐ"}
_MATRAS = re.compile("|".join(sorted(MATRAS, key=len, reverse=True)))
# A folded word that still has a letter of its own script gets that script's look-alikes back, so that texts stay readable.
_WORDS = [
    (re.compile(f"[{own}{also}A-Za-z\u00c0-\u024f\u0300-\u036f]*[{own}][{own}{also}A-Za-z\u00c0-\u024f\u0300-\u036f]*"), str.maketrans({v: k for k, v in LOOKS_LATIN.items() if a <= k <= b}))
    for own, also, a, b in (("\u0400-\u04ff", "κ", "\u0400", "\u04ff"), ("\u0370-\u03ff\u1f00-\u1fff", "", "\u0370", "\u03ff"))
]
_MIXED = re.compile("[\u0370-\u04ff\u1f00-\u1fff]")


@lru_cache(1 << 16)
def _back(word: str, script: int) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(_WORDS[script][1]))


# Marks that look alike beside letters of a script: visarga, danda, sof pasuq, geresh and gershayim.
_DEVANAGARI, _HEBREW = re.compile("[ऀ-ॿ]"), re.compile("[֐-׿]")
_VISARGA, _DANDAS = re.compile("(?<=[ऀ-ॣॱ-ॿ]):+"), re.compile(r"[|।]{2}|\|")
_PASUQ, _GERESH, _GERSHAYIM = re.compile("(?<=[֐-׿]):+"), re.compile("(?<=[א-ײְ-ֽ])'+"), re.compile('(?<=[א-תְ-ׂ])"(?=[א-ת])')


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; null stays null.  canonical(canonical(x)) == canonical(x)."""
    if text is None:
        return None
    if not text.isascii():
        if "\u200c" in text or "\u200d" in text:  # between letters of Indic scripts joiners are seen
            text = _LOOSE_JOINER.sub("", text)
        text = _pattern().sub(lambda m: _segment(m.group()), text)
        if _MIXED.search(text):
            for k, (word, _) in enumerate(_WORDS):
                text = word.sub(lambda m, k=k: _back(m.group(), k), text)
        if _DEVANAGARI.search(text):
            text = _MATRAS.sub(lambda m: MATRAS[m.group()], text)
            text = _DANDAS.sub(lambda m: "॥" if len(m.group()) == 2 else "।", _VISARGA.sub(lambda m: "ः" * len(m.group()), text))
        if _HEBREW.search(text):
            text = _GERESH.sub(lambda m: "׳" * len(m.group()), text)
            text = _GERSHAYIM.sub("״", _PASUQ.sub(lambda m: "׃" * len(m.group()), text))
    return _SPACES.sub(" ", text).strip()


def canonical_col(text: Column) -> Column:
    """Column form; texts of plain ASCII with single spaces never leave the JVM."""

    def many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(canonical, na_action="ignore")

    stable = text.rlike(r"^(?:[!-~]+(?: [!-~]+)*)?$")
    return F.when(text.isNull() | stable, text).otherwise(F.pandas_udf(many, "string")(F.when(~stable, text)))


def hashed_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, form, body): each row's text as two hashes of 128 bits, of its consistent form and of itself; every text is looked at once."""
    known = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull())
    return known.select(F.col(key).alias("id"), F.md5(canonical_col(F.col(text))).alias("form"), F.md5(F.col(text)).alias("body"), *[F.col(c) for c in df.columns if c not in (key, text, "id", "form", "body")])


def same_looking_pairs(hashed: DataFrame) -> DataFrame:
    """(id_a, id_b) of rows whose texts differ but look the same; smaller id first.

    hashed: (id, form, body) of `hashed_forms`, an id once.  Texts are paired within their form, each
    different text once, and only then do their rows join in: copies of one string never meet.  A
    text of very many rows is split into so many parts that no task gets over PART of its rows.
    """
    hashed = hashed.select("id", "form", "body")
    texts = hashed.groupBy("form", "body").agg(F.count("*").alias("n"))
    several = texts.groupBy("form").agg(F.count("*").alias("k")).filter("k > 1").select("form")
    variants = written(texts.join(several, "form", "left_semi"), "same-looking-texts")
    parts = -(-(variants.agg(F.max("n")).first()[0] or 0) // PART) or 1
    one = variants.select("form", F.col("body").alias("body_a"))
    two = variants.select("form", F.col("body").alias("body_b"))
    pairs = one.join(two, "form").filter("body_a < body_b").drop("form")

    def with_rows(df: DataFrame, body: str, name: str) -> DataFrame:
        rows = hashed.select(F.col("body").alias(body), F.col("id").alias(name), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
        spread = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        return spread.join(rows, [body, "part"]).drop(body, "part")

    met = with_rows(with_rows(pairs, "body_a", "x"), "body_b", "y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    out = None
    for name in ("passages", "originals"):
        rows = hashed_forms(table(spark, sf_dir, name).select("id", "body", "created_at"), "id", "body")
        # of repeated deliveries one counts: hashes travel, not texts
        once = written(rows.groupBy("id").agg(F.min_by(F.struct("form", "body"), F.coalesce(F.col("created_at").cast("string"), F.lit("~"))).alias("r")).select("id", "r.*"), "forms")
        part = same_looking_pairs(once).select(F.lit(f"{name}.body").alias("field"), *[F.col(c).cast("string").alias(c) for c in ("id_a", "id_b")])
        out = part if out is None else out.unionByName(part)
    return out


def p3_canonical_bodies(spark, sf_dir: str) -> DataFrame:
    """The consistent form of every body of both tables."""
    out = None
    for name in ("passages", "originals"):
        rows = delivered_once(table(spark, sf_dir, name).select("id", "body", "created_at"), "id", "created_at")
        part = rows.select(F.lit(f"{name}.body").alias("field"), F.col("id").cast("string").alias("id"), canonical_col(F.col("body")).alias("form"))
        out = part if out is None else out.unionByName(part)
    return out
