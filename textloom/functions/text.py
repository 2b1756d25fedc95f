"""Text functions as columns; everything here stays in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of the index: letters and digits of any script, without case and accents.
WORD = r"[\p{L}\p{N}]+"
#: A word as a reader counts it: each Han character, and what else stands between spaces or Han and is not only marks.
READER_WORD = r"\p{IsHan}|(?:(?![\s\p{IsHan}])[^\p{L}\p{N}])*+(?!\p{IsHan})[\p{L}\p{N}](?:(?!\p{IsHan})\S)*+"


def _table(form: str, keep) -> tuple[str, str]:
    """Characters that the normal form turns into one other character, and those; of what is left after `keep`."""
    pairs = [(chr(k), "".join(filter(keep, unicodedata.normalize(form, chr(k))))) for k in (*range(0x80, 0xAC00), *range(0xF900, 0x10000))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Letters with accents and without; characters and the ones they are compatible with (widths, presentation forms).
ACCENTS = _table("NFD", lambda c: unicodedata.category(c)[0] != "M")
COMPATIBLE = _table("NFKC", lambda c: True)


def folded(c: Column) -> Column:
    """Lower case without accents; a final sigma is like any other."""
    low = F.lower(c)
    bare = F.translate(F.regexp_replace(F.translate(low, *ACCENTS), r"\p{M}+", ""), "ς", "σ")
    return F.when(c.rlike(r"[^\x00-\x7F]"), bare).otherwise(low)


def words(c: Column) -> Column:
    """The index words of a text in order; null and empty text give an empty array."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def query_words(text: str) -> list[str]:
    """The same for a query string."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c)[0] != "M")
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", bare).replace("ς", "σ"))


def squash(c: Column) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(READER_WORD)).cast("bigint")


def opening(c: Column, size: int = 300) -> Column:
    """The first `size` characters; an ellipsis unless the whole text is shorter than that."""
    return F.when(F.length(c) < size, c).otherwise(F.concat(F.substring(c, 1, size), F.lit("…")))


def trigrams(c: Column) -> Column:
    """Distinct code-point trigrams; texts under three characters have none."""
    chars, n = F.split(c, ""), F.length(c) - 2
    two = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda x, y: F.concat(x, y))
    return F.when(n >= 1, F.array_distinct(F.zip_with(two, F.slice(chars, 3, n), lambda x, y: F.concat(x, y)))).otherwise(F.array().cast("array<string>"))


def canonical_quote(c: Column) -> Column:
    """What two wordings of a quotation are compared by: compatible characters as one, no section markers, case, marks, signs or spaces; accents stay."""
    same = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *COMPATIBLE)).otherwise(c)
    return F.regexp_replace(F.lower(F.regexp_replace(same, r"\([0-9]+(\.[0-9]+)*\)", "")), r"[\p{P}\p{S}\p{Z}\s]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def passage_id(work: Column, n: Column, part: Column) -> Column:
    """work:block, with a letter from b on for the second and later parts of a block."""
    return F.concat(work, F.lit(":"), n.cast("string"), F.when(part > 0, F.char(part + 97)).otherwise(""))


def roman(c: Column) -> Column:
    """Value of a roman numeral up to C, null for anything else."""
    up = F.upper(c)
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    digits = F.transform(F.split(up, ""), lambda x: F.coalesce(*[F.when(x == k, v) for k, v in value.items()], F.lit(0)))
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda acc, x: F.struct((acc["sum"] + x - F.when(acc["last"] < x, 2 * acc["last"]).otherwise(0)).alias("sum"), x.alias("last")), lambda acc: acc["sum"])
    return F.when(up.rlike("^[IVXLC]+$"), total)


# Names of languages and of their transcription schemes.
LANGUAGES = {"grc": "Ancient Greek", "lzh": "Classical Chinese", "pli": "Pali", "hbo": "Biblical Hebrew", "san": "Sanskrit", "en": "English"}
SCHEMES = {"grc": "romanised Greek", "lzh": "pinyin", "hbo": "romanised Hebrew", "san": "IAST"}


def labelled(code: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The name of a code; without one the default, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[code], F.lit(default) if default else code)
