"""Latin transcriptions of pointed and accented scripts, as vectorised functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the three scripts.
GREEK = {"α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "ē", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "ō"}
GREEK_MARKS = {";": "?", ";": "?", "·": ";", "·": ";", "ʼ": "’", "᾽": "’"}
ROUGH, SMOOTH, SUBSCRIPT, CIRCUMFLEX, DIAERESIS = "̔", "̓", "ͅ", "͂", "̈"
HEBREW = {"א": "", "ב": "v", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "ch", "ט": "t", "י": "y", "כ": "kh", "ך": "kh", "ל": "l", "מ": "m", "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ע": "", "פ": "f", "ף": "f", "צ": "ts", "ץ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t"}
HEBREW_HARD = {"ב": "b", "כ": "k", "ך": "k", "פ": "p", "ף": "p"}
HEBREW_VOWELS = {"ְ": "", "ֱ": "e", "ֲ": "a", "ֳ": "o", "ִ": "i", "ֵ": "e", "ֶ": "e", "ַ": "a", "ָ": "a", "ֹ": "o", "ֺ": "o", "ֻ": "u", "ׇ": "o"}
DAGESH, SIN, SHVA = "ּ", "ׂ", "ְ"
IAST_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split()))
IAST_VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a ā i ī u ū ṛ e ai o au".split()))
IAST_SIGNS = dict(zip("ािीुूृेैोौ", "ā i ī u ū ṛ e ai o au".split()))
IAST_OTHER = {"ं": "ṃ", "ः": "ḥ", "ऽ": "’", "।": "|", "॥": "||"}


def _clusters(word: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.combining(c) and out:
            out[-1] = (out[-1][0], out[-1][1] + c)
        else:
            out.append((c, ""))
    return out


def _greek_word(word: str) -> str:
    letters = _clusters(word)
    out, rough = [], False
    for k, (c, marks) in enumerate(letters):
        low = c.lower()
        latin = GREEK.get(low)
        if latin is None:
            out.append(c + marks)
            continue
        before = letters[k - 1][0].lower() if k else ""
        after = letters[k + 1][0].lower() if k + 1 < len(letters) else ""
        if low == "γ" and after and after in "γκξχ":
            latin = "n"
        if low == "υ" and before and before in "αεηοω" and DIAERESIS not in marks:
            latin = "u"
        if ROUGH in marks:
            if low == "ρ":
                latin = "rh"
            else:
                rough = True
        accents = "".join(m for m in marks if m in "̀́̈")
        if CIRCUMFLEX in marks:  # takes the place of the macron
            latin, accents = {"ē": "e", "ō": "o"}.get(latin, latin), accents + "̂"
        text = latin + accents + ("i" if SUBSCRIPT in marks else "")
        if c != low:
            shouted = len(letters) > 1 and all(x == x.upper() for x, _ in letters)
            text = text.upper() if shouted else text[0].upper() + text[1:]
        out.append(text)
    whole = "".join(out)
    if rough:
        whole = "H" + whole[0].lower() + whole[1:] if whole[:1].isupper() else "h" + whole
    return unicodedata.normalize("NFC", whole)


def greek(text: str | None) -> str | None:
    if text is None:
        return None
    text = "".join(GREEK_MARKS.get(c, c) for c in unicodedata.normalize("NFC", text))
    return re.sub(r"[Ͱ-Ͽἀ-῿][Ͱ-Ͽἀ-῿̀-ͅ]*", lambda m: _greek_word(m.group()), text)


def _hebrew_word(word: str) -> str:
    letters = [(c, "".join(m for m in marks if m in HEBREW_VOWELS or m in DAGESH + SIN + "ׁ")) for c, marks in _clusters(word)]
    out: list[str] = []
    for k, (c, marks) in enumerate(letters):
        if c not in HEBREW:
            out.append(c)
            continue
        vowel = "".join(HEBREW_VOWELS.get(m, "") for m in marks)
        vowel = vowel.replace("ia", "ai")  # canonical order puts the i of two vowels first
        voiced = any(m in HEBREW_VOWELS and m != SHVA for m in marks)
        before = letters[k - 1] if k else ("", "")
        open_before = any(m in HEBREW_VOWELS and m != SHVA for m in before[1]) or (before[0] == "ו" and bool(out) and out[-1][-1:] in "ou")
        if c == "ו" and not voiced and DAGESH in marks and k:
            out.append("u")
            continue
        if c == "ו" and "ֹ" in marks and k and not any(m in HEBREW_VOWELS for m in before[1]):
            out.append("o")
            continue
        if c == "י" and not voiced and SHVA not in marks and k and out and out[-1][-1:] in "ie":
            continue  # only lengthens the vowel
        if c == "ה" and k == len(letters) - 1 and not voiced and DAGESH not in marks:
            continue
        sound = "s" if SIN in marks else HEBREW_HARD.get(c, HEBREW[c]) if DAGESH in marks else HEBREW[c]
        if DAGESH in marks and k and open_before and c not in "הא":
            sound += sound
        if SHVA in marks and k == 0 and len(letters) > 1:
            vowel = "e"
        last = k == len(letters) - 1
        out.append(vowel + sound if last and c in "חע" and "ַ" in marks and k else sound + vowel)
    return "".join(out)


def hebrew(text: str | None) -> str | None:
    if text is None:
        return None
    text = re.sub("[֑-ֽ֯͏‍]", "", unicodedata.normalize("NFD", text)).replace("־", "-").replace("׃", ".")
    return re.sub("[א-ת][א-תְ-ׇ]*", lambda m: _hebrew_word(m.group()), text)


def sanskrit(text: str | None) -> str | None:
    if text is None:
        return None
    out, chars = [], text
    for k, c in enumerate(chars):
        after = chars[k + 1] if k + 1 < len(chars) else ""
        if c in IAST_CONSONANTS:
            out.append(IAST_CONSONANTS[c] + ("" if after in IAST_SIGNS and after or after == "्" else "a"))
        elif c in IAST_SIGNS:
            out.append(IAST_SIGNS[c])
        elif c in IAST_VOWELS:
            out.append(IAST_VOWELS[c])
        elif c in IAST_OTHER:
            out.append(IAST_OTHER[c])
        elif "०" <= c <= "९":
            out.append(str(ord(c) - ord("०")))
        elif c != "्":
            out.append(c)
    return "".join(out)


SCHEMES = {"grc": greek, "hbo": hebrew, "san": sanskrit}


def romanised(language: Column, text: Column) -> Column:
    """Transcription by language; null for languages without a scheme and for null text."""

    @F.pandas_udf("string")
    def run(lang: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([SCHEMES[a](b) if a in SCHEMES and b is not None else None for a, b in zip(lang, t)], dtype=object)

    return run(language, text)


def han_number(text: str) -> int | None:
    """Value of a written (十二) or positional (四七) numeral, null for anything else."""
    digits = {c: k for k, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
    if not text or any(c not in digits and c not in "十百千" for c in text):
        return None
    if not any(c in "十百千" for c in text):
        return int("".join(str(digits[c]) for c in text))
    total, last = 0, None
    for c in text:
        if c in digits:
            last = digits[c]
        else:
            total += (1 if last is None else last) * {"十": 10, "百": 100, "千": 1000}[c]
            last = None
    return total + (last or 0)
