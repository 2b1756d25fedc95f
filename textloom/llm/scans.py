"""Repairing text from scanned pages.

Lines are told apart from page furniture, words cut at line ends are joined, and words with wrongly
recognised characters are replaced: candidates come from an inverted join over character q-grams,
a gradient-boosted model ranks them; more such models decide between a line and its neighbours over
running titles, page numbers, joins, and whether a paragraph goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.shared import hash_sample, written
from textloom.llm.boosting import Boosted
from textloom.llm.canonical import canonical_col
from textloom.sources.tables import delivered_once, table

#: Words (and compounds) that the models are fitted on: those of least hash.
SAMPLE = 1_500
#: Texts that models are fitted on have at most so many characters.
SAMPLE_CHARS = 20_000
#: Segments of a work whose order is worked out by one task.
BLOCK = 1_000
#: A form is misread only if its original, in clean texts and scans together, is so many times as frequent.
RARER = 2
#: A form that clean texts do not have corrects others if it is at least so large a share of the scans' words.
SHARE = 2e-5
#: A word seen so often in cleanly transcribed text is trusted.
TRUSTED = 2
HYPHENS = "-¬­—‐‑–"
# What recognition makes of letters (right, wrong).
CONFUSED = [
    ("h", "li"), ("h", "b"), ("b", "h"), ("e", "c"), ("c", "e"), ("o", "0"), ("m", "rn"), ("l", "|"), ("l", "1"), ("i", "l"), ("l", "i"), ("t", "f"), ("t", "l"), ("f", "t"),
    ("u", "n"), ("n", "u"), ("s", "ſ"), ("w", "vv"), ("d", "cl"), ("n", "ii"), ("a", "o"), ("o", "c"), ("rn", "m"), ("i", "1"), ("I", "l"), ("g", "q"), ("y", "v"), ("s", "5"), ("b", "6"), ("ri", "n"), ("e", "o"), ("in", "m"), ("t", "7"), ("i", "!"),
]
# Single characters are folded first, so that pairs are found in whatever way their parts were misread.
_FOLD_ONE = str.maketrans("ſ50oel1|!jb6uyqf7", "ssccciiiiihhnvgtt")
_FOLD_MANY = [("ri", "n"), ("rn", "m"), ("in", "m"), ("ci", "d"), ("ii", "h"), ("vv", "w")]
_ROMAN = r"[IVXLCivxlc1|]+"
_NUMBER = re.compile(r"[\dOolI|S]*\d[\dOolI|S]*")
_END = re.compile(r"[.?!][\"”’'»)\]]*$")


def skeleton(word: str) -> str:
    """A word with everything recognition confuses folded together, marks inside dropped."""
    w = re.sub(r"[^\w|!]", "", word.lower()).translate(_FOLD_ONE)
    for many, one in _FOLD_MANY:
        w = w.replace(many, one)
    return w


# ---- furniture ------------------------------------------------------------------------------

LINE_FEATURES = ["title", "chapter", "capitals", "titled", "length", "indent", "open_before", "lower_after", "digits"]


def _letters(s: str) -> str:
    return re.sub(r"[^A-Z]", "", s.upper().replace("0", "O").replace("1", "I").replace("|", "I").replace("5", "S"))


def line_features(lines: list[str], k: int, title: str) -> list[float]:
    """How much a line looks like a running title, by itself and between its neighbours."""
    line = lines[k].strip()
    bare = re.sub(r"^\W*(?:p\.\s*)?[\dOolIS|]*\d[\dOolIS|]*\W+|\W+(?:p\.\s*)?[\dOolIS|]*\d[\dOolIS|]*\W*$", "", line)
    letters = [c for c in bare if c.isalpha()]
    flat = _letters(bare)
    chapter = re.match(r"(.{6,8}?)\s+(" + _ROMAN + r")\b\.?\s*(.*)$", bare) or re.match(r"(.{6,8}?)\s+(" + _ROMAN + r")\b\.?\s*()$", re.sub(r"^[\W\d]+", "", line))
    of_chapter = SequenceMatcher(None, _letters(chapter.group(1)), "CHAPTER").ratio() if chapter else 0.0
    if of_chapter < 0.7 and re.match(r"[CG]HA?P", flat):
        spaced = re.match(r"(CHAPTER)([IVXLC]+)(.*)$", flat)
        of_chapter = 1.0 if spaced else of_chapter
    rest = _letters(chapter.group(3)) if chapter and of_chapter >= 0.7 else flat
    of_title = SequenceMatcher(None, rest, title).ratio() if rest and title and len(rest) < 2 * len(title) + 4 else 0.0
    if of_chapter >= 0.7 and not rest:
        of_title = 1.0
    words = re.findall(r"[^\W\d_]+", bare)
    before = lines[k - 1].strip() if k else ""
    after = lines[k + 1].strip() if k + 1 < len(lines) else ""
    return [
        of_title, of_chapter, sum(c.isupper() for c in letters) / len(letters) if letters else 0.0,
        sum(w[0].isupper() for w in words) / len(words) if words else 0.0, float(len(line)), float(len(lines[k]) - len(lines[k].lstrip())),
        float(bool(before) and not _END.search(before)), float(after[:1].islower()), float(bool(re.search(r"\d", line))),
    ]


PAGE_FEATURES = ["figures", "roman", "other", "length", "words", "first", "last", "alone", "digit", "runs"]
#: A line of more words is no page number.
PAGE_WORDS = 4
_FIGURES, _NUMERAL = re.compile(r"[\dOolIS|Q]"), re.compile(r"[ivxlcdm]", re.I)


def page_features(lines: list[str], k: int) -> list[float]:
    """How much a line looks like a page number, by itself and between its neighbours."""
    line = lines[k].strip()
    bare = re.sub(r"^(?:p|pp|page|pag)\.?\s*(?=\W*[\dOolIS|ivxlcdm]+\W*$)", "", line, flags=re.I)
    seen = [c for c in bare if c.isalnum() or c == "|"]
    n = max(len(seen), 1)
    written = [j for j, x in enumerate(lines) if x.strip()]
    return [
        len(_FIGURES.findall("".join(seen))) / n, len(_NUMERAL.findall("".join(seen))) / n, float(len(bare) - len(seen)), float(len(seen)), float(len(bare.split())),
        float(bool(written) and k == written[0]), float(bool(written) and k == written[-1]), float(len(written) == 1), float(any(c.isdigit() for c in seen)), float(len(re.findall(r"[^\W_]+", bare.replace("|", "1")))),
    ]


def page_model(texts: list[str]) -> Boosted:
    """Fitted on page numbers as printers set them and recognition spoils them, against lines and single words of text."""
    rng = np.random.default_rng(17)
    texts = texts or ["some words of a line", "and some more of them"]
    x, y = [], []
    for _ in range(900):
        n = str(int(10 ** (rng.random() * 2.9)))
        roman = "".join(["", "x", "xx", "xl", "l", "c"][rng.integers(6)]) + "i ii iii iv v vi vii viii ix".split()[rng.integers(9)]
        number = n if rng.random() < 0.85 else roman
        number = "".join({"0": "O", "1": "lI|"[rng.integers(3)], "5": "S"}.get(c, c) if rng.random() < 0.25 else c for c in number)
        page = [number, f"[{number}]", f"- {number} -", f"— {number} —", f"p. {number}", f"({number})", f"{number}."][rng.integers(7)]
        a, b = (texts[k] for k in rng.integers(0, len(texts), 2))
        lines = [[page], [a, page], [page, b], [a, page, b], ["", page, "", b]][rng.integers(5)]
        x.append(page_features(lines, lines.index(page)))
        y.append(1)
        words = a.split()
        short = " ".join(words[: rng.integers(1, 3)]) if words else "word"
        part = f"{rng.integers(1, 99)}.{rng.integers(1, 60)}"
        other = [" ".join(words[:PAGE_WORDS]), short, f"{short} {n}", f"{n} {short} {n}", short.upper(), f"{n}. {short}", words[-1] if words else "end.", part + [").", ".", ")?", ", ", ":"][rng.integers(5)], f"({part})"][rng.integers(9)]
        lines = [[other], [a, other], [other, b], [a, other, b]][rng.integers(4)]
        x.append(page_features(lines, lines.index(other)))
        y.append(0)
    return Boosted(trees=40).fit(np.array(x), np.array(y, float))


def furniture_model(titles: list[str], texts: list[str]) -> Boosted:
    """Fitted on running titles made from the works' names as printers set them and recognition spoils them, against lines of text."""
    rng = np.random.default_rng(7)
    x, y = [], []
    for title in titles:
        flat = _letters(title)
        for _ in range(30):
            named = ["", "The ", "The ", "Of ", "A "][rng.integers(5)] + title
            roman = ["II", "III", "IV", "V", "VII", "IX", "XII"][rng.integers(7)]
            head = [named.upper(), named.title(), f"CHAPTER {roman}", f"Chapter {roman}.", f"CHAPTER {roman}. {named.upper()}", "  ".join(named.upper()), " ".join(f"CHAPTER {roman}"), " ".join(f"CHAPTER {roman}. {named.upper()}")][rng.integers(8)]
            head = "".join({"O": "0", "I": "1", "E": "F", "H": "B", "N": "II"}.get(c, c) if rng.random() < 0.04 else c for c in head)
            head = [head, head + ".", f"{head}   {rng.integers(9, 500)}", f"{rng.integers(9, 500)}   {head}", " " * int(rng.integers(3, 16)) + head][rng.integers(5)]
            a, b = (texts[k] for k in rng.integers(0, len(texts), 2)) if texts else ("a b", "c d")
            lines = [[a, head, b], [head], ["31", head], [head, "[31]"]][rng.integers(4)]
            x.append(line_features(lines, lines.index(head), flat))
            y.append(1)
            last = b.split()[-1]
            piece = [last, last.title(), last.title() + ".", last.title() + ",", " ".join(b.split()[:2])][rng.integers(5)]
            lines = [a, b, texts[rng.integers(len(texts))] if texts else "e f", piece]
            for k in range(4):
                x.append(line_features(lines, k, flat))
                y.append(0)
    return Boosted(trees=30).fit(np.array(x), np.array(y, float))


LINES = "work_id string, n int, part int, line_no int, ref string, running boolean, kind string, line string"


def classified_lines(segments: DataFrame, model: Boosted, pages: Boosted) -> DataFrame:
    """One row a line, kind: text, header, page_no, heading (a chapter's own) or blank."""

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, feats, where = [], [], []
            split = [raw.split("\n") for raw in pdf["raw"]]
            asked = [bool(x.strip()) and len(x.split()) <= PAGE_WORDS for lines in split for x in lines]
            ask = iter(asked)
            scored = iter(pages.score(np.array([page_features(lines, k) for lines in split for k in range(len(lines)) if next(ask)])) > 0.5)
            ask = iter(asked)
            for r, lines in zip(pdf.itertuples(index=False), split):
                title = _letters(r.work_id)
                page = [bool(next(ask) and next(scored)) for _ in lines]
                # a chapter's own heading has a line of words under it
                own = r.apparatus and any(not p and re.search(r"[a-z]{3}", x) and line_features(lines, k, title)[0] < 0.6 for k, (x, p) in enumerate(zip(lines, page)))
                for k, x in enumerate(lines):
                    kind = "blank" if not x.strip() else "page_no" if page[k] else "heading" if own else "text"
                    if kind == "text":
                        where.append(len(rows))
                        feats.append(line_features(lines, k, title))
                    rows.append([r.work_id, r.n, r.part, k, r.ref, not r.apparatus, kind, x])
            if feats:
                p = model.score(np.array(feats))
                for at, score in zip(where, p):
                    if score > 0.5:
                        rows[at][6] = "header"
            yield pd.DataFrame(rows, columns=["work_id", "n", "part", "line_no", "ref", "running", "kind", "line"])

    return segments.mapInPandas(classify, LINES)


# ---- words ----------------------------------------------------------------------------------


def word(token: Column) -> Column:
    """A token without the marks around it, in lower case."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}|]+|[^\p{L}\p{N}|]+$", "")


def _plain(token: str) -> str:
    return re.sub(r"^[^\w|]+|[^\w|]+$", "", token.lower())


WORD_FEATURES = ["edit", "folded_edit", "length", "count", "often", "first", "last", "strange", "share", "figures"]


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_features(w: str, c: str, count: float, own: float) -> list[float]:
    """How likely c is what was printed where w was recognised."""
    a, b = skeleton(w), skeleton(c)
    ga, gb = {a[k : k + 2] for k in range(len(a) - 1)}, {b[k : k + 2] for k in range(len(b) - 1)}
    strange = bool(re.search(r"[\d|ſ]|[^\w-]", w))
    return [_distance(w, c) / max(len(c), 1), _distance(a, b) / max(len(b), 1), float(len(w) - len(c)), np.log1p(count), np.log1p(own) - np.log1p(count), float(w[:1] == c[:1]), float(w[-1:] == c[-1:]), float(strange), len(ga & gb) / max(len(ga | gb), 1), float(c.isdigit())]


#: Letters that figures are read as.
_FIGURES_OF = str.maketrans("oli|s", "01115")


def spoiled(w: str, rng: np.random.Generator) -> str:
    """A word as recognition might give it."""
    if rng.random() < 0.1 and len(w) > 4:
        at = int(rng.integers(1, len(w) - 1))
        return w[:at] + ",.'"[rng.integers(3)] + w[at:]
    for k in rng.permutation(len(CONFUSED)):
        right, wrong = CONFUSED[k]
        if right in w:
            at = [m.start() for m in re.finditer(re.escape(right), w)]
            p = at[rng.integers(len(at))]
            return w[:p] + wrong + w[p + len(right) :]
    return w


def ranking_model(words: list[tuple[str, int]]) -> Boosted:
    """Fitted on spoiled words against their originals, their neighbours, and unspoiled words that are merely unknown."""
    rng = np.random.default_rng(11)
    names = [w for w, _ in words]
    count = dict(words)
    known = set(names)
    skel = [skeleton(w) for w in names]
    grams: dict[str, list[int]] = {}
    for k, s in enumerate(skel):
        for g in {f"^{s}$"[j : j + 2] for j in range(len(s) + 1)}:
            grams.setdefault(g, []).append(k)

    often = 20 * np.median(list(count.values())) if count else 0

    def near(w: str, out: str | None) -> list[str]:
        s = skeleton(w)
        hits: dict[int, int] = {}
        for g in {f"^{s}$"[j : j + 2] for j in range(len(s) + 1)}:
            for k in grams.get(g, ()):
                hits[k] = hits.get(k, 0) + 1
        return [names[k] for k in sorted(hits, key=lambda k: -hits[k])[:5] if names[k] not in (w, out)][:3]

    x, y = [], []
    for w in names:
        if len(w) < 3:
            continue
        for _ in range(6 if len(w) <= 4 or count[w] >= often else 1):
            bad = spoiled(w, rng)
            if bad in known or bad == w:
                continue
            own = 1.0 + rng.poisson(count[w] * rng.random() * 0.02)  # a spoiled form is rare beside its original
            x.append(word_features(bad, w, count[w], own))
            y.append(1)
            for c in near(bad, w):
                if skeleton(c) != skeleton(bad):
                    x.append(word_features(bad, c, count[c], own))
                    y.append(0)
        for c in near(w, None):  # the word itself, as if it were not in the lexicon
            if skeleton(c) != skeleton(w):
                x.append(word_features(w, c, count[c], float(count[w] if rng.random() < 0.7 else rng.integers(1, 4))))
                y.append(0)
    for _ in range(400):  # figures read as letters, against words with a figure
        n = str(int(10 ** (1 + rng.random() * 3)))
        bad = "".join({"0": "o", "1": "li|"[rng.integers(3)], "5": "s"}.get(c, c) if rng.random() < 0.6 else c for c in n)
        if bad != n and re.search(r"\d", bad):
            x.append(word_features(bad, n, 1.0, 1.0))
            y.append(1)
        if names:
            w = names[rng.integers(len(names))]
            at = int(rng.integers(0, len(w)))
            bad = w[:at] + str(rng.integers(10)) + w[at + 1 :]
            x.append(word_features(bad, bad.translate(_FIGURES_OF), 1.0, 1.0))
            y.append(0)
    return Boosted(trees=60).fit(np.array(x), np.array(y, float)) if x else Boosted()


JOIN_FEATURES = ["joined", "compound", "first", "second", "folded"]


GOES_ON_FEATURES = ["ends", "closes", "pauses", "cut", "next_lower", "next_upper", "next_figure"]


def goes_on_features(end: str, begin: str) -> list[float]:
    """A line pair: whether the text of a line goes on in the next one."""
    bare = end.strip().rstrip("\"”’'»)]")
    first = next((c for c in begin if c.isalnum()), "")
    return [float(bare[-1:] in (".", "?", "!")), float(bare != end.strip()), float(bare[-1:] in (",", ";", ":")), float(bare[-1:] in HYPHENS), float(first.islower()), float(first.isupper()), float(first.isdigit())]


def goes_on_model(bodies: list[str]) -> Boosted:
    """Fitted on paragraphs cut between any two words, against the end of one and the begin of the next."""
    rng = np.random.default_rng(19)
    x, y = [], []
    for one, two in zip(bodies, bodies[1:]):
        words = one.split()
        if len(words) < 4 or not two.split():
            continue
        for at in rng.integers(1, len(words), 3):
            x.append(goes_on_features(words[at - 1], words[at]))
            y.append(1)
        for _ in range(3):
            x.append(goes_on_features(words[-1], two.split()[0]))
            y.append(0)
    if not x:  # without any paragraph known: an end mark ends one
        x = [goes_on_features(e, b) for e in ("end.", "end?", "mid", "mid,") for b in ("Next", "next")]
        y = [float(e.startswith("mid")) for e in ("end.", "end?", "mid", "mid,") for _ in range(2)]
    return Boosted(trees=30).fit(np.array(x), np.array(y, float))


def join_model(words: list[tuple[str, int]], compounds: list[tuple[str, int]]) -> Boosted:
    """Line pairs: words cut anywhere against compounds parted at their own hyphen."""
    rng = np.random.default_rng(13)
    count, of_compound = dict(words), dict(compounds)
    x, y = [], []
    for w, n in words:
        if len(w) < 5 or not w.isalpha():
            continue
        at = int(rng.integers(2, len(w) - 1))
        bad, unseen = rng.random() < 0.15, rng.random() < 0.1
        x.append([0.0 if bad or unseen else np.log1p(n), 0.0, np.log1p(count.get(w[:at], 0)), np.log1p(count.get(w[at:], 0)), 0.0 if unseen else np.log1p(n)])
        y.append(1)
    for c, n in compounds * max(1, len(x) // max(1, 4 * len(compounds))):
        a, b = c.split("-", 1)
        seen = 0 if rng.random() < 0.2 else n
        x.append([np.log1p(count.get(a + b, 0)), np.log1p(seen), np.log1p(count.get(a, 0)), np.log1p(count.get(b, 0)), 0.0])
        y.append(0)
    if not compounds:  # without any compound known: parts that are both words
        for a, n in words[:50]:
            x.append([0.0, 1.0, np.log1p(n), np.log1p(n), 0.0])
            y.append(0)
    return Boosted(trees=30).fit(np.array(x), np.array(y, float)) if x else Boosted()


def candidates(suspects: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(w, c): for each suspect the words that share at least half of its folded q-grams; an inverted join, no pair is formed without a shared gram.

    The few most widespread grams of a word say nothing and would make the join quadratic: every
    word is found by its rarest half of grams (a word that shares half of all grams with it shares
    at least one of any half plus one).
    """
    fold = F.pandas_udf(lambda s: s.map(skeleton), "string")
    gram = "array_distinct(transform(sequence(1, length(f) + 1), i -> substring(concat('^', f, '$'), i, 2)))"
    s = suspects.select("w", fold("w").alias("f")).filter("length(f) >= 2").withColumn("gs", F.expr(gram))
    c = lexicon.select(F.col("w").alias("c"), fold("w").alias("f")).filter("length(f) >= 2").withColumn("gc", F.expr(gram))
    spread = c.select(F.explode("gc").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    ranked = s.select("w", F.size("gs").alias("n"), F.explode("gs").alias("g")).join(spread, "g", "left")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.coalesce("df", F.lit(0)), "g")))
    some = ranked.filter("r <= n div 2 + 1 and df is not null").select("w", "g")
    met = some.join(c.select("c", "gc", F.explode("gc").alias("g")), "g").select("w", "c").distinct()
    both = met.join(s.select("w", "gs"), "w").join(c.select("c", "gc"), "c")
    return both.filter("size(array_intersect(gs, gc)) * 2 >= size(gs)").select("w", "c")


def _next_running(heads: DataFrame) -> DataFrame:
    """heads (work_id, n, part, first_token) of running segments -> (work_id, n, part, next_n, next_part, next_token), however far the next is.

    A work is cut into blocks of BLOCK numbers; the first segment of later blocks is looked up in
    the short list of blocks, so that a work of a third of all segments is no single task.
    """
    here = heads.withColumn("block", F.expr(f"n div {BLOCK}")).withColumn("h", F.struct("n", "part", "first_token"))
    order = Window.partitionBy("work_id", "block").orderBy("n", "part")
    inside = here.withColumn("follow", F.lead("h").over(order))
    firsts = here.groupBy("work_id", "block").agg(F.min("h").alias("h"))
    later = firsts.select("work_id", "block", F.lead("h").over(Window.partitionBy("work_id").orderBy("block")).alias("later"))
    out = inside.join(later, ["work_id", "block"]).withColumn("follow", F.coalesce("follow", "later"))
    return out.select("work_id", "n", "part", F.col("follow.n").alias("next_n"), F.col("follow.part").alias("next_part"), F.col("follow.first_token").alias("next_token"))


KEY = ["work_id", "n", "part"]


def scan_findings(segments: DataFrame, clean: DataFrame) -> dict[str, DataFrame]:
    """lines (with kinds), joins, corrections and findings for the segments of scanned works.

    segments: (work_id, n, part, raw, ref, apparatus), repeated rows counted once; clean: (body) of
    cleanly transcribed texts.  Null raw or key: left out.  Empty raw: one blank line.  An empty
    lexicon leaves every word as it is.
    """
    spark = segments.sparkSession
    rows = segments.filter("raw is not null and work_id is not null and n is not null and part is not null")
    rows = rows.groupBy(*KEY).agg(F.min(F.struct("raw", "ref", "apparatus")).alias("r")).select(*KEY, "r.raw", "r.ref", F.coalesce("r.apparatus", F.lit(False)).alias("apparatus"))

    tokens_of_clean = clean.select(F.explode(F.split(canonical_col(F.col("body")), " ")).alias("t")).select(word(F.col("t")).alias("w")).filter("length(w) > 0")
    lexicon = written(tokens_of_clean.groupBy("w").agg(F.count("*").alias("count")), "lexicon")
    sample = [(r[0], r[1]) for r in lexicon.filter(f"count >= {TRUSTED} and w rlike '^[a-z]+$'").orderBy(F.xxhash64("w")).limit(SAMPLE).collect()]

    frequent = lexicon.filter("w rlike '^[a-z]+$'").orderBy(F.desc("count"), "w").limit(SAMPLE // 5).collect()
    sample = sorted(set(sample) | {(r[0], r[1]) for r in frequent if r[1] >= TRUSTED})

    sampled = hash_sample(rows.filter(F.length("raw") <= SAMPLE_CHARS), KEY, SAMPLE // 10, segments.count()).select("work_id", "raw").collect()
    titles = sorted({re.sub(r"-", " ", r[0]) for r in sampled})
    texts = sorted({x for r in sampled for x in r[1].split("\n") if len(x) > 25 and re.search(r"[a-z]{3}.*[a-z]{3}", x)})
    lines = written(classified_lines(rows, furniture_model(titles, texts), page_model(texts)), "lines")

    # Text lines of a segment in order, and where text goes on after its last one.
    text = lines.filter("kind = 'text' and running").withColumn("tokens", F.filter(F.split(F.trim("line"), r"\s+"), lambda t: F.length(t) > 0))
    order = Window.partitionBy(*KEY).orderBy("line_no")
    text = text.withColumn("next_line", F.lead("line_no").over(order)).withColumn("next_tok", F.lead(F.element_at("tokens", 1)).over(order)).withColumn("is_first", F.lag("line_no").over(order).isNull())
    heads = text.filter("is_first").select(*KEY, F.element_at("tokens", 1).alias("first_token"))
    follow = _next_running(heads)
    last = text.filter("next_line is null").join(follow, KEY, "left")
    bodies = [r[0] for r in hash_sample(clean.filter(F.length("body") <= SAMPLE_CHARS), ["body"], SAMPLE, clean.count()).orderBy("body").collect()]
    goes_on = goes_on_model(bodies)

    def judge_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([goes_on_features(a, b) for a, b in zip(pdf["line"], pdf["next_token"])]).reshape(-1, len(GOES_ON_FEATURES))
            yield pdf.loc[goes_on.score(x) >= 0.5, ["work_id", "n", "part", "line_no"]]

    continued = last.filter("next_n is not null").select(*KEY, "line_no", "line", "next_token").mapInPandas(judge_pairs, "work_id string, n int, part int, line_no int").withColumn("kind", F.lit("continued"))

    ends = text.filter("next_line is not null").select(*KEY, "line_no", "tokens", F.col("next_tok").alias("follow"), F.col("n").alias("f_n"), F.col("part").alias("f_part"), F.col("next_line").alias("f_line")).unionByName(
        last.select(*KEY, "line_no", "tokens", F.col("next_token").alias("follow"), F.col("next_n").alias("f_n"), F.col("next_part").alias("f_part"), F.lit(None).cast("int").alias("f_line"))
    )
    cut = ends.withColumn("tail", F.element_at("tokens", -1)).filter(F.col("tail").rlike(rf"[\p{{L}}\p{{N}}|'][{HYPHENS}]$") & F.col("follow").rlike(r"^[\p{L}\p{N}|]"))
    cut = cut.withColumn("a", F.regexp_replace(word(F.regexp_replace("tail", rf"[{HYPHENS}]$", "")), "^.*[—–]", "")).withColumn("b", word(F.col("follow")))
    cut = cut.withColumn("joined", F.concat("a", "b")).withColumn("compound", F.concat("a", F.lit("-"), "b")).withColumn("key", F.struct(*KEY, "line_no"))

    # Compounds stand with their hyphen inside lines, of scans as of clean text.
    in_line = text.select(F.explode(F.expr("slice(tokens, 2, greatest(size(tokens) - 2, 0))")).alias("t")).select(word(F.col("t")).alias("w"))
    compounds = in_line.filter(r"w rlike '^[a-z]+(-[a-z]+)+$'").groupBy("w").agg(F.count("*").alias("count")).unionByName(lexicon.filter(r"w rlike '^[a-z]+(-[a-z]+)+$'"))
    compounds = compounds.groupBy("w").agg(F.sum("count").alias("count"))
    known = written(lexicon.filter(~F.col("w").contains("-")).unionByName(compounds), "known-words")
    model = join_model(sample, [(r[0], r[1]) for r in known.filter("w like '%-%'").orderBy(F.xxhash64("w")).limit(SAMPLE).collect()])
    asked = cut.select("key", F.explode(F.expr("map('joined', joined, 'compound', compound, 'first', a, 'second', b)")).alias("role", "w"))
    counts = asked.join(known, "w", "left").groupBy("key").pivot("role", ["joined", "compound", "first", "second"]).agg(F.max("count"))
    fold = F.pandas_udf(lambda s: s.map(skeleton), "string")
    folded = known.filter(f"count >= {TRUSTED} and w not like '%-%'").select(fold("w").alias("f"), "count").groupBy("f").agg(F.max("count").alias("folded"))
    scored = cut.select("key", "joined", "compound", "a", "b", "f_n", "f_part", "f_line", fold("joined").alias("f")).join(
        counts.select("key", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("joined", "compound", "first", "second")]), "key"
    ).join(folded, "f", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.log1p(pdf[["n_joined", "n_compound", "n_first", "n_second", "folded"]].fillna(0).to_numpy(float))
            yield pdf.assign(p=model.score(x))[["work_id", "n", "part", "line_no", "joined", "compound", "a", "b", "f_n", "f_part", "f_line", "p"]]

    joins = written(
        scored.select("key.*", "joined", "compound", "a", "b", "f_n", "f_part", "f_line", "n_joined", "n_compound", "n_first", "n_second", "folded")
        .mapInPandas(judge, "work_id string, n int, part int, line_no int, joined string, compound string, a string, b string, f_n int, f_part int, f_line int, p double"), "joins"
    )
    hyphen = joins.filter("p >= 0.5").select(*KEY, "line_no", F.lit("hyphen").alias("kind"))

    # Words of the running text: whole tokens, and cut words put together (both lines are looked at).
    parts = joins.select(*KEY, "line_no", F.lit(True).alias("cut_end")).distinct()
    starts = joins.select("work_id", F.col("f_n").alias("n"), F.col("f_part").alias("part"), F.col("f_line").alias("line_no"), F.lit(True).alias("cut_start"))
    firsts = text.filter("is_first").select(*KEY, F.col("line_no").alias("first_line"))
    starts = starts.join(firsts, KEY, "left").select(*KEY, F.coalesce("line_no", "first_line").alias("line_no"), "cut_start").distinct()
    whole = text.join(parts, [*KEY, "line_no"], "left").join(starts, [*KEY, "line_no"], "left")
    size = F.size("tokens") - F.coalesce(F.col("cut_end").cast("int"), F.lit(0)) - F.coalesce(F.col("cut_start").cast("int"), F.lit(0))
    whole = whole.withColumn("ts", F.slice("tokens", F.when(F.col("cut_start"), 2).otherwise(1), F.greatest(size, F.lit(0))))
    # an em dash in the middle of a token parts two words
    tokens = whole.select(*KEY, "line_no", F.explode("ts").alias("t")).select(*KEY, "line_no", F.explode(F.split("t", "[—–]+")).alias("t")).select(*KEY, "line_no", word(F.col("t")).alias("w"))
    compound_join = joins.select(*KEY, "line_no", F.when(F.col("p") >= 0.5, F.col("joined")).otherwise(F.col("compound")).alias("w"), "a", "b", "f_n", "f_part", "f_line")
    tokens = written(tokens.filter("length(w) > 0 and not w rlike '^[0-9]+([.,:][0-9]+)*$'"), "tokens")
    types = tokens.select("w").unionByName(compound_join.select("w")).groupBy("w").agg(F.count("*").alias("own"))
    trusted = known.filter(f"count >= {TRUSTED}")
    suspects = written(types.filter("length(w) >= 2 or w = '|'").join(trusted, "w", "left_anti"), "suspects")
    # words that clean text happens not to have may correct others too, if the scans have them often
    total = types.agg(F.sum("own").alias("total"))  # one row
    often = suspects.filter(r"w rlike '^[a-z]+$'").crossJoin(total).filter(f"own >= {SHARE} * total").select("w", F.lit(0).cast("bigint").alias("count"))
    lexical = trusted.filter(r"w rlike '^[a-z][a-z-]*$'").unionByName(often)
    # how often a word stands in clean texts and scans together
    uses = lexical.join(types, "w", "left").select(F.col("w").alias("c"), (F.col("count") + F.coalesce("own", F.lit(0))).alias("count"))
    met = candidates(suspects, lexical).filter("w <> c")
    # digits and letters mixed: maybe a number of which digits were read as letters
    mixed = suspects.filter(r"w rlike '^[0-9oli|s]*[0-9][0-9oli|s]*[.]?$' and w rlike '[oli|s]'").select("w", F.translate("w", "oli|s", "01115").alias("c"), "own", F.col("own").alias("count"))
    pairs = met.join(suspects, "w").join(uses, "c").select("w", "c", "own", "count").unionByName(mixed)
    rank = ranking_model(sample)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([word_features(*v) for v in zip(pdf["w"], pdf["c"], pdf["count"], pdf["own"])], float).reshape(-1, len(WORD_FEATURES))
            # an exact check: what is seen nearly as often as its supposed original is a word of its own (figures are no words)
            rare = (pdf["count"] >= RARER * pdf["own"]) | pdf["c"].str.contains(r"^\d", regex=True)
            yield pd.DataFrame({"w": pdf["w"], "c": pdf["c"], "p": np.where(rare, rank.score(x), 0.0), "count": pdf["count"]})

    best = pairs.mapInPandas(ranked, "w string, c string, p double, count bigint").groupBy("w").agg(F.max(F.struct("p", "count", "c")).alias("best"))
    fixes = written(best.filter("best.p >= 0.5").select("w", F.col("best.c").alias("c")), "corrections")
    wrong = tokens.join(fixes, "w").select(*KEY, "line_no")
    # of a cut word the part that differs from the correction is the misread one
    cut_wrong = compound_join.join(fixes, "w").withColumn("in_first", ~F.expr("startswith(c, a)"))
    second = cut_wrong.filter("not in_first").select("work_id", F.col("f_n").alias("n"), F.col("f_part").alias("part"), F.col("f_line").alias("line_no")).join(firsts, KEY, "left").select(*KEY, F.coalesce("line_no", "first_line").alias("line_no"))
    wrong = wrong.unionByName(cut_wrong.filter("in_first").select(*KEY, "line_no")).unionByName(second)
    misread = wrong.distinct().withColumn("kind", F.lit("misread"))

    furniture = lines.filter("kind in ('header', 'page_no')").select(*KEY, "line_no", "kind")
    found = furniture.unionByName(hyphen).unionByName(misread).unionByName(continued)
    return {"lines": lines, "joins": joins, "fixes": fixes, "found": found.distinct(), "continued": continued}


def scanned_works(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of works without imported passages, and the bodies of those with."""
    passages = delivered_once(table(spark, sf_dir, "passages").select("id", "work_id", "body", "created_at"), "id", "created_at")
    imported = passages.select("work_id").distinct()
    segments = table(spark, sf_dir, "segments").select(*KEY, "raw", "ref", "apparatus").join(imported, "work_id", "left_anti")
    return segments, passages.select("body").filter("body is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_findings(*scanned_works(spark, sf_dir))["found"]


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, n, part, text): continuous paragraphs under the segment they begin in, repaired."""
    got = scan_findings(*scanned_works(spark, sf_dir))
    return repaired(got)


def repaired(got: dict[str, DataFrame]) -> DataFrame:
    lines = got["lines"].filter("kind = 'text' and running")
    joins = got["joins"]
    ends = joins.select(*KEY, "line_no", F.when(F.col("p") >= 0.5, "").otherwise("-").alias("glue"))
    words = lines.withColumn("last", F.max("line_no").over(Window.partitionBy(*KEY))).join(ends, [*KEY, "line_no"], "left")
    # a line without its hyphen, and whether the next is glued to it
    bare = F.when(F.col("glue").isNotNull(), F.regexp_replace(F.trim("line"), rf"[{HYPHENS}]$", "")).otherwise(F.trim("line"))
    line = F.concat(F.regexp_replace(bare, r"\s+", " "), F.coalesce("glue", F.lit(" ")))
    text = words.groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", line.alias("x")))), lambda v: v["x"]), "").alias("text"))
    # segments that go on are added to the one they go on from: paragraph number = count of paragraph starts up to here, by blocks of a work
    goes_on = got["continued"].select(*KEY, F.lit(1).alias("goes_on"))
    seg = text.join(goes_on, KEY, "left").withColumn("block", F.expr(f"n div {BLOCK}")).withColumn("s", F.struct("n", "part"))
    order = Window.partitionBy("work_id", "block").orderBy("s")
    seg = seg.withColumn("before", F.lag(F.struct(F.coalesce("goes_on", F.lit(0)).alias("g"))).over(order))
    ends_of_block = seg.groupBy("work_id", "block").agg(F.max_by(F.coalesce("goes_on", F.lit(0)), "s").alias("g"))
    carry = ends_of_block.select("work_id", "block", F.lag("g").over(Window.partitionBy("work_id").orderBy("block")).alias("carry"))
    seg = seg.join(carry, ["work_id", "block"]).withColumn("starts", F.coalesce(F.col("before.g"), "carry", F.lit(0)) == 0)
    own = F.last(F.when(F.col("starts"), F.col("s")), ignorenulls=True).over(order)
    last_start = seg.filter("starts").groupBy("work_id", "block").agg(F.max("s").alias("m"))
    blocks = seg.select("work_id", "block").distinct().join(last_start, ["work_id", "block"], "left")
    earlier = blocks.select("work_id", "block", F.last("m", ignorenulls=True).over(Window.partitionBy("work_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    seg = seg.withColumn("own", own).join(earlier, ["work_id", "block"]).withColumn("head", F.coalesce("own", "earlier", "s"))
    whole = seg.groupBy("work_id", "head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "text"))), lambda v: v["text"]), "").alias("text"))
    whole = whole.select("work_id", F.col("head.n").alias("n"), F.col("head.part").alias("part"), F.trim("text").alias("text"))
    # corrections, word by word
    tokens = whole.select(*KEY, F.posexplode(F.split("text", " ")).alias("pos", "t")).withColumn("w", word(F.col("t")))
    fixed = tokens.join(got["fixes"], "w", "left").withColumn(
        "t", F.when(F.col("c").isNull(), F.col("t")).otherwise(F.concat(F.regexp_extract("t", r"^[^\p{L}\p{N}|]*", 0), F.when(F.col("t").rlike(r"^[^\p{L}\p{N}|]*\p{Lu}"), F.initcap("c")).otherwise(F.col("c")), F.regexp_extract("t", r"[^\p{L}\p{N}|]*$", 0)))
    )
    return fixed.groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda v: v["t"]), " ").alias("text"))
