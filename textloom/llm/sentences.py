"""Sentence boundaries in any of the corpus' scripts.

The rules are compiled once into a finite transducer over *events* (end marks, quotes, numbers,
line ends ..., each with a bit for letters in front of it).  What an event is depends on at most
WINDOW characters on either side of it and on the layout of its document; all longer memory is in
the transducer's state.  A chunk of a document is evaluated for every state at once, i.e. as a
function state -> state; the functions are composed by a parallel prefix scan, which yields the
state in front of each chunk, and a second pass over the chunk then writes its events out.  Chunks
are cut inside tasks (numpy) and, for texts over LONG characters, also by Spark, so that one
enormous document is worked on by many tasks; where chunks are cut makes no difference.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.shared import written
from textloom.sources.tables import delivered_once, table

#: Texts over LONG characters are cut into pieces of that size by Spark; STEP events make one chunk inside a task; SCAN pieces are scanned by one task.
LONG, STEP, SCAN = 32_768, 64, 256
#: An event looks at no more than WINDOW characters on either side of it; pieces bring CONTEXT of them along.
WINDOW, CONTEXT = 64, 96

# Characters by role.
INVISIBLE = "­​-‏⁠﻿"
CLOSERS = "”’»」』》｣\"'"
PAIRS = [("“„", "”"), ("«", "»"), ("‘", "’"), ('"', '"'), ("「｢", "」｣"), ("『", "』"), ("《", "》"), ("'", "'")]
TITLE = 6  # marks of titles, not of speech
# Abbreviations whose dots end nothing, by language of the text.
ABBREVIATIONS = [
    "πρβλ.", "τ. ἔ.", "κ.τ.λ.", "κ. τ. λ.", "δηλ.", "prbl.", "t. e.", "k.t.l.",
    "i.e.", "e.g.", "cf.", "ff.", "etc.", "viz.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "Rev.",
    "עי.", "וכו'.", "पृ.", "उदा.", "इत्यादि...", "ityādi...",
]

_GAP = rf"[\s{INVISIBLE}]"
_QUOTE = "".join(a + b for a, b in PAIRS)
_FULL = "。！？｡!?׃।|"
# Only these characters can begin an event, each by itself (of a run of like marks the last); what a dot means is looked up in the word in front of it.
EVENT = re.compile(rf"(?P<verse>॥)|(?P<quote>[{_QUOTE}])|(?P<dot>[.．])|(?P<full>[{_FULL}](?![{_FULL}]))|(?P<semi>[;\u037e])|(?P<line>\n)|(?P<wide>　(?!　))|(?P<part>[也矣焉哉耳乎])")
_ABBREVIATED = tuple(ABBREVIATIONS)
_SHORT = {re.sub(rf"[{INVISIBLE}]", "", f) for a in ABBREVIATIONS for w in a.split(" ") for f in (w, unicodedata.normalize("NFD", w))}
_BEFORE_NUMBER = {"no.", "vol.", "pp.", "p.", "ch.", "fol."}  # abbreviations only in front of a number
_INITIAL = re.compile(r"(?:[A-Za-zΑ-Ωα-ωἀ-ὧ][̀-ͯ]?|[A-Z]h)\.")
_ORDINAL = re.compile(r"\d{1,4}\.")
_HIDDEN_RE = re.compile(f"[{INVISIBLE}]+")
_LEADS = "(([{“„«‘'\"–—"
INVISIBLE_SET = frozenset("\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
HAS_END = re.compile(r"[。！？｡．!?׃।॥|;\u037e]|[^.\s]\.(?:[\s”’»\"')\]]|\Z)")
_AFTER = re.compile(rf"[.;\u037e?!](?<=\S\S.)\s{{1,{WINDOW}}}(?:\(\S{{1,20}}\) )?([^\W\d_])")
_SPACE = re.compile(rf"{_GAP}{{0,{WINDOW}}}")
_LETTER = re.compile(r"[^\W_]")
_NUMBERED = re.compile(rf"{_GAP}{{0,8}}[\d०-९]{{1,6}}{_GAP}{{0,8}}॥")
_CLOSED = re.compile(rf"॥{_GAP}{{0,8}}[\d०-९]{{1,6}}{_GAP}{{0,8}}\Z")


def _dot(text: str, a: int) -> tuple[str, int]:
    """What the dot at a is, skip, number (of what follows, if nothing stands before it) or full; and where it begins."""
    b = a + 1
    after = text[b : b + 1]
    if after in ".．" and after or text[a - 1 : a] in ".．" and a:
        return "skip", a
    if after and not after.isspace() and after not in CLOSERS and after not in ")]" and after not in INVISIBLE_SET:
        return "skip", a  # inside a number, an address, an abbreviation
    begin = max(0, a - 40)
    begin = max(text.rfind(" ", begin, a), text.rfind("\n", begin, a), begin - 1) + 1
    for k in range(a - 1, begin - 1, -1):
        if text[k].isspace():
            begin = k + 1
            break
    word = text[begin:b].lstrip(_LEADS)
    if not word.isascii():
        word = _HIDDEN_RE.sub("", word)
    if word in _SHORT:
        return "skip", a
    end = _SPACE.match(text, b).end()
    if word in _BEFORE_NUMBER and text[end : end + 1].isdigit():
        return "skip", a
    if _INITIAL.fullmatch(word):
        return ("skip" if end < len(text) else "full"), a
    if _ORDINAL.fullmatch(word) and after.isspace():
        begin = a
        while begin and a - begin < 4 and text[begin - 1].isdigit():
            begin -= 1
        return "number", begin
    return "full", a


# States: 0 nothing but markers yet, 1 words seen, 2 words seen but none since a quote, 3 an end mark stands right before a closer;
# then for each kind of quote: opened in front of / inside the sentence x words seen in it, none since an event, an end mark right before its closer.
START, IN, FRESH, PEND, QUOTES = 0, 1, 2, 3, 4
STATES = QUOTES + 6 * len(PAIRS)
# Event classes: nothing; end mark followed by a closer / by something else; end of a line or phrase; number with a dot, in front of a capital / a lower-case letter; quote kind x (open, close) x next is a lower-case letter.
NOTHING, END_CLOSER, END, BREAK, NUMBER, NUMBER_LOW = range(6)
QUOTE0 = 6  # + kind*4 + closes*2 + low
CLASSES = 2 * (QUOTE0 + 4 * len(PAIRS))  # each without and with letters in front of it
LETTERS = 2 * NOTHING + 1
# Outputs.
SILENT, CUT, MAYBE, OPEN, SHUT, SHUT_CUT, AGAIN = range(7)


def compile_rules() -> tuple[np.ndarray, np.ndarray]:
    """The transducer as two tables, next state and output, by [state, event class]."""
    plain_to = np.tile(np.arange(STATES)[:, None], (1, CLASSES // 2))
    out = np.zeros((STATES, CLASSES // 2), np.int8)
    read = np.arange(STATES)  # what letters do
    read[[START, FRESH, PEND]] = IN
    for s in (START, IN, FRESH, PEND):
        plain_to[s, END_CLOSER] = PEND
        plain_to[s, END], out[s, END] = START, CUT
        if s != START:
            plain_to[s, BREAK], out[s, BREAK] = START, CUT
        if s in (IN, PEND):  # else the number stands in front of its sentence
            plain_to[s, NUMBER], out[s, NUMBER] = START, CUT
            plain_to[s, NUMBER_LOW] = IN
        for kind in range(len(PAIRS)):
            for low in (0, 1):
                c = QUOTE0 + kind * 4 + low
                plain_to[s, c], out[s, c] = QUOTES + 6 * kind + 3 * (s in (IN, FRESH)) + 1, OPEN
                # a stray closer: only ends the sentence if an end mark waits
                plain_to[s, c + 2], out[s, c + 2] = (START, CUT) if s == PEND and not low else (START if s == START else FRESH, SILENT)
    for kind in range(len(PAIRS)):
        for inside in (0, 1):
            first = QUOTES + 6 * kind + 3 * inside
            plain, fresh, ended = first, first + 1, first + 2
            for s in (plain, fresh, ended):
                read[s] = plain
                plain_to[s, END_CLOSER] = ended
                for c in (END, BREAK):
                    plain_to[s, c], out[s, c] = fresh, MAYBE
                if s != fresh:
                    plain_to[s, NUMBER], out[s, NUMBER] = fresh, MAYBE
                    plain_to[s, NUMBER_LOW] = plain
                for other in range(len(PAIRS)):
                    for low in (0, 1):
                        c = QUOTE0 + other * 4 + low
                        if other != kind:
                            plain_to[s, c] = plain_to[s, c + 2] = ended if s == ended else fresh
                        else:
                            plain_to[s, c], out[s, c] = QUOTES + 6 * kind + 4, AGAIN
                            cut = s == ended and inside and not low and kind != TITLE
                            plain_to[s, c + 2], out[s, c + 2] = (START, SHUT_CUT) if cut else (FRESH, SHUT)
    to = np.empty((STATES, CLASSES), np.int16)
    said = np.empty((STATES, CLASSES), np.int8)
    to[:, 0::2], said[:, 0::2] = plain_to, out
    to[:, 1::2], said[:, 1::2] = plain_to[read], out[read]
    return to, said


NEXT, OUT = compile_rules()
_KIND = {}
for _k, (_a, _b) in enumerate(PAIRS):
    for _c in _a:
        _KIND[_c] = (_k, 0)
for _k, (_a, _b) in enumerate(PAIRS):
    for _c in _b:
        if _c not in _KIND:
            _KIND[_c] = (_k, 1)


def layout(text: str) -> str:
    """What separates sentences in this text: m(arks), v(erse numbers), or without marks w(ide spaces), l(ines), p(articles); + c where sentences start in lower case; + g where it has Greek letters."""
    greek = "g" if _GREEK.search(text) else ""
    if "॥" in text:
        how = "v"
    elif HAS_END.search(text):
        how = "m"
    elif "\n" in text:
        how = "l"
    elif "　" in text:
        how = "w"
    else:
        how = "p"
    if how == "m":
        starts = [m for m in _AFTER.finditer(text) if not text.endswith(_ABBREVIATED, max(0, m.start() - 10), m.start() + 1)]
        first = _LETTER.search(text)
        low = sum(m.group(1).islower() for m in starts)
        if low > len(starts) - low or (low and first and (first.group().islower() or "Ͱ" <= first.group() <= "Ͽ")):
            how += "c"
    return how + greek


def events(text: str, how: str, begin: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """(event class, end of the event) of the events whose mark stands in [begin, stop); letters behind the last one are an event of their own.

    Each depends on `how` and on WINDOW characters around it only, so the events of a text are
    those of its parts, wherever it is parted.
    """
    stop = len(text) if stop is None else stop
    found, last, tail = [], begin, stop
    lines, wide, parts, verse, lower, greek = ("l" in how), ("w" in how), ("p" in how), ("v" in how), ("c" in how), ("g" in how)
    marked = not (lines or wide or parts)
    for m in EVENT.finditer(text, begin):
        a = start = m.start()
        kind, c = m.lastgroup, text[a]
        if a >= stop:
            if kind == "dot":  # the digits of a number whose dot belongs to the next chunk are not letters here
                kind, start = _dot(text, a)
                tail = min(tail, start) if kind == "number" else tail
            break
        b = a + 1
        if kind == "dot":
            kind, start = _dot(text, a)
            if kind == "skip" or kind == "full" and not marked:
                continue
            kind = "dot" if kind == "full" else kind
        elif kind == "quote":
            k, closes = _KIND[c]
            before = text[a - 1] if a else " "
            if c in "\"'":
                closes = int(not (before.isspace() or before in "([–—“‘„«" or before in "​﻿⁠"))
                if c == "'" and closes and text[b : b + 1].isalpha():
                    continue
            elif c in "’‘" and a and before.isalpha() and text[b : b + 1].isalpha():
                continue
            elif c in "”“" and k == 0 and closes == 0 and a and not (before.isspace() or before in "([–—‘«​﻿⁠:："):
                closes = int(c == "”")
            after = _SPACE.match(text, b).end()
            low = text[after : after + 1].islower() and not lower and before != "."
            found.append((2 * (QUOTE0 + k * 4 + closes * 2 + low) + (_LETTER.search(text, last, a) is not None), b))
            last = b
            continue
        elif kind == "full":
            if not marked or verse and c in "।|" or c == "|" and b < len(text) and not text[b].isspace() and text[b] not in CLOSERS:
                continue
        elif kind == "semi":
            if not greek or not marked:
                continue
        elif kind == "verse":
            # the stroke in front of a verse's number ends nothing, the one behind it does
            if not verse or _NUMBERED.match(text, b) and not _CLOSED.search(text, max(0, a - 24), a):
                continue
        elif kind == "line" and not lines or kind == "wide" and not wide or kind == "part" and not parts:
            continue
        after = _SPACE.match(text, b).end()
        low = c == "." and not lower and text[after : after + 1].islower()
        if low and kind == "dot":
            continue
        at = b
        while at < len(text) and at < b + WINDOW and text[at] in INVISIBLE_SET:
            at += 1
        closer = text[at : at + 1]
        if closer and closer in ")]":
            continue
        if kind == "number":
            cls = NUMBER_LOW if low or not marked else NUMBER
        elif closer and closer in CLOSERS:
            cls = END_CLOSER
        else:
            cls = BREAK if kind in ("line", "wide") else END
        found.append((2 * cls + (_LETTER.search(text, last, start) is not None), b))
        last = b
    if _LETTER.search(text, last, tail) is not None:
        found.append((LETTERS, stop))
    return found


def functions_of(classes: np.ndarray) -> np.ndarray:
    """Rows of event classes (padded with NOTHING) -> the function state -> state of each row."""
    f = np.tile(np.arange(STATES, dtype=np.int16), (len(classes), 1))
    for k in range(classes.shape[1]):
        f = NEXT[f, classes[:, k, None]]
    return f


def scan(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the rows of f, started anew where first is set (Hillis-Steele, log2 rounds)."""
    f, reach, n = f.copy(), np.arange(len(f)), len(f)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while step <= (reach - begin).max(initial=0):
        on = np.nonzero(reach - begin >= step)[0]
        f[on] = np.take_along_axis(f[on], f[on - step].astype(np.int64), axis=1)
        step *= 2
    return f


def outputs(classes: np.ndarray, doc: np.ndarray, state0: np.ndarray) -> np.ndarray:
    """The transducer's output for each event; doc: number of its document (ascending, from 0), state0: state each document starts in."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int8)
    per = np.bincount(doc, minlength=len(state0))
    chunks = -(-per // STEP)
    base = np.concatenate([[0], np.cumsum(chunks)])
    place = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(per)])[:-1], per)
    row, col = base[doc] + place // STEP, place % STEP
    grid = np.zeros((base[-1], STEP), np.int16)
    grid[row, col] = classes
    owner = np.repeat(np.arange(len(state0)), chunks)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    state = state0[owner].astype(np.int64)
    rest = np.nonzero(~first)[0]
    if len(rest):  # a chunk with another one behind it is a function of the state in front of it
        whole = scan(functions_of(grid[rest - 1]), first[rest - 1])
        state[rest] = whole[np.arange(len(rest)), state0[owner[rest]]]
    out = np.zeros(grid.shape, np.int8)
    for k in range(int(min(per.max(), STEP))):
        out[:, k] = OUT[state, grid[:, k]]
        state = NEXT[state, grid[:, k]]
    return out[row, col]


def _fates(said: list[tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """Outputs (what, end) -> (cuts, cuts still open at the end, what the first output says that decides over open ones in front: 0 none, 1 they hold, 2 they do not)."""
    cuts, held, first = [], [], 0
    for what, end in said:
        if what == CUT:
            cuts.append(end)
        elif what == MAYBE:
            held.append(end)
        else:  # cuts inside a quote hold only if the quote is never closed
            holds = what in (OPEN, AGAIN)
            first = first or (1 if holds else 2)
            cuts += held if holds else []
            held = []
            if what == SHUT_CUT:
                cuts.append(end)
    return sorted(cuts), held, first


def spans(text: str, said: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sentences from the outputs (what, end) of a whole text."""
    cuts, held, _ = _fates(said)
    found, at = [], 0
    for end in [*sorted(cuts + held), len(text)]:
        a, b = at, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        at = end
        if a == b:
            continue
        if found and _LETTER.search(text, a, b) is None:  # marks alone belong to the sentence before
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def split_many(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Sentence spans of whole texts."""
    found = [events(t, layout(t)) if t else [] for t in texts]
    per = np.array([len(x) for x in found], np.int64)
    doc = np.repeat(np.arange(len(texts)), per)
    classes = np.fromiter((e[0] for x in found for e in x), np.int16, int(per.sum()))
    out = outputs(classes, doc, np.zeros(len(texts), np.int64))
    result, at = [], 0
    for t, x in zip(texts, found):
        said = [(int(o), e[1]) for o, e in zip(out[at : at + len(x)], x) if o]
        at += len(x)
        result.append(spans(t, said))
    return result


# ---- Spark ----------------------------------------------------------------------------------

SENTENCES = "s_no int, s_start int, s_end int"
PIECES = "_doc bigint, _chunk int, _at int, _lead int, _size int, _how string, _slice string"
FUNCTIONS = "_doc bigint, _block int, _chunk int, f array<smallint>"
PARTS = "_doc bigint, _chunk int, k int, cut int, first int, last int, letters boolean, hard int, n_cut int, n_maybe int"


def _whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = split_many(pdf["_text"].tolist())
        per = [len(x) for x in found]
        out = pdf[keys].loc[pdf.index.repeat(per)].reset_index(drop=True)
        flat = np.array([(k, a, b) for x in found for k, (a, b) in enumerate(x)], np.int32).reshape(-1, 3)
        yield out.assign(s_no=flat[:, 0], s_start=flat[:, 1], s_end=flat[:, 2])


def _cut_up(batches: Iterator[pd.DataFrame], keys: list[str], long: int) -> Iterator[pd.DataFrame]:
    """Long texts in pieces, each with its document's layout and with context on both sides."""
    for pdf in batches:
        for n, text in enumerate(pdf["_text"]):
            how, head = layout(text), pdf[["_doc", *keys]].iloc[[n]]
            for some in range(0, len(text), long * SCAN):
                at = np.arange(some, min(len(text), some + long * SCAN), long)
                lead, size = np.minimum(at, CONTEXT), np.minimum(len(text) - at, long)
                slices = [text[a - b : a + c + CONTEXT] for a, b, c in zip(at, lead, size)]
                yield head.loc[head.index.repeat(len(at))].assign(_chunk=at // long, _at=at, _lead=lead, _size=size, _how=how, _slice=slices)


def _piece_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First pass over long texts: each piece as a function of the state in front of it."""
    for pdf in batches:
        rows = []
        for text, how, begin, size in zip(pdf["_slice"], pdf["_how"], pdf["_lead"], pdf["_size"]):
            cls = np.array([e[0] for e in events(text, how, begin, begin + size)], np.int16)
            grid = np.zeros((max(1, -(-len(cls) // STEP)), STEP), np.int16)
            grid.reshape(-1)[: len(cls)] = cls
            rows.append(scan(functions_of(grid), np.arange(len(grid)) == 0)[-1].tolist())
        yield pdf[["_doc", "_chunk"]].assign(_block=pdf["_chunk"] // SCAN, f=rows)[["_doc", "_block", "_chunk", "f"]]


def _scanned(pdf: pd.DataFrame) -> pd.DataFrame:
    """The functions of one block of pieces (or of blocks) -> each with all before it."""
    pdf = pdf.sort_values("_chunk")
    f = scan(np.array(pdf["f"].tolist(), np.int16), np.arange(len(pdf)) == 0)
    return pdf.assign(f=f.tolist())


def _piece_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second pass, with the state in front of each piece known: what lies between its cuts, in places of the whole text; k = -1 sums the piece up."""
    for pdf in batches:
        rows = []
        for doc, chunk, text, how, begin, size, at, state in zip(*(pdf[c] for c in ("_doc", "_chunk", "_slice", "_how", "_lead", "_size", "_at", "_state"))):
            found = events(text, how, begin, begin + size)
            out = outputs(np.array([e[0] for e in found], np.int16), np.zeros(len(found), np.int64), np.array([state]))
            cuts, held, first = _fates([(int(o), e[1]) for o, e in zip(out, found) if o])
            rows.append((doc, chunk, -1, 0, None, None, None, first, len(cuts), len(held)))
            a = begin
            for k, (b, kind) in enumerate(sorted([(c, 1) for c in cuts] + [(c, 2) for c in held]) + [(begin + size, 0)]):
                x, y = a, b
                while x < y and text[x].isspace():
                    x += 1
                while y > x and text[y - 1].isspace():
                    y -= 1
                some = x < y
                rows.append((doc, chunk, k, kind, x + at - begin if some else None, y + at - begin if some else None, some and _LETTER.search(text, x, y) is not None, None, None, None))
                a = b
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PARTS.split(", ")]).astype({c: "Int32" for c in ("first", "last", "hard", "n_cut", "n_maybe")})


def _long_sentences(pieces: DataFrame) -> DataFrame:
    """(_doc, s_no, s_start, s_end) from the pieces of long texts: no task sees more than a block of pieces or of their cuts."""
    # Prefix scan: inside blocks of SCAN pieces, over the blocks of a document, and both put together.
    inside = written(pieces.mapInPandas(_piece_functions, FUNCTIONS).groupBy("_doc", "_block").applyInPandas(_scanned, FUNCTIONS), "piece-functions")
    ends = inside.groupBy("_doc", "_block").agg(F.max_by("f", "_chunk").alias("f")).withColumn("_chunk", F.col("_block"))
    over = ends.select("_doc", "_block", "_chunk", "f").groupBy("_doc").applyInPandas(_scanned, FUNCTIONS)
    front = over.select("_doc", (F.col("_block") + 1).alias("_block"), F.element_at("f", 1).alias("_front"))
    before = inside.select("_doc", F.expr(f"(_chunk + 1) div {SCAN}").cast("int").alias("_block"), (F.col("_chunk") + 1).alias("_chunk"), "f")
    # the first piece of a block starts in the state that block starts in; the first of all in START
    states = before.join(front, ["_doc", "_block"], "left").withColumn("_front", F.coalesce("_front", F.lit(START)))
    state = F.when(F.col("_chunk") % SCAN == 0, F.col("_front")).otherwise(F.element_at("f", (F.col("_front") + 1).cast("int")))
    states = states.select("_doc", "_chunk", state.cast("int").alias("_state"))
    known = pieces.join(states, ["_doc", "_chunk"], "left").withColumn("_state", F.coalesce("_state", F.lit(START)))
    parts = written(known.mapInPandas(_piece_parts, PARTS), "sentence-parts")

    # Cuts left open at the end of a piece are decided by the first later piece that decides anything.
    order = Window.partitionBy("_doc").orderBy("_chunk")
    sums = parts.filter("k = -1").withColumn("hard", F.expr("nullif(hard, 0)"))
    sums = sums.withColumn("holds", F.coalesce(F.first("hard", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(1)) == 1)
    sums = sums.withColumn("n", F.col("n_cut") + F.when(F.col("holds"), F.col("n_maybe")).otherwise(0))
    sums = sums.select("_doc", "_chunk", "holds", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = parts.filter("k >= 0").drop("hard", "n_cut", "n_maybe").join(sums, ["_doc", "_chunk"])
    cut = (F.col("cut") == 1) | ((F.col("cut") == 2) & F.col("holds"))
    earlier = Window.partitionBy("_doc", "_chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("segment", F.col("before") + F.coalesce(F.sum(cut.cast("int")).over(earlier), F.lit(0)))
    segments = rows.filter("first is not null").groupBy("_doc", "segment").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("letters").alias("letters"))
    # marks alone belong to the sentence before
    by_place = Window.partitionBy("_doc").orderBy("segment")
    starts = (F.col("letters") | F.lag("segment").over(by_place).isNull()).cast("int")
    numbered = segments.withColumn("starts", starts).withColumn("s_no", (F.sum("starts").over(by_place) - 1).cast("int"))
    return numbered.groupBy("_doc", "s_no").agg(F.min("first").alias("s_start"), F.max("last").alias("s_end"))


def split_sentences(df: DataFrame, text: str, keys: list[str], long: int = LONG) -> DataFrame:
    """keys + (s_no, s_start, s_end): the sentences of df[text], offsets in code points, end exclusive.

    Null, empty and blank texts have no sentences.  Further columns are ignored; each row is taken
    by itself, with whatever keys (null and repeated ones included).  No shuffle but for texts over
    `long` characters, which are written down in pieces of that length; the result is the same for
    every `long`.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", "
    rows = df.filter(F.col(text).rlike(r"\S")).select(*keys, F.col(text).alias("_text"))
    short = rows.filter(F.length("_text") <= long).mapInPandas(lambda it: _whole(it, keys), schema + SENTENCES)
    big = rows.filter(F.length("_text") > long).withColumn("_doc", F.monotonically_increasing_id())
    pieces = written(big.mapInPandas(lambda it: _cut_up(it, keys, long), schema + PIECES), "long-texts")
    if pieces.isEmpty():
        return short
    heads = pieces.filter("_chunk = 0").select("_doc", *keys)
    whole = heads.join(_long_sentences(pieces.drop(*keys)), "_doc").select(*keys, "s_no", "s_start", "s_end")
    return short.unionByName(whole)


def p2_found(spark, sf_dir: str) -> DataFrame:
    originals = delivered_once(table(spark, sf_dir, "originals").select("id", "body", "transcription", "created_at"), "id", "created_at")
    fields = originals.select(F.col("id").alias("original_id"), F.expr("stack(2, 'body', body, 'transcription', transcription) as (field, text)"))
    return split_sentences(fields, "text", ["original_id", "field"]).select("original_id", "field", "s_start", "s_end")
