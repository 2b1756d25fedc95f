"""Personal information in free text.

A skip-chain conditional random field labels the tokens around everything that might be personal.
Neighbouring tokens share potentials along the chain, repeated or similar capitalised tokens of a
document across it; messages go round over these loops until the labels of a document agree.  The
model is fitted here, on a bounded sample: numbers, addresses and mails are labelled by their form,
names by titles, by contact data next to them, and by surroundings that the sample itself shows to
hold names that stand nowhere else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.shared import hash_sample
from textloom.sources.tables import table

TYPES = ["email", "phone", "id_number", "address", "name"]
LABELS = ["O"] + [f"{b}-{t}" for t in TYPES for b in "BI"]
L = len(LABELS)
#: Documents the model is fitted on, and the length up to which a document may be one of them (all documents are labelled, whole).
SAMPLE, SAMPLE_CHARS = 1_200, 20_000
#: Tokens of context on either side of a place that may be personal; hashed features; rounds of messages.
CONTEXT, SPACE, ROUNDS = 5, 1 << 18, 3
#: Tokens (with padding) of linked windows that are worked on together, if a document has no more.
CELLS = 60_000

_TOKEN = re.compile(r"[^\W\d_]+(?:['’](?![sS]\b)[^\W\d_]+)*|\d+|[^\w\s]|_")
_CAPITALS = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_UP = f"[{_CAPITALS}]"
_NAMEWORD = rf"{_UP}[^\W\d_]*(?:['’](?![sS]\b){_UP}?[^\W\d_]+)?(?:-{_UP}[^\W\d_]+)?"
_PARTICLE = r"(?:van|von|de|der|den|la|VAN|VON|DE|DER|DEN|LA)"
#: Places worth a look; everything else is labelled O without further work.
#: One character class begins every place, so that the scan skips from candidate to candidate; what it is follows by looking back at it.
_ANCHOR = re.compile(
    rf"[@＠(\[{{+0-9{_CAPITALS}](?:(?<=[@＠])|(?<=[(\[{{])\s*at\s*[)\]}}]|(?<=\+)\d|(?<=\()\d[\d().\-\s]{{4,}}\d"
    r"|(?<=\d)(?<!\w.)[\d().\-\s]{5,}\d|(?<=[A-Z])(?<!\w.)[A-Z]?\s?\d{2}"
    rf"|(?<=\d)(?<![.:\w].)\d{{0,3}}[a-z]?,?\s+(?:{_UP}|rue\b)|(?<=P)(?<!\w.)\.?\s?O\.?\s+Box|(?<=F)(?<!\w.)lat\s+\d"
    rf"|(?<={_UP})(?<!\w.)[\w'’-]*(?:(?<=straße)\s+\d|\.?,?\s+(?:{_UP}\.\s+|{_PARTICLE}\s+)*{_UP}[\w'’-]+))"
)

# ---- patterns that label the sample ------------------------------------------------------------

_EMAIL = re.compile(r"[\w.+\-]+(?:@|\s*[(\[{]\s*at\s*[)\]}]\s*)[\w\-]+(?:(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*)[\w\-]+)+", re.I)
_PHONE = re.compile(
    r"(?:\+|00\s)\d{1,3}[\s.\-]*(?:\(0\))?[\s.\-]*\d{2,5}(?:[\s.\-]+\d{2,6}){1,3}|\(\d{3}\)\s*\d{3}[\s.\-]\d{4}|(?<![\d.\-])\d{3}([.\-\s])\d{3}\1\d{4}(?![\d\-])"
    r"|(?<![\d.\-])\d{3}-\d{4}(?![\d\-])|(?<!\d)0\d{2}\s\d{4}\s\d{4}(?!\d)|(?<!\d)0\d{4}\s\d{6}(?!\d)|(?<!\d)0\d{3}\s\d{3}\s\d{4}(?!\d)|(?<!\d)[2-9]\d{9}(?!\d)|(?<!\d)0\d{9,10}(?!\d)"
)
_ID = re.compile(
    r"\b[A-Z]{2}(?:\s?\d{2}){3}\s?[A-Z]\b|\b[A-Z]{1,2}\d{6,9}[A-Z]?\b|(?<![\d\-.])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![\d\-])\d{6}-\d{3,4}[A-Z]?\b|(?<!\d)\d{4}\s\d{4}\s\d{4}(?!\s?\d)|(?<![\d\-.])\d{9}(?![\d\-])"
)
_TO_ID = re.compile(r"(?:passport|national|insurance|identity|security|proof of age|\bID\b|licen[cs]e|tax)[\w\s.:]{0,30}$", re.I)
_TO_PHONE = re.compile(r"(?:tel|tél|phone|ring|call|fax|reached|mobile|questions on|under)[\w\s.:,]{0,14}$", re.I)
_NOT = re.compile(r"(?:\bMS|shelf|microfilm|roll|ISBN|ISSN|lot no|catalogue|price|frames|lines?|pp?\.|dated|draft|entry|volume|siglum)[\w\s.:,\-]{0,18}$", re.I)
_POST = r"(?:[A-Z]{2}\d{1,2}\s\d[A-Z]{2}|(?:[A-Z]{2}\s)?\d{5}|[A-Z]{2}\s\d{2}(?!\d))"
_TOWN = rf"{_UP}[^\W\d_]+(?:-{_UP}[^\W\d_]+)?"
_KIND = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Row|Way|Wharf|Walk|Square|Close|Court|Hill|Gate|Place)\b\.?"
_STREET = (
    rf"(?:(?:Flat|Apt\.?|Unit)\s+\d+[a-z]?,?\s+)?\d{{1,4}}[a-z]?,?\s+(?:rue\s+(?:de\s+la|du|de|des)\s+{_UP}[^\W\d_]+(?:\s+{_UP}[^\W\d_]+)?|(?:{_UP}[^\W\d_]+\s+){{1,3}}?{_KIND}|{_UP}[^\W\d_]{{3,}})"
    rf"|{_UP}[^\W\d_]+(?:straße|strasse|gasse|weg)\s+\d{{1,4}}[a-z]?|P\.?\s?O\.?\s+Box\s+\d+"
)
_ADDRESS = re.compile(rf"(?<![\w.])(?:{_STREET})(?:,\s*|\s*\n\s*)(?:{_POST}\s+)?{_TOWN}(?:(?:,\s*|\s+){_POST})?")
_GIVEN = rf"(?:{_UP}\.|{_NAMEWORD})(?:\s+(?:{_UP}\.|{_PARTICLE}))*\s+{_NAMEWORD}"
_NAME = rf"(?:{_NAMEWORD},\s+{_NAMEWORD}|{_GIVEN})"
_TITLED = re.compile(rf"(?:\b(?:Dr|Mrs|Mr|Ms|Miss|Prof|Mme|Mlle|Madame|Monsieur|Herr|Frau|Sir)\.?|\bc/o|\bcare\s+of|\bFrom:|\bTo:|\bSigned,?)\s+(?:(?:Dr|Mrs|Mr|Ms|Prof)\.?\s+)?({_NAME})")
_RUN = re.compile(rf"(?<![\w.'’-])(?:{_PARTICLE}\s+)?(?:{_UP}\.|{_NAMEWORD}(?![\w-]))(?:\s+(?:{_UP}\.|{_PARTICLE}(?=\s)|{_NAMEWORD}(?![\w-])))*")
_SURNAME_FIRST = re.compile(rf",\s+({_NAMEWORD}(?:\s+{_UP}\.)?)(?![\w-])(?!\s+{_UP})")
_ENDS = set(".!?।॥。\"“”‘’«»")  # what stands between sentences says nothing
#: A name is labelled if contact data begin at most so many characters behind it.
NEAR = 24
#: Surroundings hold personal names if at least NAMES different ones were seen in them, a share of RARE with a word seen in at most PLACES surroundings, and no word in over half of them.
NAMES, RARE, PLACES = 5, 0.75, 5
#: A word seen in lower case so often in the sample begins or ends no name that is labelled; a name has at most so many words.
PLAIN, MOST_WORDS = 3, 4
#: A third or later word that stood in more surroundings than this belongs to what follows the name.
KNOWN = 12
#: A word leads names (a title, a heading) if it stood in front of runs of two or more other capitalised words at least so often, and as often as in front of one.
LEADS = 4


def _form_labels(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of mails, addresses and numbers, none overlapping another."""
    found: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for _, x, y in found):
            found.append((kind, a, b))

    for m in _EMAIL.finditer(text):
        add("email", m.start(), m.end())
    for m in _ADDRESS.finditer(text):
        add("address", m.start(), m.end())
    for pattern, kind in ((_PHONE, "phone"), (_ID, "id_number")):
        for m in pattern.finditer(text):
            left = text[max(0, m.start() - 44) : m.start()]
            if _NOT.search(left):
                continue
            add("id_number" if _TO_ID.search(left) else "phone" if _TO_PHONE.search(left) else kind, m.start(), m.end())
    return found


def _around(text: str, a: int, b: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The two tokens on either side of a place, in lower case, numbers by their length."""
    left = [t.lower() if not t.isdigit() else _shape(t) for t in _TOKEN.findall(text[max(0, a - 40) : a])[-2:]]
    right = [t.lower() if not t.isdigit() else _shape(t) for t in _TOKEN.findall(text[b : b + 40])[:2]]
    return ("<", *left), (">", *right)


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W\d_]{2,}", s)


def _like_names(text: str, leading: set[str], plain: set[str], known: set[str], other: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places of capitalised words that could be a name with surname: without what leads names or also stands in lower case at either end, nothing that belongs to `other`."""
    out = []
    for m in _RUN.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end(), p.group().strip(".")) for p in re.finditer(r"\S+", m.group())]
        while parts and (parts[0][2] in leading or parts[0][2].lower() in plain and len(parts[0][2]) > 1 and not re.fullmatch(_PARTICLE, parts[0][2])):
            parts.pop(0)
        while parts and (parts[-1][2].lower() in plain or parts[-1][1] - parts[-1][0] == 2 and text[parts[-1][1] - 1] == "."):
            parts.pop()
        while len(parts) > 2 and parts[-1][2] in known:
            parts.pop()
        full = sum(len(p[2]) > 1 and p[2][0].isupper() for p in parts)
        if not full or full > MOST_WORDS:
            continue
        a, b = parts[0][0], parts[-1][1]
        if full == 1 and not any(len(p[2]) == 1 for p in parts):
            second = _SURNAME_FIRST.match(text, b)
            if not second or second.group(1).lower() in plain:
                continue
            b = second.end()
        if all(b <= x or a >= y for _, x, y in other):
            out.append((a, b))
    return out


class NameCues:
    """Surroundings of names of private people, learned from a sample: different names stand in them, and hardly ever ones that stand elsewhere."""

    def __init__(self, texts: list[str] = ()):
        lead: dict[str, list[int]] = {}
        low: Counter[str] = Counter()
        for text in texts:
            low.update(re.findall(r"(?<!\S)[a-z]{2,}(?=[.,;:!?]?(?:\s|$))", _EMAIL.sub(" ", text)))
            for m in _RUN.finditer(text):
                words = [w for w in m.group().split() if len(w) > 2]
                if len(words) > 1:
                    lead.setdefault(words[0], [0, 0])[len(words) > 2] += 1
        self.leading = {w for w, (two, more) in lead.items() if more >= LEADS and more >= two} | {"Dr", "Mr", "Mrs", "Ms", "Miss", "Prof", "Mme", "Mlle", "Madame", "Monsieur", "Herr", "Frau", "Sir"}
        self.plain = {w for w, n in low.items() if n >= PLAIN} | {"a"}
        inside: dict[tuple[str, ...], set[str]] = {}
        places: dict[str, set[tuple]] = {}
        self.known: set[str] = set()
        self.forms = {text: _form_labels(text) for text in texts}
        for text, other in self.forms.items():
            for a, b in _like_names(text, self.leading, self.plain, self.known, other):
                left, right = _around(text, a, b)
                inside.setdefault(left, set()).add(text[a:b])
                inside.setdefault(right, set()).add(text[a:b])
                for w in set(_words(text[a:b])):
                    places.setdefault(w, set()).add((left, right))
        self.known = {w for w, at in places.items() if len(at) > KNOWN}
        self.personal = set()
        for at, names in inside.items():
            beside = at[2] if at[0] == "<" and len(at) > 2 else at[1] if len(at) > 1 else "."
            if len(names) < NAMES or beside in _ENDS or not any(t[0].isalpha() for t in at[1:]):
                continue
            split = [_words(n) for n in names]
            rare = sum(min(len(places[w]) for w in ws) <= PLACES for ws in split)
            common = max(sum(w in ws for ws in split) for w in {w for ws in split for w in ws})
            if rare >= RARE * len(names) and common <= len(names) / 2:
                self.personal.add(at)

    def labels(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) that form, titles, contact data, learned surroundings or a name listed beside it are sure of, none overlapping another."""
        found = self.forms[text] if text in self.forms else _form_labels(text)
        begins = sorted(a for _, a, _ in found)
        titled = {m.start(1) for m in _TITLED.finditer(text)}
        maybe = _like_names(text, self.leading, self.plain, self.known, found)
        sure = set()
        for a, b in maybe:
            left, right = _around(text, a, b)
            if a in titled or left in self.personal or right in self.personal or any(b < x <= b + NEAR and not re.search(r"[.!?]\s+[A-Z]", text[b:x]) for x in begins):
                sure.add((a, b))
        for listed in (maybe, maybe[::-1]):  # names listed one after another
            for one, two in zip(listed, listed[1:]):
                if one in sure and text[min(one[1], two[1]) : max(one[0], two[0])].strip() in (",", "and", ", and", "&", ";"):
                    sure.add(two)
        return sorted(found + [("name", a, b) for a, b in sure], key=lambda f: f[1])


# ---- tokens and features -----------------------------------------------------------------------


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token spans around the places worth a look, nearby places together."""
    areas: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - 9 * CONTEXT), m.end() + 9 * CONTEXT
        if areas and a <= areas[-1][1]:
            areas[-1][1] = b
        else:
            areas.append([a, b])
    out = []
    for a, b in areas:
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        spans = [m.span() for m in _TOKEN.finditer(text, a, min(b, len(text)))]
        if spans:
            out.append(spans)
    return out


def _shape(t: str) -> str:
    if t.isdigit():
        return f"9{min(len(t), 10)}"
    if not t[0].isalpha():
        return t
    return ("X" if t.isupper() and len(t) > 1 else "I" if t.isupper() else "Xx" if t[0].isupper() else "x") + ("'" if "'" in t or "’" in t else "")


_M = np.uint64(0x9E3779B97F4A7C15)


def _hash(s: str) -> int:
    h = 1469598103934665603
    for c in s:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


class Features:
    """Hashed features of tokens; what depends on the token alone is worked out once a token."""

    #: (which property, offset) of the single features, and of those taken together
    SINGLE = [(0, d) for d in (-3, -2, -1, 0, 1, 2, 3)] + [(1, d) for d in (-3, -2, -1, 0, 1, 2, 3)] + [(2, -1), (2, 0), (2, 1), (3, 0), (4, 0)]
    JOINT = [((1, -1), (1, 0), (1, 1)), ((1, 0), (1, 1), (1, 2)), ((1, -2), (1, -1), (1, 0)), ((0, -1), (1, 0)), ((0, -2), (0, -1), (1, 0)), ((2, 0), (1, 1)), ((1, 0), (2, 1))]
    COUNT = len(SINGLE) + len(JOINT)

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = [tuple(_hash("<pad>") for _ in range(5))]

    def number(self, t: str) -> int:
        k = self.known.get(t)
        if k is None:
            low = t.lower()
            word = low if not t.isdigit() else _shape(t)
            letters = t[0].isalpha()
            k = self.known[t] = len(self.rows)
            self.rows.append((_hash("w" + word), _hash("s" + _shape(t)), _hash("3" + (low[-3:] if letters else "")), _hash("4" + (low[-4:] if letters else "")), _hash("p" + (low[:3] if letters else ""))))
        return k

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """numbers (N, T), 0 = padding -> feature places (N, T, COUNT)."""
        props = np.array(self.rows, np.uint64)
        pad = np.pad(numbers, ((0, 0), (3, 3)))
        t = numbers.shape[1]
        at = {(k, d): props[pad[:, 3 + d : 3 + d + t], k] for k, d in {*self.SINGLE, *(x for j in self.JOINT for x in j)}}
        out = np.empty((*numbers.shape, self.COUNT), np.int32)
        with np.errstate(over="ignore"):
            for n, key in enumerate(self.SINGLE):
                out[..., n] = (((at[key] + np.uint64(n + 1)) * _M) >> np.uint64(46)).astype(np.int32)
            for n, keys in enumerate(self.JOINT, len(self.SINGLE)):
                h = np.uint64(n + 1)
                for key in keys:
                    h = (h ^ at[key]) * _M
                out[..., n] = (h >> np.uint64(46)).astype(np.int32)
        return out


# ---- the field ---------------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _forbidden() -> np.ndarray:
    """Log potential of impossible steps: an inside must follow its own begin or inside."""
    a = np.zeros((L, L), np.float32)
    for x in range(L):
        for y in range(1, L):
            if LABELS[y][0] == "I" and LABELS[x][2:] != LABELS[y][2:]:
                a[x, y] = -30
    return a


START = np.array([-30.0 if x[0] == "I" else 0.0 for x in LABELS], np.float32)


def marginals(u: np.ndarray, step: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (N, T, L) of chains of the given sizes by forward-backward messages; also the forward messages and the weighted backward ones."""
    n, t, _ = u.shape
    e, a = np.exp(u - u.max(2, keepdims=True)), np.exp(step)
    f, b, eb = np.empty_like(u), np.ones_like(u), np.empty_like(u)
    x = e[:, 0] * np.exp(START)
    f[:, 0] = x / x.sum(1, keepdims=True)
    for k in range(1, t):
        x = (f[:, k - 1] @ a) * e[:, k] + 1e-30
        f[:, k] = x / x.sum(1, keepdims=True)
    eb[:, t - 1] = e[:, t - 1]
    for k in range(t - 2, -1, -1):
        x = eb[:, k + 1] @ a.T
        b[:, k] = np.where((k + 1 < size)[:, None], x / x.sum(1, keepdims=True), 1)
        eb[:, k] = e[:, k] * b[:, k]
    m = f * b + 1e-30
    return m / m.sum(2, keepdims=True), f, eb


def viterbi(u: np.ndarray, step: np.ndarray, size: np.ndarray) -> np.ndarray:
    n, t, _ = u.shape
    score, back = u[:, 0] + START, np.zeros((n, t, L), np.int8)
    ends = np.zeros((n, L), np.float32)
    ends[size == 1] = score[size == 1]
    for k in range(1, t):
        x = score[:, :, None] + step
        back[:, k] = x.argmax(1)
        score = x.max(1) + u[:, k]
        ends[size == k + 1] = score[size == k + 1]
    path = np.zeros((n, t), np.int8)
    at = ends.argmax(1)
    for k in range(t - 1, -1, -1):
        live = k < size
        path[live, k] = at[live]
        into = np.take_along_axis(back[:, k], at[:, None].astype(np.int64), 1)[:, 0]
        at = np.where(live & (k > 0), into, at)
    return path


class Field:
    """Weights of the tokens' features, of steps along the chain, and of skips between repeated tokens."""

    def __init__(self) -> None:
        self.w = np.zeros((SPACE, L), np.float32)
        self.step = _forbidden()
        self.skip = np.zeros((2, L, L), np.float32)  # by kind of link

    def unary(self, places: np.ndarray) -> np.ndarray:
        u = np.zeros((*places.shape[:2], L), np.float32)
        for k in range(places.shape[2]):
            u += self.w[places[..., k]]
        return u

    def fit(self, places: np.ndarray, gold: np.ndarray, size: np.ndarray, links: np.ndarray, doc: np.ndarray, epochs: int = 5, joint: int = 2, batch: int = 256, rate: float = 0.25) -> Field:
        """AdaGrad steps on the likelihood: of the chains alone first, then of whole documents with their links, whose beliefs come from loopy messages."""
        rng = np.random.default_rng(5)
        g2, s2, k2 = np.full((SPACE, L), 1e-2, np.float32), np.full((L, L), 1e-2, np.float32), np.full((2, L, L), 1e-2, np.float32)
        forbidden = self.step < -1
        width = gold.shape[1]
        by_doc = np.argsort(doc, kind="stable")
        ends = np.nonzero(np.diff(doc[by_doc], append=-1))[0] + 1
        for epoch in range(epochs + joint):
            chains = epoch < epochs
            if chains:
                order = np.argsort(size + rng.random(len(size)) * 4)
                parts = [order[k : k + batch] for k in range(0, len(order), batch)]
            else:  # whole documents together
                cuts = [0]
                for e in ends:
                    if e - cuts[-1] >= batch or e == len(by_doc):
                        cuts.append(int(e))
                parts = [by_doc[x:y] for x, y in zip(cuts, cuts[1:])]
            for k in rng.permutation(len(parts)):
                ids = parts[k]
                t = int(size[ids].max())
                p, y, n = places[ids, :t], gold[ids, :t], size[ids]
                u = self.unary(p)
                live = np.arange(t)[None, :] < n[:, None]
                if not chains:
                    place = np.full(len(size), -1)
                    place[ids] = np.arange(len(ids))
                    mine = links[place[links[:, 0] // width] >= 0]
                    if len(mine):
                        mine = np.stack([place[mine[:, 0] // width] * t + mine[:, 0] % width, place[mine[:, 1] // width] * t + mine[:, 1] % width, mine[:, 2]], 1)
                        u, free_a, free_b = self.messages(u, n, mine)
                        both = free_a[:, :, None] + free_b[:, None, :] + self.skip[mine[:, 2]]
                        both = np.exp(both - both.max((1, 2), keepdims=True))
                        both /= both.sum((1, 2), keepdims=True)
                        kgrad, flat_y = np.zeros((2, L, L), np.float32), y.reshape(-1)
                        np.add.at(kgrad, (mine[:, 2], flat_y[mine[:, 0]], flat_y[mine[:, 1]]), 1)
                        np.add.at(kgrad, mine[:, 2], -both)
                        kgrad = (kgrad + kgrad.transpose(0, 2, 1)) / 2 - 0.5 * self.skip
                        k2 += kgrad**2
                        self.skip += 0.1 * kgrad / np.sqrt(k2)
                m, f, eb = marginals(u, self.step, n)
                grad = -m
                np.put_along_axis(grad, y[..., None].astype(np.int64), np.take_along_axis(grad, y[..., None].astype(np.int64), 2) + 1, 2)
                grad *= live[..., None]
                sgrad = np.zeros((L, L), np.float32)
                if t > 1:
                    steps, a = live[:, 1:], np.exp(self.step)
                    prev, into = f[:, :-1][steps], eb[:, 1:][steps]
                    z = ((prev @ a) * into).sum(1, keepdims=True) + 1e-30
                    sgrad -= ((prev / z).T @ into) * a
                    np.add.at(sgrad, (y[:, :-1][steps], y[:, 1:][steps]), 1)
                flat, gl = p[live], grad[live]
                where, inverse = np.unique(flat, return_inverse=True)
                inverse = inverse.reshape(flat.shape)
                total = np.stack([np.bincount(inverse.ravel(), weights=np.repeat(gl[:, c], flat.shape[1]), minlength=len(where)) for c in range(L)], 1).astype(np.float32)
                total -= 0.002 * self.w[where] * len(ids)
                g2[where] += total**2
                self.w[where] += rate * total / np.sqrt(g2[where])
                s2 += sgrad**2
                self.step = np.where(forbidden, self.step, self.step + rate * sgrad / np.sqrt(s2)).astype(np.float32)
        return self

    def messages(self, u: np.ndarray, size: np.ndarray, links: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loopy messages over links (flat place, flat place, kind): unaries with the messages added, and each link's beliefs of its two ends without its own message."""
        t = u.shape[1]
        a, b, skip = links[:, 0], links[:, 1], self.skip[links[:, 2]]
        to_b, to_a = np.zeros((len(links), L), np.float32), np.zeros((len(links), L), np.float32)
        now = u
        for left in range(rounds, -1, -1):
            flat = np.log(marginals(now, self.step, size)[0]).reshape(-1, L)
            free_a, free_b = flat[a] - to_a, flat[b] - to_b
            if not left:
                break
            new_b = _lse(free_a[:, :, None] + skip, 1)
            new_a = _lse(free_b[:, :, None] + skip, 1)
            to_b = 0.5 * to_b + 0.5 * (new_b - _lse(new_b, 1)[:, None])
            to_a = 0.5 * to_a + 0.5 * (new_a - _lse(new_a, 1)[:, None])
            add = np.zeros((len(u) * t, L), np.float32)
            np.add.at(add, b, to_b)
            np.add.at(add, a, to_a)
            now = u + add.reshape(u.shape)
        return now, free_a, free_b

    def pull(self) -> float:
        """The most that the message of one link can change one label against another."""
        return float((self.skip.max(1) - self.skip.min(1)).max()) if self.skip.any() else 0.0

    def decode(self, u: np.ndarray, size: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Labels; links (K, 3).  Chains with links pass messages before they are decoded."""
        if len(links):
            t = u.shape[1]
            rows = np.unique(links[:, :2] // t)
            number = np.full(len(u), -1)
            number[rows] = np.arange(len(rows))
            own = np.stack([number[links[:, 0] // t] * t + links[:, 0] % t, number[links[:, 1] // t] * t + links[:, 1] % t, links[:, 2]], 1)
            u = u.copy()
            u[rows] = self.messages(u[rows], size[rows], own)[0]
        return viterbi(u, self.step, size)


#: Kinds of links: the same word, or another with the same first STEM letters.
SAME, SIMILAR, STEM = 0, 1, 5


def _links(texts: list[str], docs: list[int], wins: list[list[tuple[int, int]]], width: int) -> np.ndarray:
    """Each capitalised word of a document (two letters or more, never in lower case beside it) is linked with its last occurrence, and with the last word like it: as many links as tokens, not pairs."""
    last: dict[tuple[str, int], tuple[int, str]] = {}
    out: list[tuple[int, int, int]] = []
    low: set[str] = set()
    owner = -1
    for n, (d, spans) in enumerate(zip(docs, wins)):
        text = texts[d]
        if d != owner:
            owner, last, low, k = d, {}, set(), n
            while k < len(docs) and docs[k] == d:
                low.update(t for a, b in wins[k] if (t := text[a:b]).islower())
                k += 1
        for k, (a, b) in enumerate(spans):
            if b - a > 1 and text[a].isupper():
                word = text[a:b].lower()
                if word in low:
                    continue
                at = n * width + k
                for kind, key in ((SAME, word), (SIMILAR, word[:STEM])):
                    if kind == SIMILAR and len(word) <= STEM:
                        continue
                    before = last.get((key, kind))
                    if before and (kind == SAME or before[1] != word):
                        out.append((before[0], at, kind))
                    last[key, kind] = (at, word)
    return np.array(out, np.int64).reshape(-1, 3)


_EMAIL_CHECK = re.compile(r"[\w.+\-]+\s*(?:@|[(\[{]\s*at\s*[)\]}])\s*[\w\-]+\s*(?:\.|[(\[{]\s*dot\s*[)\]}])", re.I)


def checked(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """An exact look at a labelled span: trims marks that belong to the sentence, drops what cannot be of its type."""
    while a < b and (text[a].isspace() or text[a] in ",;:.<[\"“‘'"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:>\"”’'."):
        b -= 1
    s = text[a:b]
    while s and s[-1] in ")]" and s.count("(") + s.count("[") < s.count(")") + s.count("]"):
        b -= 1
        s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return (a, b) if _EMAIL_CHECK.match(s) else None
    if kind == "phone":
        return (a, b) if digits >= 7 else None
    if kind == "id_number":
        return (a, b) if digits >= 6 else None
    if kind == "address":
        return (a, b) if digits >= 1 and sum(c.isupper() for c in s) >= 2 and re.search(r"[,\n]", s) else None
    return (a, b) if len(re.findall(r"[^\W\d_]+", s)) >= 2 and re.search(r"[^\W\d_]{3}", s) else None


def label_texts(texts: list[str], field: Field, features: Features, chunk: int = 4096) -> list[tuple[int, str, int, int]]:
    """(number of the text, type, start, end)."""
    docs, wins = [], []
    for d, text in enumerate(texts):
        for spans in windows(text):
            docs.append(d)
            wins.append(spans)
    if not wins:
        return []
    # windows of like length together, those of a document in one part where links are
    sizes = np.array([len(w) for w in wins])
    flat = np.fromiter((features.number(texts[d][a:b]) for d, w in zip(docs, wins) for a, b in w), np.int32, int(sizes.sum()))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # What steps and links together can do for another label than O at one token: the steps into and out of a stretch of others, and each link of the token.
    links = _links(texts, docs, wins, 1 << 24)
    pulls = np.zeros(len(flat))
    for side in (0, 1):
        np.add.at(pulls, begin[links[:, side] >> 24] + (links[:, side] & 0xFFFFFF), field.pull())
    safe = 2 * float(field.step.max() - field.step[0, 0]) + 1e-3

    order = np.argsort(sizes, kind="stable")
    parts = [order[k : k + chunk] for k in range(0, len(order), chunk)]
    maybe = np.zeros(len(wins), bool)
    kept: dict[int, np.ndarray] = {}
    for ids in parts:
        t = int(sizes[ids].max())
        live = np.arange(t)[None, :] < sizes[ids][:, None]
        at = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in ids])
        numbers, pull = np.zeros((len(ids), t), np.int32), np.zeros((len(ids), t))
        numbers[live], pull[live] = flat[at], pulls[at]
        u = field.unary(features.of(numbers))
        maybe[ids] = ((u[..., 1:].max(2) - u[..., 0] > -safe - pull) & live).any(1)
        linked = pull.any(1)
        for row in np.nonzero(maybe[ids] | linked)[0]:
            kept[int(ids[row])] = u[row, : sizes[ids[row]]].copy()
    # A chain in which O wins at every token whatever steps and links say is O throughout; it is still heard by chains it is linked with, ROUNDS links far.
    heard = maybe.copy()
    for _ in range(ROUNDS):
        for x, y in ((0, 1), (1, 0)):
            heard[links[heard[links[:, x] >> 24], y] >> 24] = True
    open_ = np.nonzero(heard)[0].tolist()
    if not open_:
        return []
    number = np.full(len(wins), -1)
    number[open_] = np.arange(len(open_))
    mine = links[(number[links[:, :2] >> 24] >= 0).all(1)]
    linked = np.stack([(number[mine[:, 0] >> 24] << 24) | (mine[:, 0] & 0xFFFFFF), (number[mine[:, 1] >> 24] << 24) | (mine[:, 1] & 0xFFFFFF), mine[:, 2]], 1)
    has = np.zeros(len(open_), bool)
    has[np.unique(linked[:, :2] >> 24)] = True
    out: list[tuple[int, str, int, int]] = []
    lengths = np.array([sizes[k] for k in open_])
    plain = np.nonzero(~has)[0]
    plain = plain[np.argsort(lengths[plain], kind="stable")]
    parts = [plain[k : k + chunk] for k in range(0, len(plain), chunk)]
    # linked windows: whole documents at a time, those with windows of like length together
    tied = np.nonzero(has)[0]
    owners = np.array([docs[open_[k]] for k in tied], np.int64)
    widest = np.zeros(len(texts), np.int64)
    np.maximum.at(widest, owners, lengths[tied])
    tied = tied[np.lexsort((owners, widest[owners]))]
    owners = np.array([docs[open_[k]] for k in tied], np.int64)
    ends = np.append(np.nonzero(np.diff(owners))[0] + 1, len(tied)) if len(tied) else []
    at = 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or (ends[k + 1] - at) * widest[owners[ends[k + 1] - 1]] > CELLS:
            parts.append(tied[at:end])
            at = end
    for ids in parts:
        t = int(lengths[ids].max())
        u = np.zeros((len(ids), t, L), np.float32)
        for row, k in enumerate(ids):
            u[row, : lengths[k]] = kept[open_[k]]
        skips = np.zeros((0, 3), np.int64)
        if has[ids[0]]:
            place = np.full(len(open_), -1)
            place[ids] = np.arange(len(ids))
            here = linked[(place[linked[:, :2] >> 24] >= 0).all(1)]
            skips = np.concatenate([place[here[:, :2] >> 24] * t + (here[:, :2] & 0xFFFFFF), here[:, 2:]], 1)
        path = field.decode(u, lengths[ids], skips)
        for k, row in zip(ids, path):
            labels = row[: lengths[k]]
            if not labels.any():
                continue
            w, text, j = wins[open_[k]], texts[docs[open_[k]]], 0
            while j < len(labels):
                if labels[j]:
                    kind, e = (labels[j] - 1) // 2, j + 1
                    while e < len(labels) and labels[e] == 2 + 2 * kind:
                        e += 1
                    ok = checked(TYPES[kind], text, w[j][0], w[e - 1][1])
                    if ok:
                        out.append((docs[open_[k]], TYPES[kind], *ok))
                    j = e
                else:
                    j += 1
    return out


def fit_field(texts: list[str], most: int = SAMPLE) -> Field:
    """The field fitted on texts: cues of names are learned from all of them, weights from at most `most`, a quarter of them without anything personal."""
    features, cues = Features(), NameCues(texts)
    labelled = [(t, cues.labels(t)) for t in texts]
    some, none = [x for x in labelled if x[1]], [x for x in labelled if not x[1]]
    chosen = some[: most - min(len(none), most // 4)]
    chosen += none[: most - len(chosen)]
    docs, wins, gold = [], [], []
    for d, (text, found) in enumerate(chosen):
        for spans in windows(text):
            y = np.zeros(len(spans), np.int8)
            for kind, a, b in found:
                inside = [k for k, (x, e) in enumerate(spans) if x >= a and e <= b]
                if inside:
                    y[inside] = 2 + 2 * TYPES.index(kind)
                    y[inside[0]] -= 1
            docs.append(d)
            wins.append(spans)
            gold.append(y)
    if not wins:
        return Field()
    # very long windows are cut for fitting only
    cut = 80
    pieces = [(d, w[k : k + cut], y[k : k + cut]) for d, w, y in zip(docs, wins, gold) for k in range(0, len(w), cut)]
    size = np.array([len(w) for _, w, _ in pieces])
    numbers, labels = np.zeros((len(pieces), cut), np.int32), np.zeros((len(pieces), cut), np.int8)
    for n, (d, w, y) in enumerate(pieces):
        numbers[n, : len(w)] = [features.number(chosen[d][0][a:b]) for a, b in w]
        labels[n, : len(w)] = y
    for n in range(len(labels)):  # a piece cannot begin inside an entity
        if labels[n, 0] and labels[n, 0] % 2 == 0:
            labels[n, 0] -= 1
    owners = [d for d, _, _ in pieces]
    links = _links([t for t, _ in chosen], owners, [w for _, w, _ in pieces], cut)
    return Field().fit(features.of(numbers), labels, size, links, np.array(owners))


def find_private(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, pii_type, s_start, s_end): each occurrence once, places in code points, end exclusive.

    Null and empty texts hold nothing.  Every document is labelled whole; only fitting is bounded,
    to `sample` documents of at most SAMPLE_CHARS characters.  Keys of repeated rows give one row a place.
    """
    given = documents.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, text)
    short = given.filter(F.length(text) <= SAMPLE_CHARS)
    drawn = hash_sample(short, [key], 4 * sample, short.count())  # a bounded draw; all documents are labelled below
    rows = sorted((r[0], r[1]) for r in drawn.select(F.xxhash64(key), text).collect())
    texts = list(dict.fromkeys(t for _, t in rows))
    field = documents.sparkSession.sparkContext.broadcast(fit_field(texts, sample))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            if len(features.rows) > 500_000:
                features = Features()
            found = label_texts(pdf[text].tolist(), field.value, features)
            keys = pdf[key].to_numpy()
            yield pd.DataFrame({key: keys[[f[0] for f in found]], "pii_type": [f[1] for f in found], "s_start": [f[2] for f in found], "s_end": [f[3] for f in found]})

    kind = documents.schema[key].dataType.simpleString()
    return given.mapInPandas(look, f"`{key}` {kind}, pii_type string, s_start int, s_end int").distinct()


def redacted(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a typed placeholder for each place; texts without any stay as they are, nulls null."""
    spots = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("s_start", "s_end", "pii_type"))).alias("spots"))
    joined = documents.select(key, text).join(spots, key, "left")
    # pieces of text between the places, with the placeholders put in
    pieces = F.expr(
        f"aggregate(spots, struct(cast('' as string) as done, 0 as at), (acc, x) -> struct(concat(acc.done, substring(`{text}`, acc.at + 1, x.s_start - acc.at), '[', upper(x.pii_type), ']') as done, x.s_end as at), "
        f"acc -> concat(acc.done, substring(`{text}`, acc.at + 1)))"
    )
    return joined.select(key, F.when(F.col("spots").isNull(), F.col(text)).otherwise(pieces).alias(text))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return redacted(documents, find_private(documents))
