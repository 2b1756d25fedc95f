"""Held-out passages inside a training corpus.

The documents of a task are taken in shards of bounded size.  A shard's words become one array with
a suffix array over it (by prefix doubling), in which every suffix of every test item is looked up
by binary search, word by word, which yields its longest verbatim matches and their places.  Those
are then followed over single changed, missing or added words, until a passage is long enough or
too different.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.canonical import canonical
from textloom.sources.tables import table

#: A passage is at least so many words of the item, with at most one edit in so many words.
LEAST_WORDS, WORDS_AN_EDIT = 15, 6
#: With those two numbers a passage keeps a verbatim run of LONG_RUN words, or two of SEED words or more with at most GAP words
#: between them on either side: e edits leave 5 e words or more in at most e + 1 runs; if none is over 5 words,
#: at most two of them are under SEED (3 words at most), and of SEED or more there are at least two.
SEED, LONG_RUN, GAP, SHIFT = 4, 6, 9, 3
#: Items looked up at a time: their vocabulary must fit the sort key.
KEY_BITS = 62
#: Characters of documents in one shard, and of items that travel to the tasks at a time; verbatim matches looked at together.
SHARD_CHARS, ITEM_CHARS, MATCHES = 6_000_000, 32_000_000, 2_000_000
_HAN = "㐀-䶿一-鿿豈-﫿𠀀-𯨟⺀-⿕"
_HIDDEN = "­​-‏⁠﻿"
# Marks and characters that are not seen belong to the word they stand in.
_WORD = re.compile(rf"[{_HAN}]|(?:[^\W_{_HAN}][̀-ֽ֑ͯ-ׇऀ-ःऺ-ॏ{_HIDDEN}]*)+")


def _norm(word: str) -> str:
    return (word if word.isascii() else canonical(word)).casefold()


def words(text: str | None) -> list[str]:
    """Words as compared: a Han character or a run of letters and digits, without case, in canonical characters."""
    return [_norm(w) for w in _WORD.findall(text)] if text else []


class Numbers(dict):
    """Raw word -> its number in a vocabulary of canonical words, 0 if it has none; each spelling is looked at once."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        number = self[word] = self.vocab.get(_norm(word), 0)
        return number


def item_blocks(items: list[tuple[int, list[str]]], bits: int = KEY_BITS // SEED) -> list[tuple[dict[str, int], np.ndarray, np.ndarray]]:
    """Items in blocks of at most 2**bits - 1 different words: (vocabulary, words of all items each led and followed by 0, number of the item at each place)."""
    blocks, vocab, flat, owner = [], {}, [0], [-1]
    for number, ws in items:
        if len(ws) < LEAST_WORDS:
            continue
        if len(vocab) + len(set(ws) - vocab.keys()) >= 1 << bits and len(flat) > 1:
            blocks.append((vocab, np.array(flat, np.int64), np.array(owner)))
            vocab, flat, owner = {}, [0], [-1]
        for w in ws:
            flat.append(vocab.setdefault(w, len(vocab) + 1))
            owner.append(number)
        flat.append(0)
        owner.append(-1)
    if len(flat) > 1:
        blocks.append((vocab, np.array(flat, np.int64), np.array(owner)))
    return blocks


def _keys(w: np.ndarray, bits: int) -> np.ndarray:
    """For each place the next SEED words as one number; 0 stands for all words from the first unknown one on."""
    key, known = np.zeros(len(w), np.int64), np.ones(len(w), bool)
    for k in range(SEED):
        part = np.zeros(len(w), np.int64)
        part[: len(w) - k] = w[k:]
        known &= part > 0
        key = (key << bits) | np.where(known, part, 0)
    return key


def _whole(key: np.ndarray, bits: int) -> np.ndarray:
    """Places where SEED known words stand."""
    return np.nonzero(key & ((1 << bits) - 1))[0]


class Suffixes:
    """The suffix array of a shard over the places that can be part of a match.

    `words` holds 0 where no item can match; a suffix ends there.  Order is by prefix doubling from
    SEED words on, up to `longest` words, the most that any item suffix can ask for.
    """

    def __init__(self, words: np.ndarray, bits: int, longest: int):
        self.words = words
        places = np.nonzero(words)[0]
        n = len(places)
        ends = np.nonzero(np.append(np.diff(places) > 1, True))[0] if n else places
        left = places[ends][np.searchsorted(ends, np.arange(n))] - places + 1 if n else places  # words up to the end of the suffix
        keys = _keys(words, bits)[places]
        number = np.full(len(words) + 1, -1)
        number[places] = np.arange(n)
        _, rank = np.unique(keys, return_inverse=True)
        depth = SEED
        while depth < longest and n and rank.max() + 1 < n:
            on = left > depth
            after = np.zeros(n, np.int64)
            after[on] = rank[number[places[on] + depth]] + 1
            _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            depth *= 2
        order = np.argsort(rank, kind="stable")
        self.places, self.left, self.first = places[order], left[order], keys[order]

    def _word(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The word `depth` words behind the begin of the suffixes of these ranks, 0 behind their end."""
        inside = self.left[at] > depth
        return np.where(inside, self.words[np.where(inside, self.places[at] + depth, 0)], 0)

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each range of suffixes (which agree in their first `depth` words) the part that has `word` next, by binary search."""
        bounds = []
        for add in (0, 1):
            a, b = lo.copy(), hi.copy()
            while len(on := np.nonzero(a < b)[0]):
                m = (a[on] + b[on]) // 2
                less = self._word(m, depth) < word[on] + add
                a[on[less]], b[on[~less]] = m[less] + 1, m[~less]
            bounds.append(a)
        return bounds[0], bounds[1]

    def look_up(self, item: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the item suffixes from `at` on: ranges of suffixes that share SEED words and LONG_RUN words with them, the most words shared, and the first such place."""
        lo, hi = np.searchsorted(self.first, keys, "left"), np.searchsorted(self.first, keys, "right")
        longest, place = np.where(hi > lo, SEED, 0), np.full(len(at), -1)
        lo6, hi6 = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        place[hi > lo] = self.places[lo[hi > lo]]
        on, a, b, depth = np.nonzero(hi > lo)[0], lo[hi > lo], hi[hi > lo], SEED
        while len(on):
            word = np.where(at[on] + depth < len(item), item[np.minimum(at[on] + depth, len(item) - 1)], 0)
            a, b = self.narrowed(a, b, np.where(word > 0, word, -2), depth)
            depth += 1
            keep = b > a
            on, a, b = on[keep], a[keep], b[keep]
            longest[on], place[on] = depth, self.places[a]
            if depth == LONG_RUN:
                lo6[on], hi6[on] = a, b
        return lo, hi, lo6, hi6, longest, place


def _laid_out(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges one behind another: (number of the range, place in it)."""
    many = hi - lo
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) + np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)


def _extended(doc: np.ndarray, item: np.ndarray, p: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of SEED words that cannot begin a word earlier, with their full length."""
    begins = (p == 0) | (item[np.maximum(i - 1, 0)] == 0)
    begins[~begins] = doc[p[~begins] - 1] != item[i[~begins] - 1]
    p, i = p[begins], i[begins]
    length, active = np.full(len(p), SEED), np.arange(len(p))
    while len(active):
        a, b = p[active] + length[active], i[active] + length[active]
        ok = (a < len(doc)) & (b < len(item))
        ok[ok] = (doc[a[ok]] == item[b[ok]]) & (item[b[ok]] > 0)
        active = active[ok]
        length[active] += 1
    return p, i, length


def _paired(pair: np.ndarray, p: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Which matches of up to LONG_RUN - 1 words have a later one of the same document and item near enough to be of one passage."""
    order = np.lexsort((i, p, pair))
    pair, p, i = pair[order], p[order], i[order]
    reach, has = LONG_RUN - 1 + GAP, np.zeros(len(p), bool)
    for k in range(1, len(p)):
        near = (pair[k:] == pair[:-k]) & (p[k:] - p[:-k] <= reach)
        if not near.any():
            break
        step_p, step_i = p[k:] - p[:-k], i[k:] - i[:-k]
        has[:-k] |= near & (step_p >= SEED - 1) & (step_i >= SEED - 1) & (step_i <= reach) & (np.abs(step_p - step_i) <= SHIFT)
    out = np.zeros(len(p), bool)
    out[order] = has
    return out


def _follow(doc: list[int], item: list[int], p: int, i: int, step: int) -> list[tuple[int, int]]:
    """From places p, i on in one direction: (item words covered, edits), the most words for every number of edits.

    The furthest place on each diagonal for one more edit comes from its neighbours' places for one
    less, followed over the verbatim run behind it.
    """
    room = 0
    while 0 <= i + step * room < len(item) and item[i + step * room]:
        room += 1
    if not room:
        return [(0, 0)]
    size = 0
    while size <= room + room // WORDS_AN_EDIT and 0 <= p + step * size < len(doc) and doc[p + step * size] >= 0:
        size += 1

    def run(a: int, b: int) -> int:
        while a < size and b < room and doc[p + step * a] == item[i + step * b]:
            a, b = a + 1, b + 1
        return b

    reach, level = [], {0: run(0, 0)}  # diagonal (place in doc less place in item) -> item words covered
    for edits in range(room // WORDS_AN_EDIT + 2):
        most = max(level.values())
        reach.append((most, edits))
        if most == room:
            break
        after: dict[int, int] = {}
        for d, b in level.items():
            for e, c in ((d, b + 1), (d + 1, b), (d - 1, b + 1)):  # changed, put in, left out
                if c <= room and 0 <= c + e <= size and c > after.get(e, -1):
                    after[e] = c
        level = {d: run(b + d, b) for d, b in after.items()}
        if not level:
            break
    return reach


def repeats(doc: list[int], item: list[int], p: int, i: int, length: int) -> bool:
    """Whether the match can be continued to a passage of the item that counts as repeated."""
    if length >= LEAST_WORDS:
        return True
    after = _follow(doc, item, p + length, i + length, 1)
    before = _follow(doc, item, p - 1, i - 1, -1)
    return any(length + a + b >= LEAST_WORDS and WORDS_AN_EDIT * (e + f) <= length + a + b for a, e in after for b, f in before)


def _shard(raw: list[list[str]], blocks) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row of the shard, item) with a repeated passage -> its longest verbatim match (words, place in the row, place in the item); raw: the rows' words as written."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    per = np.array([len(t) + 1 for t in raw], np.int64)
    owner, begin = np.repeat(np.arange(len(raw)), per), np.concatenate([[0], np.cumsum(per)])
    for vocab, item, item_of, number in blocks:
        bits = max(1, int(len(vocab)).bit_length())
        # 0: a word that is in no item; -1 ends a document
        doc = np.zeros(int(per.sum()), np.int64)
        inside = np.ones(len(doc), bool)
        inside[begin[1:] - 1] = False
        doc[inside] = np.array([x for t in raw for x in map(number.__getitem__, t)], np.int64)
        doc[~inside] = -1
        asked = _keys(item, bits)
        at = _whole(asked, bits)
        keys = _keys(np.maximum(doc, 0), bits)
        some = _whole(keys, bits)
        known = np.unique(asked[at])
        some = some[known[np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)] == keys[some]] if len(known) else some[:0]
        if not len(some):
            continue
        part = np.zeros(len(doc), bool)
        for k in range(SEED):
            part[some + k] = True
        suffixes = Suffixes(np.where(part, doc, 0), bits, int(np.diff(np.nonzero(item == 0)[0]).max()))
        lo, hi, lo6, hi6, _, _ = suffixes.look_up(item, at, asked[at])
        # Short matches count only where another one begins near by, in the document and in the item.
        lone_doc, lone_item = _lone(some, len(doc)), _lone(at[hi > lo], len(item))
        crowd = np.concatenate([[0], np.cumsum(~lone_doc[suffixes.places])])  # of suffixes in front of a rank: those not alone
        ranks = np.nonzero(~lone_doc[suffixes.places])[0]
        lo, hi = (np.where(lone_item[at], 0, crowd[x]) for x in (lo, hi))
        owner_runs = np.nonzero(np.diff(item_of[at], prepend=-2))[0]
        cost = np.add.reduceat((hi - lo) + (hi6 - lo6), owner_runs)
        docs, items = None, None
        group = 0
        while group < len(owner_runs):
            end, total = group, 0
            while end < len(owner_runs) and (end == group or total + cost[end] <= MATCHES):
                total += cost[end]
                end += 1
            rows = slice(owner_runs[group], owner_runs[end] if end < len(owner_runs) else len(at))
            group = end
            of, rank = _laid_out(lo6[rows], hi6[rows])
            of2, rank2 = _laid_out(lo[rows], hi[rows])
            p = np.concatenate([suffixes.places[rank], suffixes.places[ranks[rank2]]])
            i = at[rows][np.concatenate([of, of2])]
            if not len(p):
                continue
            code = np.unique(p * len(item) + i)
            p, i, length = _extended(doc, item, code // len(item), code % len(item))
            pair = owner[p] * (item_of.max() + 1) + item_of[i]
            keep = length >= LONG_RUN
            short = np.nonzero(~keep)[0]
            keep[short[_paired(pair[short], p[short], i[short])]] = True
            if not keep.any():
                continue
            if docs is None:
                docs, items = doc.tolist(), item.tolist()
            chosen = np.nonzero(keep)[0]
            for k in chosen[np.lexsort((p[chosen], -length[chosen]))]:
                where = (int(owner[p[k]]), int(item_of[i[k]]))
                if where not in found and repeats(docs, items, int(p[k]), int(i[k]), int(length[k])):
                    best = np.nonzero(pair == pair[k])[0]
                    best = best[np.lexsort((i[best], p[best], -length[best]))[0]]
                    found[where] = (int(length[best]), int(p[best] - begin[owner[p[best]]]), int(i[best]))
    return found


def _lone(begins: np.ndarray, size: int) -> np.ndarray:
    """By place: whether no match begins SEED - 1 to LONG_RUN - 1 + GAP words in front of it or behind it."""
    count = np.zeros(size + 1, np.int64)
    flags = np.zeros(size, np.int64)
    flags[begins] = 1
    count[1:] = np.cumsum(flags)
    at, far = np.arange(size), LONG_RUN - 1 + GAP
    before = count[np.maximum(at - SEED + 2, 0)] - count[np.maximum(at - far, 0)]
    behind = count[np.minimum(at + far + 1, size)] - count[np.minimum(at + SEED - 1, size)]
    return (before + behind) == 0


def _shards(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in their order, as many at a time as fit SHARD_CHARS, or one longer text: (number of the first, texts)."""
    begin, chars = 0, 0
    for k, t in enumerate(texts):
        if k > begin and chars + len(t) > SHARD_CHARS:
            yield begin, texts[begin:k]
            begin, chars = k, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, run_words, d_start, d_end): every document that repeats a passage of an item, with the longest verbatim match of the two and its place in the text (code points).

    A passage is at least LEAST_WORDS consecutive words of the item, in order, at most one word in
    WORDS_AN_EDIT changed, left out or put in.  Null and shorter texts repeat nothing; repeated
    document rows give one row a key.  The items are the stated query set: they travel to every
    task in blocks of ITEM_CHARS characters; documents are never shuffled.
    """
    wanted = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    total = wanted.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    given = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{item_key}` bigint, run_words int, d_start int, d_end int"
    groups, found = -(-int(total) // ITEM_CHARS), None
    for g in range(max(1, groups)):
        some = wanted if groups <= 1 else wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        rows = sorted((r["i"], words(r["t"])) for r in some.collect())
        blocks = documents.sparkSession.sparkContext.broadcast(item_blocks(rows))

        def look(batches: Iterator[pd.DataFrame], blocks=blocks) -> Iterator[pd.DataFrame]:
            known = [(*b, Numbers(b[0])) for b in blocks.value]
            for pdf in batches:
                keys, texts, out = pdf[key].to_numpy(), pdf[text].tolist(), []
                for first, part in _shards(texts):
                    for (d, item), (n, place, _) in sorted(_shard([_WORD.findall(t) for t in part], known).items()):
                        spans = [m.span() for m in _WORD.finditer(part[d])][place : place + n]
                        out.append((keys[first + d], item, n, spans[0][0], spans[-1][1]))
                yield pd.DataFrame(out, columns=[key, item_key, "run_words", "d_start", "d_end"])

        part = given.mapInPandas(look, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("run_words", "d_start", "d_end"), F.struct("run_words", -F.col("d_start"), -F.col("d_end"))).alias("best")
    return found.groupBy(key, item_key).agg(best).select(key, item_key, "best.*")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in its text each document repeats an item longest word for word."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that repeat no passage of any item."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(leaked(documents, table(spark, sf_dir, "eval_items")), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")
