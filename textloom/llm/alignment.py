"""Which sentence of an original is rendered by which sentence of a translation.

A word is represented by the paired documents (an original and the passages of its unit) it stands
in; the cosine of an original's word and a translation's word over these shared concepts says how
likely one renders the other.  Sentences are sums of their words (words of one side are taken as
orthogonal to each other); their cosines come from sparse joins within a unit.  A sentence and spans
of up to MERGE neighbouring ones on the other side compete, and those that are each other's best
are taken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.shared import written
from textloom.llm.canonical import canonical
from textloom.llm.sentences import split_many
from textloom.sources.tables import delivered_once, table

_HAN = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"\d+(?:\.\d+)?|[{_HAN}]|(?:[^\W\d_{_HAN}][̀-ֽ֑ͯ-ׇऀ-ःऺ-ॏ]*)+")
#: Number words of English and of classical Chinese.
NUMBERS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
NUMBERS |= {"thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100"}
_HAN_DIGIT = {c: k for k, c in enumerate("零一二三四五六七八九")}
_HAN_NUMBER = re.compile("[零一二三四五六七八九十百千]+")
#: Inflectional endings, by script of the word (longest first is tried first; at least two letters stay).
ENDINGS = {
    "GREEK": "ονται εται ουσι ους οις ος ον ων οι ου ας αν αι ης ην ις ει εις ω η α".split(),
    "LATIN": "enti anti onti unti inti nti ssa ena eti ati oti uti iti ti o ṃ m".split(),
    "DEVANAGARI": "ोन्ति ान्ति ून्ति ुन्ति ीन्ति ेन्ति न्ति स्य म् ः ति".split(),
}
ARTICLE = "ה"
#: Spans of up to this many neighbouring sentences may be one side of a pair.
MERGE = 3
#: A pair counts from this cosine on; a merged span must beat its best part by GAIN for each sentence it has more.
LEAST, GAIN = 0.22, 1.12
#: Weight of the difference of relative places in the text, against ties.
DRIFT = 0.25
#: Tables of at most so many rows are broadcast.
SMALL = 300_000
#: A word pair counts from this cosine on; its t-score weighs as much as so large a one.
LEAST_WORD, DOUBT = 0.1, 0.7
#: Units laid out at a time for the products of their words; word pairs counted at a time.
CHUNK, PAIRS = 256, 2_000_000
#: Places of a table in which the pairs of a batch are counted.
CELLS = 16_000_000


def _base(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not ("̀" <= c <= "ͯ" and c not in "̣̃̄") and not "֑" <= c <= "ׇ")


def _han_number(word: str) -> int | None:
    total, digit = 0, 0
    for c in word:
        if c in _HAN_DIGIT:
            digit = _HAN_DIGIT[c]
        else:
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
    return total + digit


def stem(word: str, translation: bool) -> str:
    """Crude but equal for the forms of one word; numbers come out as # and their value in either language."""
    if word[0].isdigit():
        return "#" + "".join(str(int(c)) if c.isdigit() else c for c in word)
    if translation:
        w = word.casefold()
        if w in NUMBERS:
            return "#" + NUMBERS[w]
        w = w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-2] if w.endswith(("ses", "xes", "ches", "shes", "zes")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
        return w.rstrip("e") or w
    if _HAN_NUMBER.fullmatch(word):
        return f"#{_han_number(word)}"
    w = _base(word)
    name = unicodedata.name(w[0], "?").split(" ")[0] if w else ""
    if name == "HEBREW":
        return w[1:] if w.startswith(ARTICLE) and len(w) > 3 else w
    if name == "LATIN":
        w = unicodedata.normalize("NFC", w)
    for e in ENDINGS.get(name, ()):
        e = e.casefold()  # the word is, too: a final sigma is like any other
        if w.endswith(e) and len(w) - len(e) >= 2:
            return w[: len(w) - len(e)]
    return w


_HIDDEN = "\u00ad\u200b-\u200f\u2060\ufeff"
_RAW = re.compile(rf"\d+(?:\.\d+)?|[零一二三四五六七八九十百千]+|[{_HAN}⺀-⿕]|(?:[^\W\d_{_HAN}][̀-ֽ֑ͯ-ׇऀ-ःऺ-ॏ{_HIDDEN}]*)+")
DOCUMENT = "uid bigint, side string, lang string, id string, starts array<int>, words array<array<bigint>>"


class Words(dict):
    """Raw word -> number of its stem in its language; each spelling is looked at once."""

    def __init__(self, lang: str, translation: bool):
        super().__init__()
        self.lang, self.translation = lang, translation

    def __missing__(self, raw: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        word = raw if raw.isascii() else canonical(raw)
        found = _WORD.findall(word) or [word]
        st = stem(found[0], self.translation) if len(found) == 1 or self.translation else stem("".join(found), False)
        number = self[raw] = xxhash.xxh64_intdigest(st if st[:1] == "#" else f"{'p' if self.translation else 'o' + self.lang} {st}") - (1 << 63)
        return number


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts cut into sentences, sentences into the numbers of their different words."""
    known: dict[str, Words] = {}
    for pdf in batches:
        starts, words = [], []
        for side, lang, body, spans in zip(pdf["side"], pdf["lang"], pdf["body"], split_many(pdf["body"].tolist())):
            key = "" if side == "p" else lang + " "
            if key not in known:
                known[key] = Words(lang, side == "p")
            of = known[key].__getitem__
            starts.append([a for a, _ in spans])
            words.append([list(dict.fromkeys(map(of, _RAW.findall(body, a, b)))) for a, b in spans])
        yield pdf[["uid", "side", "lang", "id"]].assign(starts=starts, words=words)


#: kind 0: co-occurrence of a (original) and b (translation); 1, 2: units with a word of the original, of the translation; 3: units.
COUNTS = "kind int, lang string, a bigint, b bigint, n bigint"


class Laid:
    """A batch of units as flat arrays: documents, their sentences and the words of those, one behind another."""

    def __init__(self, docs: pa.ListArray):
        side, ident, starts, words = docs.flatten().flatten()  # originals stand in front
        count = lambda x: x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.unit_of_doc = np.repeat(np.arange(len(docs)), count(docs))
        self.of_original = side.to_numpy(zero_copy_only=False) == "o"
        self.ids = ident
        self.doc = np.repeat(np.arange(len(words)), count(words))
        self.unit = self.unit_of_doc[self.doc]
        self.original = self.of_original[self.doc]
        self.starts = starts.flatten().to_numpy(zero_copy_only=False)
        sentences = words.flatten()
        self.words = sentences.flatten().to_numpy(zero_copy_only=False)
        self.sentence = np.repeat(np.arange(len(sentences)), count(sentences))


def _once(unit: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of each unit: the words, and unit and number of the word, by unit."""
    known, number = np.unique(words, return_inverse=True)
    pairs = np.unique(unit * max(1, len(known)) + number)
    return known, pairs // max(1, len(known)), pairs % max(1, len(known))


def _counts(kind: int, lang: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(a)
    columns = [pa.repeat(pa.scalar(kind, pa.int32()), size), pa.repeat(pa.scalar(lang, pa.string()), size), pa.array(a), pa.array(b), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "lang", "a", "b", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over some units at a time, summed before anything is shuffled; never more than about PAIRS word pairs are laid out."""
    for batch in batches:
        laid, langs = Laid(batch.column("docs")), batch.column("lang").to_numpy(zero_copy_only=False)
        unit, original = laid.unit[laid.sentence], laid.original[laid.sentence]
        for lang in sorted(set(langs)):
            own = np.flatnonzero(langs == lang)
            here = langs[unit] == lang
            (vo, uo, o), (vp, up, p) = (_once(unit[some], laid.words[some]) for some in (here & original, here & ~original))
            for kind, v, w in ((1, vo, o), (2, vp, p)):
                yield _counts(kind, lang, v, np.zeros(len(v), np.int64), np.bincount(w, minlength=len(v)))
            yield _counts(3, lang, *(np.array([x]) for x in (0, 0, len(own))))
            # words of the translation by unit; those of the original are taken some at a time
            first = np.searchsorted(up, uo, "left")
            many = np.searchsorted(up, uo, "right") - first
            yield from (_counts(0, lang, vo[c // len(vp)], vp[c % len(vp)], n) for c, n in _pair_counts(o, first, many, p, len(vo), len(vp)))


def _pair_counts(o: np.ndarray, first: np.ndarray, many: np.ndarray, p: np.ndarray, n_o: int, n_p: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, count): in how many units word o meets word p, as o * n_p + p; o meets the words p[first : first + many].

    Where a table of all codes has at most CELLS places, counts are summed over the whole batch in it.
    """
    table = np.zeros(n_o * n_p, np.int32) if n_o * n_p <= CELLS else None
    ends, at = np.cumsum(many), 0
    while at < len(o):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        of, place = _spread(first[at:stop], many[at:stop])
        codes = o[at:stop][of] * n_p + p[place]
        if table is None:
            yield np.unique(codes, return_counts=True)
        else:
            np.add.at(table, codes, 1)
        at = stop
    if table is not None:
        codes = np.flatnonzero(table)
        yield codes, table[codes]


def _if_small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has at most SMALL rows; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= SMALL else df


#: A sentence of an original and one of a translation that renders it.
PAIR = "original_id bigint, o_start int, passage_id string, p_start int, score double"


class Gram:
    """Word cosines of all languages, found by the word of the original, and the squared weights of all words (lang, w, w2) of either side."""

    def __init__(self, rows: pd.DataFrame, of_originals: pd.DataFrame, of_translations: pd.DataFrame):
        self.langs = {x: k for k, x in enumerate(sorted(set(of_originals["lang"]) | set(of_translations["lang"])))}
        self.w2 = []
        for words in (of_originals, of_translations):
            codes = self.codes(words["lang"].map(self.langs).to_numpy(np.int64), words["w"].to_numpy())
            order = np.argsort(codes)
            self.w2.append((codes[order], words["w2"].to_numpy(np.float64)[order]))
        lang = rows["lang"].map(self.langs).to_numpy(np.int64)
        ow, pw, g = self.codes(lang, rows["ow"].to_numpy()), self.codes(lang, rows["pw"].to_numpy()), rows["g"].to_numpy(np.float64)
        self.pw, partner = np.unique(pw, return_inverse=True)
        order = np.argsort(ow, kind="stable")
        self.ow, self.first, self.many = np.unique(ow[order], return_index=True, return_counts=True)
        self.partner, self.g = partner[order], g[order]

    @staticmethod
    def codes(lang: np.ndarray | int, words: np.ndarray) -> np.ndarray:
        """A word in its language: the 64 bits of its hash, shuffled by the number of the language."""
        with np.errstate(over="ignore"):
            return words.astype(np.int64) * np.int64(6364136223846793005) + np.asarray(lang, np.int64)


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted key its place in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of `many` places from `first` on laid out one behind another: (number of the range, place)."""
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many)


def _sums(laid: Laid, langs: np.ndarray, gram: Gram, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the units from low to high: norms of their sentences, and the dot products (sentence of the original, of the translation, v) over all word pairs that meet in a unit."""
    s0, s1 = np.searchsorted(laid.unit, [low, high])
    w0, w1 = np.searchsorted(laid.sentence, [s0, s1])
    sentence = laid.sentence[w0:w1]
    unit = laid.unit[sentence]
    codes, original = Gram.codes(langs[unit], laid.words[w0:w1]), laid.original[sentence]
    norms = np.zeros(s1 - s0)
    for (known, w2), side in zip(gram.w2, (original, ~original)):
        at, there = _places(known, codes[side])
        norms += np.bincount(sentence[side] - s0, np.where(there, w2[at], 0.0), s1 - s0)
    if not len(gram.ow):
        return norms, *(np.zeros(0, np.int64),) * 2, np.zeros(0)
    at, there = _places(gram.ow, codes[original])
    at, so, uo = at[there], sentence[original][there], unit[original][there]
    pat, there = _places(gram.pw, codes[~original])
    sp = sentence[~original][there]
    # words of the translation by unit and number; every partner of a word of the original is looked up there
    code = unit[~original][there] * len(gram.pw) + pat[there]
    order = np.argsort(code, kind="stable")
    code, sp = code[order], sp[order]
    token, place = _spread(gram.first[at], gram.many[at])
    wanted = uo[token] * len(gram.pw) + gram.partner[place]
    lo = np.searchsorted(code, wanted, "left")
    pair, other = _spread(lo, np.searchsorted(code, wanted, "right") - lo)
    both, where = np.unique((so[token[pair]] - s0) * (s1 - s0) + sp[other] - s0, return_inverse=True)
    return norms, both // max(1, s1 - s0), both % max(1, s1 - s0), np.bincount(where, weights=gram.g[place[pair]], minlength=len(both))


def _looked_up(batches: Iterator[pa.RecordBatch], gram: Gram) -> Iterator[pa.RecordBatch]:
    """Units -> pairs of sentences, with all word cosines at hand."""
    for batch in batches:
        laid = Laid(batch.column("docs"))
        langs = np.array([gram.langs[x] for x in batch.column("lang").to_pylist()], np.int64)
        out = []
        for low in range(0, len(batch), CHUNK):
            high = min(low + CHUNK, len(batch))
            norms, a, b, v = _sums(laid, langs, gram, low, high)
            first = np.searchsorted(laid.unit, np.arange(low, high + 1))
            parts = np.searchsorted(a, first - first[0])
            for k in range(high - low):
                x, y = first[k], first[k + 1]
                if parts[k] == parts[k + 1]:
                    continue
                some, zero = slice(parts[k], parts[k + 1]), x - first[0]
                dot = dict(zip(((a[some] - zero) * (y - x) + b[some] - zero).tolist(), v[some].tolist()))
                owner = laid.doc[x:y].tolist()
                n_o = int(laid.original[x:y].sum())
                for o, p, score in _best_pairs(owner, n_o, norms[zero : zero + y - x].tolist(), dot):
                    out.append((owner[o], x + o, owner[p], x + p, score))
        docs, places = (np.array([r[k::2][:2] for r in out], np.int64).reshape(-1, 2) for k in (0, 1))
        ids = [laid.ids.take(pa.array(docs[:, k])) for k in (0, 1)]
        starts = [pa.array(laid.starts[places[:, k]].astype(np.int32)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([ids[0].cast(pa.int64()), starts[0], ids[1], starts[1], pa.array([r[4] for r in out], pa.float64())], names=["original_id", "o_start", "passage_id", "p_start", "score"])


def _best_pairs(owner: list[int], n_o: int, norm: list[float], dot: dict[int, float]) -> list[tuple[int, int, float]]:
    """Pairs of the sentences of a unit, those of originals (n_o) in front; owner: the document of each; dot of a and b by a * len(owner) + b."""
    n, n_p = len(owner), len(owner) - n_o
    where = [(k + 0.5) / n_o for k in range(n_o)] + [(k + 0.5) / n_p for k in range(n_p)]  # middle of the sentence in its side
    found = []
    # A sentence against windows of neighbouring sentences of one text; a window that begins or ends with a sentence of no common word is never the best.
    for code, v in dot.items():
        a, b = divmod(code, n)
        at, to = where[a], where[b]
        score = v / ((norm[a] * norm[b]) ** 0.5 or 1.0) * (1 - DRIFT * abs(at - to))
        if score >= LEAST:
            found.append((-score, (a,), (b,)))
        total, norms = v, norm[a]
        for k in range(1, MERGE):
            if a + k >= n_o or owner[a + k] != owner[a]:
                break
            norms += norm[a + k]
            part = dot.get(code + k * n)
            if part is not None:
                total += part
                score = total / ((norms * norm[b]) ** 0.5 or 1.0) * (1 - DRIFT * abs((at + where[a + k]) / 2 - to)) / GAIN**k
                if score >= LEAST:
                    found.append((-score, tuple(range(a, a + k + 1)), (b,)))
        total, norms = v, norm[b]
        for k in range(1, MERGE):
            if b + k >= n or owner[b + k] != owner[b]:
                break
            norms += norm[b + k]
            part = dot.get(code + k)
            if part is not None:
                total += part
                score = total / ((norm[a] * norms) ** 0.5 or 1.0) * (1 - DRIFT * abs(at - (to + where[b + k]) / 2)) / GAIN**k
                if score >= LEAST:
                    found.append((-score, (a,), tuple(range(b, b + k + 1))))
    used: set[int] = set()
    out = []
    for score, o, p in sorted(found):  # the best pair of what is left is each other's best
        if used.isdisjoint(o) and used.isdisjoint(p):
            used.update(o, p)
            out += [(k, j, -score) for k in o for j in p]
    return out


def _mutual_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units with their sentences, norms and parts of cosines -> pairs of sentences."""
    for pdf in batches:
        out = []
        for docs, values in zip(pdf["docs"], pdf["values"]):
            starts, owner, number = [], [], {}
            for k, d in enumerate(docs):
                for n, a in enumerate(d["starts"]):
                    number[k, n] = len(starts)
                    starts.append(int(a))
                    owner.append(k)
            norm, dot = [0.0] * len(starts), {}
            for v in values:
                at = number[v["d"], v["s"]]
                if v["e"] < 0:
                    norm[at] = v["v"]
                else:
                    dot[at * len(starts) + number[v["e"], v["t"]]] = v["v"]
            n_o = sum(docs[k]["side"] == "o" for k in owner)
            out += [(int(docs[owner[a]]["id"]), starts[a], docs[owner[b]]["id"], starts[b], score) for a, b, score in _best_pairs(owner, n_o, norm, dot)]
        yield pd.DataFrame(out, columns=["original_id", "o_start", "passage_id", "p_start", "score"])


def _share(weight: Column) -> Column:
    """How a pair stands to the best pair of either of its words: 1 if it is the best of both, the same for equal ones."""
    for_o, for_p = Window.partitionBy("lang", "ow"), Window.partitionBy("lang", "pw")
    return weight**2 / (F.max(weight).over(for_o) * F.max(weight).over(for_p))


def align_sentences(originals: DataFrame, passages: DataFrame) -> DataFrame:
    """(original_id, o_start, passage_id, p_start, score) of the sentences that render one another.

    originals: (id bigint, work_id, ref_unit, language, body); passages: (id string, work_id,
    ref_unit, body), each delivered once, without apparatus.  Rows with a null key or body pair with
    nothing; a unit on one side only gives no row.  Counts run over all units; every word pair of
    a cosine of LEAST_WORD or more enters the dot products, weighed by how sure it is.
    """
    spark = originals.sparkSession
    uid = F.xxhash64("work_id", "ref_unit")
    known = "work_id is not null and ref_unit is not null and id is not null and body is not null"
    o = originals.filter(known).select(uid.alias("uid"), F.lit("o").alias("side"), F.coalesce("language", F.lit("")).alias("lang"), F.col("id").cast("string").alias("id"), "body")
    p = passages.filter(known).select(uid.alias("uid"), F.lit("p").alias("side"), F.lit("").alias("lang"), "id", "body")
    docs = o.unionByName(p).mapInPandas(_documents, DOCUMENT)
    # The documents of the concept space: units that have both sides.
    units = docs.groupBy("uid").agg(F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("side", "id", "starts", "words"))).alias("docs"))
    units = written(units.filter("exists(docs, x -> x.side = 'o') and exists(docs, x -> x.side = 'p')"), "paired-units")

    counted = units.select("lang", "docs").mapInArrow(_count_words, COUNTS).groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n"))
    counted = written(counted, "word-counts")
    n_units = counted.filter("kind = 3").select("lang", F.col("n").alias("n_units"))  # a row a language
    df_o = written(counted.filter("kind = 1").select("lang", F.col("a").alias("ow"), F.col("n").alias("df_o")).join(F.broadcast(n_units), "lang"), "words-of-originals")
    df_p = written(counted.filter("kind = 2").select("lang", F.col("a").alias("pw"), F.col("n").alias("df_p")).join(F.broadcast(n_units.withColumnRenamed("n_units", "n_p")), "lang"), "words-of-translations")
    small_o, small_p = _if_small(df_o), _if_small(df_p)
    # Cosine of two words over the concepts, less what chance gives two words of these frequencies.
    scored = counted.filter("kind = 0").select("lang", F.col("a").alias("ow"), F.col("b").alias("pw"), F.col("n").alias("co")).join(small_o, ["lang", "ow"]).join(small_p, ["lang", "pw"])
    chance = F.col("df_o") * F.col("df_p") / F.col("n_units")
    scored = scored.withColumn("cos", (F.col("co") - chance) / F.sqrt(F.col("df_o") * F.col("df_p"))).filter(f"cos > {LEAST_WORD}")
    # Every such pair counts: the less, the fewer units speak for it and the stronger the rivals of either word are.
    sure = (F.col("co") - chance) ** 2 / ((F.col("co") - chance) ** 2 + DOUBT**2 * F.col("co"))
    scored = scored.withColumn("weight", F.col("cos") * sure)
    scored = scored.withColumn("share", _share(F.col("weight")))
    idf_o, idf_p = F.log(1 + F.col("n_units") / F.col("df_o")), F.log(1 + F.col("n_units") / F.col("df_p"))
    gram = written(scored.select("lang", "ow", "pw", (F.col("weight") * F.col("share") * idf_o * idf_p).alias("g")), "word-cosines")

    w2_o, w2_p = small_o.select("lang", F.col("ow").alias("w"), (idf_o * idf_o).alias("w2")), small_p.select("lang", F.col("pw").alias("w"), (F.log(1 + F.col("n_p") / F.col("df_p")) ** 2).alias("w2"))
    if max(x.count() for x in (gram, df_o, df_p)) <= SMALL:
        of_words = spark.sparkContext.broadcast(Gram(gram.toPandas(), w2_o.toPandas(), w2_p.toPandas()))
        return units.select("lang", "docs").mapInArrow(lambda batches: _looked_up(batches, of_words.value), PAIR)
    # Sentences: the products of their words' weights and cosines, summed by a sparse join within the unit.
    exploded = units.select("uid", "lang", F.posexplode("docs").alias("d", "doc")).select("uid", "lang", "d", "doc.side", F.posexplode("doc.words").alias("s", "ws"))
    words = exploded.select("uid", "lang", "side", F.col("d").cast("int").alias("d"), F.col("s").cast("int").alias("s"), F.explode("ws").alias("w"))
    ow = words.filter("side = 'o'").select("uid", "lang", "d", "s", F.col("w").alias("ow")).join(gram, ["lang", "ow"]).select("uid", "d", "s", "pw", F.col("g").cast("float").alias("g"))
    pw = words.filter("side = 'p'").select("uid", F.col("d").alias("e"), F.col("s").alias("t"), F.col("w").alias("pw"))
    dots = ow.join(pw, ["uid", "pw"]).groupBy("uid", "d", "s", "e", "t").agg(F.sum("g").alias("v"))
    norms = words.filter("side = 'o'").join(w2_o, ["lang", "w"]).unionByName(words.filter("side = 'p'").join(w2_p, ["lang", "w"])).groupBy("uid", "d", "s").agg(F.sum("w2").alias("v"))
    values = dots.unionByName(norms.select("uid", "d", "s", F.lit(-1).cast("int").alias("e"), F.lit(0).cast("int").alias("t"), "v"))
    by_unit = values.groupBy("uid").agg(F.collect_list(F.struct("d", "s", "e", "t", "v")).alias("values"))
    heads = units.select("uid", F.transform("docs", lambda x: F.struct(x["side"].alias("side"), x["id"].alias("id"), x["starts"].alias("starts"))).alias("docs"))
    return heads.join(by_unit, "uid").drop("uid").mapInPandas(_mutual_best, PAIR)


def translated_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Originals and passages once each, the passages with their segment's unit where they have none of their own."""
    originals = delivered_once(table(spark, sf_dir, "originals").select("id", "work_id", "ref_unit", "language", "body", "created_at"), "id", "created_at")
    passages = delivered_once(table(spark, sf_dir, "passages").select("id", "work_id", "ref_unit", "body", "is_apparatus", "created_at"), "id", "created_at")
    passages = passages.filter("not coalesce(is_apparatus, false)")
    letter = F.when(F.col("part") > 0, F.char(F.col("part") + 97)).otherwise("")
    segments = table(spark, sf_dir, "segments").filter("ref_unit is not null").select(F.concat("work_id", F.lit(":"), F.col("n").cast("string"), letter).alias("id"), F.col("ref_unit").alias("of_segment"))
    segments = segments.groupBy("id").agg(F.min("of_segment").alias("of_segment"))
    passages = passages.join(segments, "id", "left").withColumn("ref_unit", F.coalesce("ref_unit", "of_segment"))
    return originals, passages


def p1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_sentences(*translated_units(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_scored(spark, sf_dir).select("original_id", "o_start", "passage_id", "p_start")
