import random

import numpy as np

from textloom.llm.alignment import _pair_counts, align_sentences, stem

DIGITS = str.maketrans("0123456789", "abcdefghij")


def test_stems():
    assert stem("φώλος", False) == stem("φώλουσι", False) and stem("stones", True) == stem("stone", True) and stem("Twelve", True) == stem("12", False) == "#12"


def test_lexicon_of_an_invented_language(spark):
    rng = random.Random(9)
    nouns = [f"{a}{b}" for a in "stone river lamp horse tower garden bread letter".split() for b in ("", "ward", "man", "let")]
    foreign = {w: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for w in nouns}
    originals, passages, want = [], [], set()
    for k in range(300):
        source, target, o_text, p_text = [], [], "", ""
        for s in range(rng.randrange(2, 5)):
            ws = rng.sample(nouns, 4)
            source.append(" ".join(foreign[w] for w in ws).capitalize() + ".")
            if rng.random() > 0.15:  # else left out by the translator
                target.append((s, "The " + " ".join(ws) + " stands."))
        starts = []
        for x in source:
            starts.append(len(o_text))
            o_text += x + " "
        for s, x in target:
            want.add((k, starts[s], f"w:{k}", len(p_text)))
            p_text += x + " "
        originals.append((k, "w", str(k), "zzz", o_text))
        passages.append((f"w:{k}", "w", str(k), p_text))
    originals += [(900, "w", None, "zzz", "X."), (901, "w", "only", "zzz", "X."), (902, "w", "null", "zzz", None)]
    passages += [("w:null", "w", "null", "The stone."), ("w:empty", "w", "1", "")]
    o = spark.createDataFrame(originals, "id long, work_id string, ref_unit string, language string, body string")
    p = spark.createDataFrame(passages, "id string, work_id string, ref_unit string, body string")
    got = {(r[0], r[1], r[2], r[3]) for r in align_sentences(o, p).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    assert align_sentences(o.limit(0), p).count() == 0


def test_words_of_one_unit_only(spark):
    originals = [(k, "w", str(k), "zzz", f"Od{k}qa bel{k}qa.".translate(DIGITS)) for k in range(250)]
    passages = [(f"w:{k}", "w", str(k), f"Hon{k}x mir{k}x.".translate(DIGITS)) for k in range(250)]
    o = spark.createDataFrame(originals, "id long, work_id string, ref_unit string, language string, body string")
    p = spark.createDataFrame(passages, "id string, work_id string, ref_unit string, body string")
    got = {(r[0], r[2]) for r in align_sentences(o, p).collect()}
    assert got == {(k, f"w:{k}") for k in range(250)}


def test_words_with_many_renderings(spark):
    rng = random.Random(4)

    def word() -> str:
        return "".join(rng.choice("bdgklmnprt") + rng.choice("aiou") for _ in range(4))

    renderings = {word(): [word() for _ in range(6)] for _ in range(40)}
    originals, passages, want = [], [], set()
    for k in range(900):
        o_text, target = "", []
        for _ in range(3):
            ws = rng.sample(sorted(renderings), 3)
            target.append((len(o_text), " ".join(rng.choice(renderings[w]) for w in ws).capitalize() + ". "))
            o_text += " ".join(ws).capitalize() + ". "
        p_text = ""
        for at, x in rng.sample(target, 3):
            want.add((k, at, f"w:{k}", len(p_text)))
            p_text += x
        originals.append((k, "w", str(k), "zzz", o_text))
        passages.append((f"w:{k}", "w", str(k), p_text))
    o = spark.createDataFrame(originals, "id long, work_id string, ref_unit string, language string, body string")
    p = spark.createDataFrame(passages, "id string, work_id string, ref_unit string, body string")
    got = {(r[0], r[1], r[2], r[3]) for r in align_sentences(o, p).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95, (len(got), len(want), len(got & want))


def test_sentences_meet_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    nouns = [f"{a}{b}" for a in "stone river lamp horse tower garden bread letter".split() for b in ("", "ward", "man", "let", "ling", "wort")]
    originals, passages = [], []
    for k in range(240):
        ws = [rng.sample(nouns, 3) for _ in range(3)]
        originals.append((k, "w", str(k // 2), "zzz" if k % 4 < 2 else "yyy", " ".join(" ".join(x[::-1] for x in s).capitalize() + "." for s in ws)))
        passages.append((f"w:{k}", "w", str(k // 2), " ".join(" ".join(s).capitalize() + "." for s in ws) if k % 9 else "..."))
    o = spark.createDataFrame(originals, "id long, work_id string, ref_unit string, language string, body string")
    p = spark.createDataFrame(passages, "id string, work_id string, ref_unit string, body string")
    looked_up = align_sentences(o, p)
    assert "Exchange" not in looked_up._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r[:4]): r[4] for r in looked_up.collect()}
    monkeypatch.setattr("textloom.llm.alignment.SMALL", 0)
    joined = {tuple(r[:4]): r[4] for r in align_sentences(o, p).collect()}
    assert len(got) > 300 and got.keys() == joined.keys() and all(abs(got[k] - joined[k]) < 1e-5 for k in got)


def test_pairs_counted_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    units = [(np.unique(rng.integers(0, 9, 5)), np.unique(rng.integers(0, 7, 6))) for _ in range(20)]
    o, p = (np.concatenate([u[k] for u in units]) for k in (0, 1))
    starts = np.cumsum([0] + [len(u[1]) for u in units])[:-1]
    first, many = (np.repeat(x, [len(u[0]) for u in units]) for x in (starts, [len(u[1]) for u in units]))
    want: dict[int, int] = {}
    for a, b in units:
        for x in a:
            for y in b:
                want[x * 7 + y] = want.get(x * 7 + y, 0) + 1
    for cells, pairs in ((100, 10), (0, 10), (0, 1000)):
        monkeypatch.setattr("textloom.llm.alignment.CELLS", cells)
        monkeypatch.setattr("textloom.llm.alignment.PAIRS", pairs)
        got: dict[int, int] = {}
        for codes, n in _pair_counts(o, first, many, p, 9, 7):
            for c, m in zip(codes.tolist(), n.tolist()):
                got[c] = got.get(c, 0) + m
        assert got == want
