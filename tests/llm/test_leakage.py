import random
from itertools import combinations

import numpy as np
from textloom.llm import leakage
from textloom.llm.leakage import GAP, LEAST_WORDS, LONG_RUN, SEED, WORDS_AN_EDIT, leaked, words


def aligned(doc, item):
    """Whether some LEAST_WORDS or more words of the item stand in the document with few enough edits: fewest edits for every stretch of the item."""
    for begin in range(len(item) - LEAST_WORDS + 1):
        row = [0] * (len(doc) + 1)
        for n, w in enumerate(item[begin:], 1):
            new = [row[0] + 1]
            for k, d in enumerate(doc, 1):
                new.append(min(row[k - 1] + (w != d), row[k] + 1, new[-1] + 1))
            row = new
            if n >= LEAST_WORDS and WORDS_AN_EDIT * min(row) <= n:
                return True
    return False


def test_words():
    assert words("Don’t STOP—now, 山水 ｆｕｌｌ") == ["don", "t", "stop", "now", "山", "水", "full"] and words(None) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([15, 24, 34])))) for k in range(6)] + [(90, "too short"), (91, None)]
    docs = []
    for d in range(48):
        body = [rng.choice(vocab) for _ in range(30)]
        src = words(items[d % 6][1])
        n = min(len(src), rng.choice([14, 15, 18, 24, 30]))
        at = rng.randrange(len(src) - n + 1)
        part = src[at : at + n]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            p = rng.randrange(len(part))
            what = rng.randrange(3)
            part[p : p + 1] = [] if what == 0 else ["zz"] if what == 1 else [part[p], "yy"]
        body[15:15] = part
        docs.append((d, ", ".join(w.upper() if rng.random() < 0.1 else w for w in body)))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, i) for d, t in docs for i, x in items if t and x and aligned(words(t), words(x))}
    rows = leaked(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r[0], r[1]) for r in rows} == want and len(rows) == len(want) > 20
    texts, of = dict(docs), dict(items)
    for r in rows:
        run = words(texts[r["doc_id"]][r["d_start"] : r["d_end"]])
        assert len(run) == r["run_words"] and " ".join(run) in " ".join(words(of[r["item_id"]]))
    assert leaked(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_suffix_array_is_a_sort_of_all_suffixes():
    rng = np.random.default_rng(3)
    doc = rng.integers(0, 3, 400)
    doc[-1] = 0
    item = np.concatenate([[0], doc[50:70], [0], rng.integers(1, 3, 30), [0]])
    got = leakage.Suffixes(doc, 2, 400)

    def suffix(p):
        end = p
        while doc[end]:
            end += 1
        return doc[p:end].tolist()

    assert [suffix(p) for p in got.places] == sorted(suffix(p) for p in np.nonzero(doc)[0])
    keys = leakage._keys(item, 2)
    at = leakage._whole(keys, 2)
    lo, hi, lo6, hi6, longest, place = got.look_up(item, at, keys[at])
    for k, i in enumerate(at):
        rest = item[i : i + int(np.argmax(item[i:] == 0))].tolist()
        common = [next((n for n, (a, b) in enumerate(zip(rest, suffix(p))) if a != b), min(len(rest), len(suffix(p)))) for p in range(len(doc))]
        assert longest[k] == (max(common) if max(common) >= SEED else 0)
        assert place[k] < 0 or common[place[k]] == max(common)
        assert {int(p) for p in got.places[lo[k] : hi[k]]} == {p for p, n in enumerate(common) if n >= SEED}
        assert {int(p) for p in got.places[lo6[k] : hi6[k]]} == {p for p, n in enumerate(common) if n >= LONG_RUN}


def test_a_frequent_run_of_words_does_not_multiply():
    item = " ".join(f"w{k % 7}" if k % 9 < 5 else f"x{k}" for k in range(90))
    text = " ".join(f"w{k % 5}" if k % 21 < 4 else "other" for k in range(60_000))
    blocks = [(*b, leakage.Numbers(b[0])) for b in leakage.item_blocks([(k, words(item)) for k in range(50)])]
    assert leakage._shard([words(text)], blocks) == {}


def test_order_matters_and_han(spark):
    item = "山水木火土金日月星辰天地人心手足"
    df = spark.createDataFrame([(1, "前" + " ".join(item[:15]) + "後"), (2, item[::-1]), (3, item[:9])], "doc_id long, text string")
    assert [tuple(r) for r in leaked(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5, 15, 1, 30)]


def test_short_runs_between_edits(spark):
    item = [f"w{k}" for k in range(18)]
    docs = []
    for at in range(4):  # runs of 3, 3, 3 and 6 words in any order
        runs = [3, 3, 3, 3]
        runs[at] = 6
        edits = [sum(runs[: k + 1]) + k for k in range(3)]
        docs.append((at, [f"zz{k}" if k in edits else w for k, w in enumerate(item)]))
        docs.append((4 + at, [w for k, w in enumerate(item) if k not in edits]))
        docs.append((8 + at, [f"zz{k}" if k in (*edits, edits[0] + 1) else w for k, w in enumerate(item)]))  # one edit too many
    assert {d for d, ws in docs if aligned(ws, item)} == set(range(8))
    df = spark.createDataFrame([(d, "before it " + " ".join(ws) + " after it") for d, ws in docs], "doc_id long, text string")
    assert {r[0] for r in leaked(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()} == set(range(8))


def test_least_runs_of_a_passage():
    # Every pattern of edits up to 30 words has a long run, or two shorter ones near by.
    for n in range(LEAST_WORDS, 31):
        e = n // WORDS_AN_EDIT
        for cuts in combinations(range(n), e):
            runs = [(a + 1, b) for a, b in zip((-1, *cuts), (*cuts, n))]
            seeds = [(a, b) for a, b in runs if b - a >= SEED]
            assert any(b - a >= LONG_RUN for a, b in seeds) or any(c - b <= GAP for (_, b), (c, _) in zip(seeds, seeds[1:]))
