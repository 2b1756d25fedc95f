import random

from textloom.llm import private
from textloom.llm.private import SAME, Field, L, NameCues, find_private, marginals, redacted, viterbi
import numpy as np

GIVEN = "Anna Bertil Clara Dorian Elsa Fabian Greta Henrik Ida Jonas".split()
SUR = "Holderhurst Branström Velkamp Ostriard Nessgaova Drumitz Wynblemore Cravlow".split()
TOWN = "Hollowhaven Millwick Osterby Larkmere Alderford".split()
FILL = ["The river is wide.", "In The Old Book this is called dry.", "Catalogue entry 302/1908 is a duplicate.", "On the Street of Weavers, Pilon taught for 12 years.", "The edition carries ISBN 000-0-4977-725-1.", "The note @8.17 refers to line 22."]


def document(rng):
    name = f"{rng.choice(GIVEN)} {rng.choice(SUR)}"
    address = f"{rng.randrange(1, 200)} {rng.choice(['Quince', 'Salt', 'Candle'])} Lane, {rng.choice(TOWN)} {rng.randrange(10000, 99999)}"
    phone, mail, number = f"020 7946 0{rng.randrange(100, 999)}", f"{name.split()[0].lower()}@post.{rng.choice(TOWN).lower()}.example", f"QX{rng.randrange(1000000, 9999999)}"
    parts = [("For permission write to Dr ", name, "name"), (", ", address, "address"), (", or ring ", phone, "phone"), (" or write to ", mail, "email"), (". Insurance number: ", number, "id_number")]
    text, spans = rng.choice(FILL) + " ", []
    for lead, value, kind in parts[: rng.randrange(0, 6)]:
        text += lead
        spans.append((kind, len(text), len(text) + len(value)))
        text += value
    return text + ". " + rng.choice(FILL), spans


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    docs = [document(rng) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)] + [(1000, None), (1001, "")], "doc_id long, text string")
    found = find_private(df, sample=150)
    got = {tuple(r) for r in found.collect()}
    want = {(k, *s) for k, (_, spans) in enumerate(docs) for s in spans}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.95
    clean = {r["doc_id"]: r["text"] for r in redacted(df, found).collect()}
    assert clean[1000] is None and clean[1001] == "" and len(clean) == 402
    k = next(k for k, (_, s) in enumerate(docs) if not s)
    assert clean[k] == docs[k][0] and any("[NAME]" in (t or "") for t in clean.values())
    assert find_private(df.limit(0)).count() == 0


def test_patterns_are_careful():
    kinds = lambda t: [k for k, _, _ in NameCues().labels(t)]
    assert kinds("Shelf mark MS 4417-82-8691 and ISBN 000-0-4977-725-1, @ 50 pence, note @8.17.16") == []
    assert kinds("Reach a.b+c (at) post (dot) mere (dot) test") == ["email"]
    assert kinds("Sulakun of Hollowhaven, pupil of Pilon, read The Dry Carts, 4.28") == []


def test_surroundings_of_names_are_learned():
    rng = random.Random(6)
    made = lambda: "".join(rng.choice("b d g k l m n r s t v".split()) + rng.choice("aeiou") for _ in range(3)).title()
    texts = [f"{rng.choice(FILL)} Bound at the wish of {made()} {made()} in the spring. {rng.choice(FILL)} As Old Pilon says, it rains." for _ in range(40)]
    texts += [f"Then Old Pilon and Grey Dupen {v} the hill. {rng.choice(FILL)}" for v in "climb leave see own paint".split() * 4]
    cues = NameCues(texts)
    assert ("<", "wish", "of") in cues.personal and (">", "says", ",") not in cues.personal
    new = "Bound at the wish of Anna Velkamp, Bertil Wynblemore and Grey Dupen. Old Pilon waits."
    assert [new[a:b] for k, a, b in cues.labels(new) if k == "name"][:2] == ["Anna Velkamp", "Bertil Wynblemore"]


def test_phrasing_not_in_any_list(spark):
    # The same people's data in a phrase that no pattern knows: learned from the sample, found in documents outside it.
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("b d g k l m n r s t v".split()) + rng.choice("aeiou") for _ in range(n)).title()
    docs = []
    for _ in range(400):
        name, lead = f"{rng.choice(GIVEN)} {made(3)}", rng.choice(["Bound at the wish of ", "The parcel went out to ", "A gift from "])
        text = f"{rng.choice(FILL)} {lead}"
        docs.append((text + name + " last week. " + rng.choice(FILL), [("name", len(text), len(text) + len(name))]))
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string")
    got = {tuple(r) for r in find_private(df, sample=60).collect()}
    want = {(k, *s) for k, (_, spans) in enumerate(docs) for s in spans}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_messages_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    f = Field()
    u = rng.normal(size=(1, 3, L)).astype(np.float32)
    size = np.array([3])
    paths = list(itertools.product(range(L), repeat=3))
    score = np.array([sum(u[0, k, y] for k, y in enumerate(p)) + f.step[p[0], p[1]] + f.step[p[1], p[2]] - (30 if p[0] and p[0] % 2 == 0 else 0) for p in paths])
    assert tuple(viterbi(u, f.step, size)[0]) == paths[int(score.argmax())]
    w = np.exp(score - score.max())
    want = np.zeros((3, L))
    for p, x in zip(paths, w / w.sum()):
        for k, y in enumerate(p):
            want[k, y] += x
    assert np.abs(marginals(u, f.step, size)[0][0] - want).max() < 1e-4


def test_links_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    f = Field()
    few = [0, 1, 2]  # the labels that matter here; the others are made impossible
    u = np.full((2, 2, L), -25, np.float32)
    u[:, :, few] = rng.normal(size=(2, 2, 3))
    pull = rng.normal(size=(L, L)).astype(np.float32)
    f.skip[SAME] = pull + pull.T
    size, links = np.array([2, 2]), np.array([[1, 2, SAME]])  # the second token of one chain with the first of the other
    now, _, _ = f.messages(u, size, links, rounds=60)
    got = marginals(now, f.step, size)[0]
    want = np.zeros((2, 2, L))
    for y in itertools.product(few, repeat=4):
        score = sum(u[k // 2, k % 2, v] for k, v in enumerate(y)) + f.step[y[0], y[1]] + f.step[y[2], y[3]] + f.skip[SAME][y[1], y[2]] - sum(30 for v in (y[0], y[2]) if v and v % 2 == 0)
        for k, v in enumerate(y):
            want[k // 2, k % 2, v] += np.exp(score)
    want /= want[0, 0].sum()
    assert np.abs(got - want).max() < 1e-3


def test_pruned_windows_change_nothing(monkeypatch):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        text, _ = document(rng)
        texts.append(text + " " + " ".join(rng.choice(FILL) for _ in range(12)) + " Perhaps Velkamp Anna came, Nessgaova Ida too, and Velkamps all. " + rng.choice(SUR) + " Elsa went.")
    field = private.fit_field(texts)
    assert field.skip.any()
    got = sorted(private.label_texts(texts, field, private.Features()))
    monkeypatch.setattr(Field, "pull", lambda self: 1e6)  # nothing with links is pruned
    assert sorted(private.label_texts(texts, field, private.Features())) == got and got
