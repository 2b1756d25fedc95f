import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import sentences as S


def cut(text):
    return [text[a:b] for a, b in S.split_many([text])[0]]


@pytest.mark.parametrize("text,want", [
    ("One is 3.14, cf. Two. Dr. Smith said no. Yes!", ["One is 3.14, cf. Two.", "Dr. Smith said no.", "Yes!"]),
    ('He said: "Go. Now!" They went.', ['He said: "Go. Now!"', "They went."]),
    ("“Go!” he said. Next.", ["“Go!” he said.", "Next."]),
    ("12. First one.\n13. Second.", ["12. First one.", "13. Second."]),
    ("木土。言足？「山。水。」曰。", ["木土。", "言足？", "「山。水。」曰。"]),
    ("老《木土。言足》多。沙。", ["老《木土。言足》多。", "沙。"]),
    ("山水也木土矣", ["山水也", "木土矣"]),
    ("山水木\n土金", ["山水木", "土金"]),
    ("दो तीन ।\nचार ॥ १२ ॥ पाँच ॥ १३ ॥", ["दो तीन ।\nचार ॥ १२ ॥", "पाँच ॥ १३ ॥"]),
    ("τί λέγεις; Ναί· οὔ. τ. ἔ. καλῶς.", ["τί λέγεις;", "Ναί· οὔ.", "τ. ἔ. καλῶς."]),
    ("no end marks at all", ["no end marks at all"]),
    ("Open “quote. Never closed. End.", ["Open “quote.", "Never closed.", "End."]),
    ("  \n ", []), ("", []),
])
def test_rules(text, want):
    assert cut(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\"“”‘’\n1।॥木。「」«»;", max_size=200))
def test_sentences_cover_all_but_white_space(text):
    spans = S.split_many([text])[0]
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    left = list(text)
    for a, b in spans:
        left[a:b] = " " * (b - a)
    assert not "".join(left).strip()


def test_prefix_scan_is_a_plain_walk():
    rng = random.Random(1)
    import numpy as np

    cls = np.array([rng.randrange(S.CLASSES) for _ in range(1000)], np.int16)
    doc = np.sort(np.array([rng.randrange(7) for _ in range(1000)]))
    got = S.outputs(cls, doc, np.zeros(7, np.int64))
    state, last, want = 0, -1, []
    for c, d in zip(cls, doc):
        state = 0 if d != last else state
        last = d
        want.append(S.OUT[state, c])
        state = S.NEXT[state, c]
    assert got.tolist() == want


ALPHABET = 'aB.．!?"“”‘’ \n1｜|।॥木。「」«»;;\u200bα()12 也　'


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300), st.lists(st.integers(0, 300), max_size=6))
def test_events_are_the_same_wherever_a_text_is_parted(text, cuts):
    how = S.layout(text)
    places = [0, *sorted({c for c in cuts if c < len(text)} - {0}), len(text)]
    parts = []
    for a, b in zip(places, places[1:]):
        lead = min(a, S.CONTEXT)
        got = S.events(text[a - lead : b + S.CONTEXT], how, lead, lead + b - a)
        parts += [(c, e + a - lead) for c, e in got]

    def run(found):
        state, said = S.START, []
        for c, e in found:
            if S.OUT[state, c]:
                said.append((int(S.OUT[state, c]), e))
            state = S.NEXT[state, c]
        return said

    assert run(parts) == run(S.events(text, how))


def both(spark, texts, longs):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id int, text string, s_no string")
    whole = sorted((k, n, a, b) for k, t in enumerate(texts) if t for n, (a, b) in enumerate(S.split_many([t])[0]))
    for n in longs:
        assert sorted(map(tuple, S.split_sentences(df, "text", ["id"], long=n).select("id", "s_no", "s_start", "s_end").collect())) == whole
    return len(whole)


def test_long_documents_in_chunks(spark):
    rng = random.Random(5)
    words = ["word", "Say:", "“Go.", "Now.”", "end.", "Dr.", "3.5", "why?", "cf.", "and", "12.", "(a)", "«", "»", "“", "......", "。", "「", "」", "!"]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(8)] + [None, "", "x" * 3000, " . . " * 200, "“open. And. " * 90]
    assert both(spark, texts, (10**6, 150, 1)) > 100
    df = spark.createDataFrame([(None, "One. Two.")] * 2, "id int, text string")
    assert len(S.split_sentences(df, "text", ["id"], long=3).collect()) == len(S.split_sentences(df, "text", ["id"]).collect()) == 4
    assert S.split_sentences(df.limit(0), "text", ["id"]).count() == 0


def test_what_stands_far_in_front_is_known_in_every_chunk(spark):
    greek = "τί λέγεις; " + "ti legeis; nai. " * 3000
    marks = "! " * 18_000 + "12. Then it goes on. " * 3 + "x" * S.LONG
    assert len(greek) > S.LONG and both(spark, [greek, marks], (S.LONG,)) > 6000
