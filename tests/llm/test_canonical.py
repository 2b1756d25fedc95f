from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.canonical import canonical, canonical_col, hashed_forms, same_looking_pairs
from pyspark.sql import functions as F


def test_what_is_not_seen():
    same = [
        ("Ｆｕｌｌ width", "Full width"), ("café", "café"), ("a​b­c", "abc"), ("a b c", "a b c"), ("sсope", "scope"), ("λoγος", "λογος"),
        ("ﬁne", "fine"), ("⼭⽔", "山水"), ("तो|", "तो।"), ("ताे", "तो"), ("नमः", "नम:"), ("שׁ", "שׁ"), ("a\n b", "a b"), ("｢山｡｣", "「山。」"),
        ("well‐known", "well-known"), ("well‑known", "well-known"), ("山\U000e0100水", "山水"), ("a\U000e0061b", "ab"), ("Ꭺꭼ"[:1], "A"), ("ϲan", "can"), ("Ӏt", "It"), ("κот", "кот"), ("հօt", "hot"), ("ﾠa", "a"),
    ]
    assert [canonical(a) == canonical(b) for a, b in same] == [True] * len(same)


def test_what_is_seen():
    different = [("Case", "case"), ("resume", "résumé"), ("a-b", "a–b"), ("“a”", '"a"'), ("x²", "x2"), ("क्‍ष", "क्ष")]
    assert all(canonical(a) != canonical(b) for a, b in different)
    assert canonical("Λόγος") == "Λόγος" and canonical("слово") == "слово" and canonical("кот") == "кот" and canonical("κόσμος") == "κόσμος" and canonical(None) is None


ODD = "aeoκкAB ﾠㅤᅠ\u0301\u0323\u0345\u200b\u200d\ufe0f\U000e0101ﬁｶﾞ가ᄀ각क़़ाेअשּׁ:'\"|।॥Ꮃօϲ‐‑‒"


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=ODD, max_size=12))
def test_stable(text):
    assert canonical(canonical(text)) == canonical(text)


def test_pairs(spark, monkeypatch):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, None), (5, "ab"), (None, "a b"), (10, "ａ b"), (11, "ａ b")]
    df = spark.createDataFrame(rows, "id int, body string").withColumn("form", F.lit("clash"))
    want = sorted((min(a, b), max(a, b)) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if a and b and x and y and x != y and canonical(x) == canonical(y))
    for part in (200_000, 1):  # texts split over tasks or not
        monkeypatch.setattr("textloom.llm.canonical.PART", part)
        assert sorted(map(tuple, same_looking_pairs(hashed_forms(df, "id", "body")).collect())) == want and len(want) == 6
    assert same_looking_pairs(hashed_forms(df.limit(0), "id", "body")).count() == 0
    got = df.select(canonical_col(F.col("body")).alias("c")).toPandas()["c"].tolist()
    assert got == [canonical(b) for _, b in rows]
