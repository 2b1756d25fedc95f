import datetime as dt
import random

from textloom.operators.snapshot_diff import snapshot_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, slug string, text string, kh string"


def rows(spark, data):
    return spark.createDataFrame([(n, dt.datetime(2026, 1, d), k, t, x) for n, d, k, t, x in data], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_added_removed_changed_and_what_does_not_count(spark):
    df = rows(spark, [
        (1, 1, "a", "x  y", None), (1, 1, "b", "x", None), (1, 1, "c", None, None), (1, 1, "d", "q", "1"),
        (4, 2, "a", " x y", None), (4, 2, "c", "", None), (4, 2, "d", "q", None), (4, 2, "e", "n", None), (4, 3, "e", "n", None),
        (None, 1, "z", "x", None), (4, 1, None, "x", None),
    ])
    assert found(snapshot_changes(df, "slug")) == [(4, "b", "removed"), (4, "c", "changed"), (4, "d", "changed"), (4, "e", "added")]


def test_repeated_delivery_takes_the_last(spark):
    df = rows(spark, [(1, 1, "a", "x", None), (2, 2, "a", "y", None), (2, 3, "a", "x", None)])
    assert found(snapshot_changes(df, "slug")) == []


def test_empty_and_single(spark):
    assert found(snapshot_changes(rows(spark, []), "slug")) == []
    assert found(snapshot_changes(rows(spark, [(7, 1, "a", "x", None)]), "slug")) == []


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = [(s, 1, f"k{k}", rng.choice(["a", "b", None, "c  d"]), None) for s in (2, 3, 7) for k in range(60) if rng.random() < 0.7]
    by = {s: {k: t.replace("  ", " ") if t else t for n, _, k, t, _ in data if n == s} for s in (2, 3, 7)}
    want = []
    for a, b in ((2, 3), (3, 7)):
        for k in by[a].keys() | by[b].keys():
            if k not in by[a]:
                want.append((b, k, "added"))
            elif k not in by[b]:
                want.append((b, k, "removed"))
            elif by[a][k] != by[b][k]:
                want.append((b, k, "changed"))
    assert found(snapshot_changes(rows(spark, data * 3), "slug")) == sorted(want)
