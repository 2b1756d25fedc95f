import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.packing import pack, plan_containers, token_counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=300))
def test_plan_places_every_item_once(sizes):
    lengths, counts = np.unique(sizes, return_counts=True)
    runs = plan_containers(lengths, counts, 50)
    used = {}
    for length, first, n, per, container, times in runs:
        assert n == per * times and first == used.get(length, 0)
        used[length] = first + n
    assert used == dict(zip(lengths.tolist(), counts.tolist()))
    fill = {}
    for length, _, _, per, container, times in runs:
        for c in range(container, container + times):
            fill[c] = fill.get(c, 0) + per * length
    assert max(fill.values()) <= 50 and len(fill) <= max(1, 2 * -(-sum(sizes) // 50))


def test_pack(spark):
    sizes = [(k, n) for k, n in enumerate([0, 0, 3, 10, 10, 25, 7, 4, 6, 1, 30])] + [(99, None), (None, 3)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    caps = spark.createDataFrame([(1, 10), (2, 64), (3, 0)], "capacity_id int, capacity_tokens int")
    got = pack(df, caps).toPandas()
    for cap, room in ((1, 10), (2, 64)):
        part = got[got.capacity_id == cap]
        assert part.groupby("container_id").n_tokens.sum().max() <= room
        assert part.groupby("doc_id").n_tokens.sum().to_dict() == {k: n for k, n in sizes if k is not None and n is not None}
        cut = part.groupby("doc_id").size()
        assert all(cut[k] == max(1, -(-n // room)) for k, n in sizes if k is not None and n is not None)
        assert part.container_id.nunique() == -(-96 // room)
    assert pack(df.limit(0), caps).count() == 0


def test_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.packing.PER_BUCKET", 300)  # many buckets, many blocks
    df = spark.range(5000).selectExpr("id as doc_id", "7 as n_tokens")
    caps = spark.createDataFrame([(1, 21)], "capacity_id int, capacity_tokens int")
    got = pack(df, caps).groupBy("container_id").sum("n_tokens").toPandas()
    assert len(got) == -(-5000 // 3) and got["sum(n_tokens)"].max() == 21
    long = spark.range(2000).selectExpr("id as doc_id", "cast(30 + id % 40 as int) as n_tokens")
    part = pack(long, caps).toPandas()
    assert part.groupby("container_id").n_tokens.sum().max() <= 21
    assert part.groupby("doc_id").n_tokens.sum().to_dict() == {k: 30 + k % 40 for k in range(2000)}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0}
