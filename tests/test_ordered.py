import random

import pytest

from quillspark.operators import items, ordered, runs, shuffled


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n,block", [(0, 8), (1, 8), (2, 8), (3, 1), (10, 4), (1000, 64), (1000, 1 << 20)])
def test_permutation_equals_the_shuffle(spark, monkeypatch, n, block):
    monkeypatch.setattr(shuffled, "BLOCK", block)
    for seed in (42, 7):
        want = list(range(n))
        random.Random(seed).shuffle(want)
        assert [r.pos for r in sorted(shuffled.permutation(spark, n, seed).collect())] == want


def test_rank_by_shuffle(spark):
    rows = [(f"H{i % 50:02d}", f"q{i}", "t" if i % 3 else None, i) for i in range(300)]
    got = items.rank_by_shuffle(spark.createDataFrame(rows, "image_id string, qa_id string, qa_type string, x int").repartition(7)).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    places = list(range(300))
    random.Random(42).shuffle(places)
    assert sorted(tuple(r) for r in got) == [(k, *order[p]) for k, p in enumerate(places)]


def test_places_of_a_hot_key(spark):
    rows = [("a", i % 90, i) for i in range(500)] + [("b", 1, 0), (None, None, 1), (None, 2, 3)] + [("c", 5, 5)] * 60
    at = ordered.placed(spark.createDataFrame(rows, "k string, o int, x int").repartition(4), ["k"], ["o"])
    out = at.collect()
    assert len(out) == len(rows) and len({r._part for r in out if r.k == "a"}) > 1 and len({r._part for r in out if r.k == "c"}) > 0
    for k in ("a", "b", "c", None):
        mine = sorted((r for r in out if r.k == k), key=lambda r: r._pos)
        assert [r._pos for r in mine] == list(range(len(mine))) and {r._size for r in mine} == {len(mine)}
        assert [(r.o is not None, r.o or 0) for r in mine] == sorted((o is not None, o or 0) for x, o, _ in rows if x == k)


@pytest.mark.parametrize("share", [0.1, 0.5, 0.97, 1.0])
def test_runs_of_one_model_over_many_ranges(spark, share):
    rng = random.Random(share)
    rows = [("m", i, rng.random() < share) for i in range(800)] + [("n", i, None if i % 2 else True) for i in range(5)] + [(None, 1, True)]
    df = spark.createDataFrame(rows, "model_id string, at int, failed boolean").repartition(5)
    want, open_ = [], None
    for m, i, f in rows:
        if f and open_ and open_[0] == m and open_[2] == i - 1:
            open_ = (m, open_[1], i, open_[3] + 1)
            want[-1] = open_
        elif f:
            open_ = (m, i, i, 1)
            want.append(open_)
    got = sorted(map(tuple, runs.error_runs(df, "at", "failed").collect()), key=str)
    assert got == sorted(want, key=str)
    assert ordered.islands(df.limit(0), ["model_id"], "at", "failed").collect() == []


def test_latency_of_ties(spark):
    rows = [("a", 1, 2.0)] * 6 + [("b", i // 3, float(i)) for i in range(9)] + [(None, i, 1.0 * i) for i in range(5)] + [("d", 1, 7.0)]
    out = {r.k: (r.n, r.mean_s, r.warm_mean_s) for r in runs.latency(spark.createDataFrame(rows, "k string, at int, latency_s double"), ["k"], ["at"]).collect()}
    assert out == {"a": (6, 2.0, 2.0), "b": (9, 4.0, 5.5), None: (5, 2.0, 3.5), "d": (1, 7.0, 7.0)}
