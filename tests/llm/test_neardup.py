import random

import numpy as np
import pytest

from quillspark.llm import neardup, queries


def shingles(text, width=5):
    w = bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted([(d, len(sets[i]), low.get(root(i)), d == low.get(root(i))) for i, (d, _) in enumerate(rows)], key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.report(df).collect()), key=str) == brute(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op5_minhash_neardup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    assert any(not r[3] for r in got)


def test_words_that_power_sums_confuse(spark):
    from test_substring import thue_morse

    x, y = thue_morse(1024)
    check(spark, [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} {x}"), (5, f"{x} b c d e f g h"), (6, f"{y} b c d e f g h"), (7, x)])


def test_confirmation_is_by_words(spark, monkeypatch):
    import pyarrow as pa

    texts = ["a b c d e f", "A b c d e f g", "", None, "one two", "One two", "x " * 9, "x " * 40, "u v w"]
    n = len(texts)
    mine, theirs = (np.array(x) for x in zip(*[(i, j) for i in range(n) for j in range(n)]))
    got = list(zip(*(v.tolist() for v in neardup._overlaps(pa.array(texts, pa.string()), mine, theirs, 5))))
    assert got == [(len(shingles(texts[i])), len(shingles(texts[j])), len(shingles(texts[i]) & shingles(texts[j]))) for i, j in zip(mine, theirs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_chains_ties_nulls(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    rows = [(None, None), (None, "only words"), (9, ""), (10, " \t"), (11, "One two"), (12, "one TWO"), (12, "one TWO")]
    for f in range(12):
        base = [word() for _ in range(r.randint(40, 160))]
        for _ in range(r.randint(1, 8)):
            if r.random() < 0.5:  # chains: the next is made from the last
                base = list(base)
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((r.randint(0, 500), r.choice([" ", "\n"]).join(w)))
            if r.random() < 0.5:
                base = w
    rows += [rows[-1], (None, rows[-2][1]), (700, " ".join(rows[-3][1].split() * 2)), (701, "long " * 20000)]
    check(spark, rows)


def test_many_pairs_in_buckets_get_pivots(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DIRECT", 5)
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


@pytest.mark.parametrize("members,direct", [(1024, 4096), (7, 4096), (4, 20)])
def test_open_members_in_blocks(spark, monkeypatch, members, direct):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "DIRECT", direct)
    monkeypatch.setattr(neardup, "SALT", 2)
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # most are about as far from the base as the threshold, and farther from each other
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[10 * i][1] + " y" * i) for i in range(1, 5)]
    assert len({x[2] for x in brute(rows)}) > 10
    check(spark, rows)


def test_components_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TASK_EDGES", 15)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 20)] + [(100 + r.randrange(20), 100 + r.randrange(20)) for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    r.shuffle(edges)
    up = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = neardup.components(neardup.table(spark.createDataFrame(edges, "c long, p long").repartition(5), "edges"))
    assert {tuple(x) for x in got.collect()} == set(up.items())


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, c string, th int, n_shingles int")
    assert neardup.report(df).collect() == []
    extra = spark.createDataFrame([(2, "a b c d e f g", 5, "x"), (1, "a b c d e f g", 6, "y")], "doc_id int, text string, __th int, of_doc string")
    assert [tuple(r) for r in neardup.dedup(extra).collect()] == [(1, "a b c d e f g", 6, "y")]
    df = spark.createDataFrame([(2, "a b c d e f g", "x", 1, 1), (1, "a b c d e f g", "y", 2, 2), (3, "other", None, 3, 3), (3, "other", None, 3, 3)], df.schema)
    out = neardup.dedup(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [1, 3, 3]
