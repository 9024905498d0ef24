import hashlib
import random

import numpy as np

from quillspark.llm import queries, substring


def brute(rows, size=50):
    first = {}
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = set()
        if d is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < d:
                    gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.report(df, **k).collect()), key=str) == brute(rows, k.get("min_words", 50))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op3_substring_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    assert any(r[2] for r in got)


def test_planted_passages_ties_nulls(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(70)]
    rows = [(None, " ".join(passage)), (5, None), (6, ""), (7, " \n\t "), (8, "a b c"), (8, "a b c")]
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            at = r.randint(0, len(w))
            a = r.randint(0, 15)
            w[at:at] = passage[a : a + r.randint(40, 60)]
        rows.append((100 - i, r.choice([" ", "\n", "\x0b "]).join(w)))
    rows += [rows[-1], rows[-3], (3, rows[-5][1]), (1000, "x " * 5000), (1001, "x " * 300), (1002, "x " * 60)]
    check(spark, rows)
    check(spark, rows, min_words=20)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, th int, starts string, first_copy int")
    assert substring.report(df).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 9, "s", 4), (2, "lead " + long, 9, None, 4), (3, "free\n\ntext", 1, "k", 2), (4, long, 0, "", 0)], df.schema)
    out = {r.doc_id: r for r in substring.dedup(df).collect()}
    assert [out[i].text for i in (1, 2, 3, 4)] == [long, "lead", "free\n\ntext", ""]
    assert substring.dedup(df).columns == df.columns and out[2].th == 9
    df = spark.createDataFrame([(1, long, 9, "s", 4), (2, "lead " + long, 9, None, 4)], "doc_id int, text string, __text string, of_doc string, _of_doc int")
    assert [(r.doc_id, r.text, r["__text"], r.of_doc) for r in substring.dedup(df).orderBy("doc_id").collect()] == [(1, long, "9", "s"), (2, "lead", "9", None)]


def thue_morse(n):
    """Equal sums of powers, modulo 2 ** 64, for a sequence and its opposite of 1024 letters."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


def test_words_that_power_sums_confuse(spark):
    x, y = thue_morse(1024)
    rest = [f"w{i}" for i in range(60)]
    check(spark, [(1, " ".join([*rest, x, *rest])), (2, " ".join([y, *["v"] * 3, y])), (3, " ".join([x] * 50)), (4, " ".join([y] * 50)), (5, " ".join([*rest[30:], y, *rest[:19]]))])
    a, b = (" ".join("zero" if c == "a" else "one" for c in w) for w in (x, y))
    check(spark, [(1, a), (2, b), (3, a[: len(a) // 2]), (4, "end " + b[: len(b) // 3])])


def test_large_groups_become_leaves(spark, monkeypatch):
    r = random.Random(8)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = [f"w{r.randrange(500)}" for _ in range(r.randint(0, 60))]
        at, a = r.randint(0, len(w)), r.randint(0, 30)
        w[at:at] = passage[a : a + r.randint(45, 60)]
        rows.append((r.randint(0, 200), " ".join(w)))
    # Repeats inside one document, and of its own repeats elsewhere.
    rows += [(300, "z " * 200), (301, "y " * 90 + "z " * 60), (299, " ".join(passage * 3)), (5, " ".join(passage[20:80] * 2))]
    for limit in (1, 3, 40, 1000):
        monkeypatch.setattr(substring, "GROUP_ROWS", limit)
        check(spark, rows)


def test_runs_have_exact_numbers():
    from quillspark.llm.common import run_ids

    ids = np.array([random.Random(5).randrange(3) for _ in range(400)])
    for size in (1, 2, 3, 5, 7, 8, 50):
        got = run_ids(ids, size)
        assert len(got) == 400 - size + 1
        assert len(set(zip(got.tolist(), (tuple(ids[i : i + size]) for i in range(400 - size + 1))))) == len(set(got.tolist())) == len({tuple(ids[i : i + size]) for i in range(400 - size + 1)})
