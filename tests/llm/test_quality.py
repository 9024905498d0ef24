import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality, queries


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def base(t):
    t, w = t or "", words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    runs = {}
    for i in range(len(w) - 2):
        runs.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for x in runs.values() if len(x) > 1 for i in x for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def signals(t):
    n, chars, symbols, dup, rep, _ = base(t)
    lines = sum(bool(words(x)) for x in (t or "").split("\n"))
    upper = sum(c.isupper() for c in t or "")
    return {"symbols": min(100, 100 * symbols // max(n, 1)), "dup_lines": 100 * dup // max(lines, 1), "repeats": 100 * rep // max(n, 1), "capitals": 100 * upper // max(chars, 1), "long_words": min(100, 5 * chars // max(n, 1))}


def cdf(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))


def halves(spark, ids):
    """The doc_ids of the holdout."""
    return {r.d for r in spark.createDataFrame([(d,) for d in ids], "d long").where(F.pmod(F.xxhash64("d"), F.lit(2)) == 1).collect()}


def brute(spark, rows, labels, risk=quality.RISK, alpha=quality.ALPHA):
    best = {}
    for d, q in labels:
        if d is not None and q is not None:
            best[d] = max(q, best.get(d, q))
    holdout = halves(spark, best)
    seen = {}
    for d, t, lang in rows:
        if d in best and not base(t)[5]:
            seen.setdefault(lang or "", []).append((d in holdout, best[d] >= 1, signals(t)))
    cut = {}
    for stratum, x in seen.items():
        found = []
        for name in quality.SIGNALS:
            gains = [(sum(1 if not good else -quality.GOOD_WEIGHT for h, good, v in x if not h and v[name] >= c), c) for c in range(1, quality.STEPS + 1)]
            if max(gains)[0] > 0:
                found.append((-max(gains)[0], name, max(gains)[1]))
        for j, rule in enumerate(sorted(found)):
            good = [v for h, ok, v in x if h and ok]
            k = sum(any(v[name] >= c for _, name, c in sorted(found)[: j + 1]) for v in good)
            if not good or k >= len(good) * risk or cdf(k, len(good), risk) > alpha / len(seen):
                break
            cut[stratum, rule[1]] = rule[2]
    out = []
    for d, t, lang in rows:
        b = base(t)
        by = [k for k, v in signals(t).items() if v >= cut.get((lang or "", k), 1000)]
        out.append((d, *b, not b[5] and not by))
    return sorted(out, key=str), cut


def got(df):
    return sorted([tuple(r)[:-1] for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()]
    assert got(queries.op4_quality_rules(spark, sf_dir)) == brute(spark, rows, labels)[0]


def test_cutoffs_are_certified_and_used(spark, monkeypatch):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [r.choice("abcdefgh") * r.randint(1, 3) + str(r.randrange(10**6)) + ("$$" if bad and r.random() < 0.8 else "") for _ in range(r.randint(45, 80))]
        rows.append((i, " ".join(w), "en" if i % 3 else None))
        labels.append((i, 0 if bad else 1))
    rows += [(None, "x y z " * 40, "en"), (7, None, "en"), (8, "", "de"), (9, "a\nb\n\na\n \na", "de"), (10, "one two\x0bthree " * 3000, "de"), (11, "É" * 70, "fr")]
    labels += [(0, None), (None, 1), (6, 1), (6, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("w", F.lit(1)).withColumn("lines", F.lit("k"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    want, cut = brute(spark, rows, labels)
    assert ("en", "symbols") in cut
    assert got(quality.report(df, lab)) == want
    kept = sorted((r.doc_id for r in quality.keep(df, lab).collect()), key=str)
    assert kept == sorted((x[0] for x in want if x[-1]), key=str)
    monkeypatch.setattr(quality, "BROADCAST", 0)  # strata in parts
    assert got(quality.report(df, lab)) == want
    monkeypatch.undo()
    assert quality.report(df.limit(0), lab).collect() == []
    assert got(quality.report(df, lab.limit(0))) == brute(spark, rows, [])[0]


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.2), (3, 500, 0.01), (40, 5000, 0.01), (9500, 1_000_000, 0.01), (0, 1, 0.5)])
def test_binomial(spark, k, n, p):
    x = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert x == pytest.approx(cdf(k, n, p), rel=1e-9)


def test_helper_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "w " * 60, "en", 5, "s", "t"), (2, " ".join(f"w{i}" for i in range(60)), None, 6, None, "u")], "doc_id int, text string, lang string, __th int, stratum string, text_key string")
    out = quality.keep(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [tuple(df.collect()[1])]


def test_cutoffs_hold_on_the_tables_given(spark):
    """On documents of sf0.1: a stratum has a certified rule, and documents that were not labelled for it lose no more good ones than the risk allows."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.measure(docs).cache()
    some = labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) < 3)
    cutoffs = {r.stratum: r.cutoffs for r in quality.thresholds(measured, some).collect()}
    assert cutoffs and all(c for c in cutoffs.values())
    rest = measured.where("not base_failed").join(labels.where((F.pmod(F.hash("doc_id"), F.lit(4)) == 3) & (F.col("quality") >= 1)).select("doc_id"), "doc_id").selectExpr("stratum", *[f"{v} as {k}" for k, v in quality.SIGNALS.items()]).collect()
    for stratum, c in cutoffs.items():
        good = [r for r in rest if r.stratum == stratum]
        lost = sum(any(r[k] >= v for k, v in c.items()) for r in good)
        assert lost <= 0.05 * len(good) + 3 * math.sqrt(0.05 * 0.95 * len(good)), (stratum, c, lost, len(good))
    measured.unpersist()
