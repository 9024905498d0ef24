import hashlib
import re

from quillspark.llm import queries, spotsigs


def sigs(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    out, common = set(), set(spotsigs.ANCHORS)
    for i, x in enumerate(w):
        c = [y for y in w[i + 1 : i + 1 + spotsigs.REACH] if y not in common]
        if x in common and len(c) >= spotsigs.CHAIN:
            out.add((x, *c[: spotsigs.CHAIN]))
    return out or {(x,) for x in w}


def like(a, b):
    return len(a & b) / len(a | b) if a and b else float(a == b)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows if d is not None), key=lambda r: (-r[0], r[1])) + [(d, t or "") for d, t in rows if d is None]
    ring = [r for r in rows if r[0] is not None]
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = "" if d is None else ring[(i + 1) % len(ring)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(sigs(t), sigs(e)), 9), round(like(sigs(t), sigs(nxt)), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op8_spotsigs(spark, sf_dir).cache()
    assert got(df) == brute(rows)
    by_text = dict(rows)
    prints = {}
    for r in df.collect():
        assert prints.setdefault(by_text[r.doc_id], r.fingerprint) == r.fingerprint
    df.unpersist()


def test_edge_cases(spark):
    rows = [(None, "the big red dog"), (None, None), (1, ""), (5, "   "), (5, "the quick brown fox"), (5, "the quick brown fox"), (10**12, "é der große Hund " * 50), (-3, "no spots"), (7, "a the of and"), (8, "the x y " * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spotsigs.report(df)) == brute(rows)
    wide = [(9223372036854775807, "the red fox jumps"), (-9223372036854775808, "a blue dog sleeps"), (0, "in the green house now"), (9223372036854775806, "on the old road home")]
    assert got(spotsigs.report(spark.createDataFrame(wide, df.schema))) == brute(wide)
    one = spark.createDataFrame([(4, "the only one here")], df.schema)
    assert got(spotsigs.report(one)) == brute([(4, "the only one here")])
    assert spotsigs.report(df.limit(0)).collect() == []


def test_helper_columns_may_clash(spark):
    rows = [(i, f"the red fox {i} of a green house {i % 3}") for i in range(6)]
    wide = spark.createDataFrame([(d, t, "x", 1, True, "y", 2) for d, t in rows], "doc_id int, text string, part string, sigs int, guest boolean, EDIT string, n int")
    assert got(spotsigs.report(wide)) == brute(rows)


def test_join_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    member, pairs = spotsigs.join(spark.createDataFrame(rows), 0.5)
    of = {r.doc_id: r["class"] for r in member.collect()}
    found = {frozenset((r.a, r.b)) for r in pairs.collect()}
    want = set()
    sets = {of[r.doc_id]: sigs(r.text) for r in rows}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and like(sets[a], sets[b]) >= 0.5:
                want.add(frozenset((a, b)))
    assert found == want and want


def test_ranges_are_in_order(spark):
    ids = spark.createDataFrame([(x,) for x in [*range(-500, 500, 7), -(1 << 63), (1 << 63) - 1, *range(10**12, 10**12 + 300)]], "doc_id long")
    dealt = ids.withColumn("part", spotsigs.range_part(ids, 16)).orderBy("doc_id")
    assert "from_json" not in dealt._jdf.queryExecution().optimizedPlan().toString().lower()  # one constant
    parts = [r.part for r in dealt.collect()]
    assert parts == sorted(parts) and 10 < len(set(parts)) <= 16
