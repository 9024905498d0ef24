import corpus_pipeline
from pyspark.sql import functions as F

from test_neardup import brute as near_brute
from test_quality import brute as quality_brute
from test_tokens import verify


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(x[0] for x in quality_brute(spark, rows, labels)[0] if x[-1])
    two = corpus_pipeline.minhash_neardup(spark, one, sf_dir).cache()
    want = [x[0] for x in near_brute([(r.doc_id, r.text) for r in one.collect()], 80) if x[3]]
    assert sorted(r.doc_id for r in two.collect()) == sorted(want) and two.columns == docs.columns
    three = corpus_pipeline.substring_dedup(spark, two, sf_dir).cache()
    assert three.columns == docs.columns and three.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    before = sorted((r.doc_id, r.text) for r in two.collect())
    first = {}
    for d, t in before:
        w = t.encode().split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    after = {r.doc_id: r for r in three.collect()}
    assert len(after) == len(before)
    for d, t in before:
        w = t.encode().split()
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t
        assert after[d].text == text and after[d].n_chars == len(text)
    four = corpus_pipeline.best_fit_packing(spark, three, sf_dir)
    verify([tuple(r) for r in four.collect()], 2048, [(r.doc_id, r.text) for r in three.collect()])


def test_near_copies_from_080_to_085_are_linked(spark, sf_dir):
    words = [f"w{i}" for i in range(100)]
    # Three words changed far from one another: 81 of 111 shingles (0.73); two: 86 of 106 (0.81).
    copies = [" ".join("x" if i in at else w for i, w in enumerate(words)) for at in ((), (30, 60), (20, 50, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(copies)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.minhash_neardup(spark, docs, sf_dir).collect()) == [0, 2]


def test_near_dedup_stage_equals_brute_force_at_080(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [x[0] for x in near_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 80) if x[3]]
    assert sorted(r.doc_id for r in corpus_pipeline.minhash_neardup(spark, docs, sf_dir).collect()) == sorted(want)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_neardup", "substring_dedup", "best_fit_packing"]


def test_edge_rows_go_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls in any column, empty and long texts, ties and repeated rows, columns with clashing names, an empty table."""
    words = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    rows = [
        (None, words(60, "a"), "en", "s", 1, 5, "x"), (1, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "y"), (3, words(60, "b"), "en", None, 7, 2, "z"), (3, words(60, "b"), "en", None, 7, 2, "z"),
        (4, words(60, "b") + " tail", None, "s", 3, None, None), (5, words(30_000, "c"), "de", "s", 9, 3, "w"), (5, words(70, "d"), "de", "s", 9, 3, "w"), (6, words(55, "e") + " " + words(60, "b"), "en", "s", None, 0, ""),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, th long, __th string"
    docs = spark.createDataFrame(rows, names)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf_dir)
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(frame.collect(), docs.schema)
        out = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()]
        kept = sorted(((r.doc_id, r.text, r.n_chars) for r in frame.collect()), key=str)
        verify(out, 2048, [(d, t) for d, t, _ in kept])
        assert all(n == len(t) for _, t, n in kept)
        if out:
            # Equal rows stay or go together; near copies of 3 go; what 6 has of 3 is cut; the rest stays as it is.
            assert kept == sorted([(None, words(60, "a"), len(words(60, "a"))), (3, words(60, "b"), len(words(60, "b"))), (3, words(60, "b"), len(words(60, "b"))), (5, words(30_000, "c"), len(words(30_000, "c"))), (5, words(70, "d"), len(words(70, "d"))), (6, words(55, "e"), len(words(55, "e")))], key=str)
