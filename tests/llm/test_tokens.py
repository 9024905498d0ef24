import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import queries, tokens


def ids_of(texts):
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", None, " \n ", "don't I'LL we've", "a<|endoftext|>b <|startoftext|>", "ÉCOLE café é  x y ́z", "İstanbul ΣΑΣ", "日本語 テスト", "1234 5,678.90!!", "a\x1cb\x85c", "word " * 3000, "​‍ 😀👩‍👩‍👧"]


def test_encoder_equals_library(spark):
    e = tokens.Encoder(tokens.default_vocabulary())
    r = random.Random(1)
    texts = [x or "" for x in ODD] + ["".join(r.choice(" \n\tabcXYZ'1é́!.<|> ß") for _ in range(200)) for _ in range(200)]
    for got, want in zip([x for _, some in e.texts(pa.array(texts)) for x in some], ids_of(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want


def test_files_equal_library(spark, sf_dir):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for (d, _), x in zip(rows, ids_of([t for _, t in rows])):
        want.append((d, at, len(x) + 1, crc([*x, 1])))
        at += len(x) + 1
    assert sorted(map(tuple, queries.op6_token_files(spark, sf_dir).collect())) == want


def test_files_of_odd_rows(spark, tmp_path):
    rows = [(d, t) for d, t in zip([5, 3, 9, None, -2, 7, 7, 8, 100, 101, 102, 103], ODD)] + [(7, ODD[6])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, start int")
    tokens.write_ids(df, str(tmp_path / "f"))
    reader = tokens.Reader(spark, str(tmp_path / "f"))
    got = sorted((tuple(r) for r in reader.index().collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    want = sorted(((d, len(x) + 1, crc([*x, 1])) for (d, _), x in zip(rows, ids_of([t for _, t in rows]))), key=str)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == want
    some = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in reader.documents(only=[9, 103]).collect()}
    assert some == {9: [1], 103: [*ids_of([ODD[11]])[0], 1]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert "GreaterThanOrEqual(last_doc,9)" in reader.documents(only=[9, 103])._jdf.queryExecution().toString()
    tokens.write_ids(df.limit(0), str(tmp_path / "e"))
    assert tokens.Reader(spark, str(tmp_path / "e")).index().collect() == []


def verify(rows, capacity, texts):
    ids = {}
    for (d, _), x in zip(texts, ids_of([t for _, t in texts])):
        ids.setdefault(d, []).append([*x, 0])
    pieces = sorted(((d, p, s, n, c) for d, p, s, n, c, _, _ in rows), key=str)
    want = sorted(((d, k, k * capacity, len(x[k * capacity : (k + 1) * capacity]), crc(x[k * capacity : (k + 1) * capacity])) for d, xs in ids.items() for x in xs for k in range(-(-len(x) // capacity))), key=str)
    assert pieces == want
    bins = {}
    for _, _, _, n, _, s, o in rows:
        bins.setdefault(s, []).append((o, n))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(n for _, _, _, n, _, _, _ in rows)


def test_packing_query(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, total = verify([tuple(r) for r in queries.op10_best_fit_packing(spark, sf_dir).collect()], 2048, texts)
    assert n <= -(-total // 2048) + 1


def test_packing_of_odd_rows(spark):
    texts = list(zip([5, 3, 9, 4, -2, 7, 7, 8, 100, 101, 102, 103], ODD))
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, number int")
    verify([tuple(r) for r in tokens.pack(df, 64).collect()], 64, texts)
    assert tokens.pack(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=40))
def test_plan_uses_every_piece_once(counts):
    out, used = tokens.plan(counts, 60), {}
    for lengths, times in out:
        assert sum(lengths) <= 60 and times > 0
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == {n: c for n, c in counts.items() if c}
    # No two sequences could be one, so at most one of them is half full or less.
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in out) <= 2 * total / 60 + 1


def test_plan_fills_exactly():
    assert tokens.plan({7: 3, 3: 3}, 10) == [((7, 3), 3)]
    assert [(sorted(p), n) for p, n in tokens.plan({5: 1, 2: 2, 1: 1}, 10)] == [([1, 2, 2, 5], 1)]
    with pytest.raises(ValueError):
        tokens.plan({11: 1}, 10)


def test_damaged_files_and_other_dictionaries_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(5)], "doc_id long, text string")
    tokens.write_ids(df, str(tmp_path / "a"))
    tokens.write_ids(df.withColumn("text", F.concat("text", F.lit(" and more"))), str(tmp_path / "b"))
    mixed = tokens.Reader(spark, str(tmp_path / "a"))
    mixed.segments = tokens.Reader(spark, str(tmp_path / "b")).segments
    with pytest.raises(Exception, match="another dictionary"):
        mixed.documents().collect()
    short = tokens.Reader(spark, str(tmp_path / "a"))
    short.segments = short.segments.withColumn("lengths", F.transform("lengths", lambda n: n + 1))
    with pytest.raises(Exception, match="the index has"):
        short.documents().collect()
    spark.createDataFrame([("0" * 64, bytearray(8))], "dictionary_sha256 string, dictionary binary").write.mode("overwrite").parquet(str(tmp_path / "a/dictionary"))
    with pytest.raises(ValueError, match="its hash"):
        tokens.Reader(spark, str(tmp_path / "a"))


def test_other_vocabularies_are_refused(tmp_path):
    import json

    made = json.load(open(tokens.default_vocabulary(), encoding="utf-8"))
    made["normalizer"]["normalizers"].pop()
    (tmp_path / "v.json").write_text(json.dumps(made))
    with pytest.raises(ValueError, match="another normalizer"):
        tokens.Encoder(str(tmp_path / "v.json"))


def test_cache_generations_and_long_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    monkeypatch.setattr(tokens, "TEXT_BYTES", 64)
    e = tokens.Encoder(tokens.default_vocabulary())
    texts = [f"日本{i % 7} テスト{i} {'長' * (i % 50)} plain{i}" for i in range(60)] * 2
    got = [np.frombuffer(x, "<u4").tolist() for _, some in e.texts(pa.array(texts)) for x in some]
    assert got == ids_of(texts) and len(e.known) + len(e.before) < 60
