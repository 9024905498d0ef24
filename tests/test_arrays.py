import gzip
import json
import random

import pytest

from pyspark.sql import functions as F

from quillspark.sources import arrays, readers, writers

HARD = [{"a": "} , ] [ { \" \\ \\\\"}, {}, {"b": [{"c": {"d": "\\"}}, [[{}]]], "é": "漢 }"}, {"s": "\"}\"", "t": "\\\"}"}, {"long": "x}" * 300}, {"n": [1, 2.5, None, True]}]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def told(spark, folder):
    found, files = arrays.elements(spark, [f"{folder}/*.json"])
    name = lambda p: p.rsplit("/", 1)[1]
    by = {name(r.path): [] for r in files.collect() if r.good}
    for r in sorted(found.collect()):
        by[name(r.path)].append((r.pos, json.loads(r.json)))
    assert all([p for p, _ in v] == list(range(len(v))) for v in by.values())
    return {k: [x for _, x in v] for k, v in by.items()}, sorted(name(r.path) for r in files.collect() if not r.good)


def test_ranges_cut_strings_escapes_and_elements(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    want = {}
    for i, (indent, n) in enumerate([(None, 40), (2, 25), (None, 1), (0, 30)]):
        want[f"f{i}.json"] = [rng.choice(HARD) for _ in range(n)]
        (tmp_path / f"f{i}.json").write_text(json.dumps(want[f"f{i}.json"], indent=indent, ensure_ascii=bool(i % 2)) + "\n" * (i % 2))
    (tmp_path / "none.json").write_text(" [ ]\n")
    want["none.json"] = []
    bad = {"open.json": '[{"a": 1}', "two.json": '[{"a": 1}]]', "comma.json": '[{"a": 1} {"b": 2}]', "twice.json": '[{"a": 1},,{"b": 2}]', "end.json": '[{"a": 1},]', "begin.json": '[,{"a": 1}]', "object.json": '{"a": 1}', "mixed.json": '[1, {"a": 1}]', "string.json": '[{"a": "}]', "value.json": '[{"a": }]', "numbers.json": "[1, 2]", "after.json": '[{"a": 1}] x', "key.json": "[{a: 1}]", "nested.json": '[[{"a": 1}]]'}
    for k, v in bad.items():
        (tmp_path / k).write_text(v)
    got, broken = told(spark, tmp_path)
    assert got == want and broken == sorted(bad)


def test_one_file_is_the_work_of_many_tasks(spark, tmp_path, small_ranges):
    rows = [{"id": i, "text": "}{" * (i % 7)} for i in range(300)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    assert arrays._fragments(spark, [str(tmp_path)]).rdd.getNumPartitions() > 10
    assert told(spark, tmp_path) == ({"one.json": rows}, [])


def test_exports_without_text_are_unreadable(spark, tmp_path):
    (tmp_path / "a b.json").write_text(json.dumps([{"id": 3, "annotations": []}, {"id": 4}]))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]")
    tasks, bad = readers.exports(spark, [f"{tmp_path}/*.json", f"{tmp_path}/gone"])
    assert [(r.file_no, r.pos, r.task.id) for r in sorted(tasks.select("file_no", "pos", "task.id", "task").collect())] == [(0, 0, "3"), (0, 1, "4")]
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad.collect()) == ["empty.json", "gone"]


def test_release_as_one_document(spark, tmp_path, small_ranges):
    rows = [(f"H{i:02d}_000{i % 7}", "H01", "A", "x.jpg", i, None, "overview", 'k"}[', [], [{"qa_id": f"q{i}", "type": "count", "question": "}", "answer": "\\"}]) for i in range(60)]
    df = spark.createDataFrame(rows, readers.vocab.RELEASE).withColumn("_hidden", F.lit(1)).repartition(7)
    writers.document(df, f"{tmp_path}/release.json")
    told_ = json.loads((tmp_path / "release.json").read_text())
    assert [r["image_id"] for r in told_] == sorted(r[0] for r in rows) and "_hidden" not in told_[0] and told_[0]["image_h"] is None
    back = readers.records(spark, f"{tmp_path}/release.json")
    assert sorted(back.collect(), key=str) == sorted(df.drop("_hidden").collect(), key=str)
    writers.document(df.limit(0), f"{tmp_path}/release.json")
    assert (tmp_path / "release.json").read_text() == "[]\n" and readers.records(spark, f"{tmp_path}/release.json").collect() == []
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["release.json"]
    (tmp_path / "one.json").write_text('{"image_id": "H01_0001"}')
    assert [r.image_id for r in readers.records(spark, f"{tmp_path}/one.json").collect()] == ["H01_0001"]


@pytest.mark.parametrize("separator", ["}", "\n"])
def test_packed_files_are_held_to_the_same_rules(spark, tmp_path, separator):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # elements that batches break off in
    want, bad = {"none.json.gz": []}, {"open": '[{"a": 1}', "two": '[{"a": 1}]]', "comma": '[{"a": 1} {"b": 2}]', "twice": '[{"a": 1},,{"b": 2}]', "end": '[{"a": 1},]', "object": '{"a": 1}', "mixed": '[1, {"a": 1}]', "string": '[{"a": "}]', "value": '[{"a": }]', "after": '[{"a": 1}] x', "nested": '[[{"a": 1}]]'}
    for i, indent in enumerate((None, 2)):
        want[f"f{i}.json.gz"] = HARD * (1 + i)
        (tmp_path / f"f{i}.json.gz").write_bytes(gzip.compress(json.dumps(want[f"f{i}.json.gz"], indent=indent, ensure_ascii=False).encode()))
    (tmp_path / "none.json.gz").write_bytes(gzip.compress(b" [ ]\n"))
    for k, v in bad.items():
        (tmp_path / f"{k}.json.gz").write_bytes(gzip.compress(v.encode()))
    found, files = arrays.elements(spark, [f"{tmp_path}/*.json.gz"], separator=separator)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    name = lambda p: p.rsplit("/", 1)[1]
    got = {name(r.path): [] for r in files.collect() if r.good}
    for r in sorted(found.collect()):
        got[name(r.path)].append(json.loads(r.json))
    assert got == want and sorted(name(r.path) for r in files.collect() if not r.good) == sorted(f"{k}.json.gz" for k in bad)


def test_parts_of_a_document_are_packed_and_go_when_copied(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    staged = tmp_path / "staged"
    monkeypatch.setattr(writers.scratch, "folder", lambda *a: str(staged))
    seen = []
    monkeypatch.setattr(writers.scratch, "freed", lambda s, f=writers.scratch.freed: seen.append(1) or f(s))
    writers.document(spark.range(9).selectExpr("cast(id as string) image_id").repartition(3), f"{tmp_path}/r.json")
    assert [r["image_id"] for r in json.loads((tmp_path / "r.json").read_text())] == [str(i) for i in range(9)]
    assert seen and not staged.exists() and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
