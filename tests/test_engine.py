import io
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import vocab
from quillspark.functions import nested
from quillspark.operators import audit, images, items, runs, stats, validate
from quillspark.sources import readers, writers
from quillspark.streaming import resume

RECORDS = [
    {"image_id": "H01_0001", "image_file": "a/H01_0001.png", "qa_pairs": [{"type": "nope", "question": "q0"}, {"qa_type": "Scene-ID", "q": " q1 ", "gold": "a1"}, {"type": "obj_hazard", "question": "q2", "answer": 3, "qa_id": "own"}]},
    {"image_id": "H01_0002", "qa": {"count": {"q": "q3", "a": "a3"}, "spatial": "skipped", "zzz": {"q": "x"}, "assistive": {"question": "q4"}}},
    {"image_id": "H02_0003", "q_count": "q5", "a_count": "a5", "q_obj_hazard": "q6", "q_scene": "lost"},
    {"image_id": "H02_0004", "qa_type": "count", "question": "q7", "gold": "a7"},
    {"image_id": "H02_0005", "qa_pairs": []},
    {"question": "no image", "qa_type": "count"},
]
WANT = {
    ("own", "obj_property", "q2", "3"), ("H01_0001_q2", "scene_id", "q1", "a1"), ("H01_0002_q1", "count", "q3", "a3"), ("H01_0002_q4", "assistive", "q4", ""),
    ("H02_0003_q1", "count", "q5", "a5"), ("H02_0003_q2", "obj_property", "q6", ""), ("H02_0004_q1", "count", "q7", "a7"),
}


@pytest.mark.parametrize("wrap,container", [(lambda r: r, "top-level list"), (lambda r: {"x": [1], "data": r}, "data"), (lambda r: {"version": 2, "mine": r}, "mine (auto-detected)")])
def test_layouts_and_containers(spark, wrap, container):
    raw = spark.createDataFrame([(json.dumps(wrap(RECORDS)),)], "json string")
    out, records = items.build(raw)
    got = {(r.qa_id, r.qa_type, r.question, r.gold) for r in out.collect()}
    assert got == WANT
    assert {r.container for r in records.collect()} == {container}
    assert [r.layout for r in records.orderBy("pos").collect()] == ["list", "dict", "flat", "single", "none", "single"]
    files = {r.image_id: (r.image_file, r.house_id) for r in out.collect()}
    assert files["H01_0001"] == ("H01_0001.jpg", "H01") and files["H02_0003"] == ("H02_0003.jpg", "H02")
    found = sorted((r.image_id, r.problem) for r in validate.item_problems(out, records).collect())
    assert found == [("", "no image id"), ("H01_0002", "empty answer: H01_0002_q4"), ("H02_0003", "empty answer: H02_0003_q2"), ("H02_0005", "no QA")]
    assert {r.key: r.n for r in nested.schema_of(records).where("kind = 'array'").collect()} == {"qa_pairs": 2}


def ranked(spark, n=40):
    df = spark.range(n).select(F.concat(F.lit("q"), "id").alias("qa_id"), F.lit("H01_0001").alias("image_id"), F.lit("count").alias("qa_type"), F.when(F.col("id") % 4 == 0, "B").otherwise("A").alias("group"), F.concat(F.lit("word"), "id", F.lit(" x")).alias("question"), F.lit("word1").alias("gold"), F.lit("H01").alias("house_id"), F.lit("f.jpg").alias("image_file"))
    return items.rank_by_hash(df)


def test_ranks_shards_resume(spark, tmp_path):
    r = ranked(spark).cache()
    assert sorted(x.rank for x in r.collect()) == list(range(40))
    assert [x.qa_id for x in r.orderBy("rank").collect()] == [x.qa_id for x in items.rank_by_hash(r.drop("rank").repartition(7)).orderBy("rank").collect()]
    parts = [{x.qa_id for x in items.shard(r, k, 3).collect()} for k in range(3)]
    assert sum(map(len, parts)) == 40 and len(set.union(*parts)) == 40
    with pytest.raises(ValueError):
        items.shard(r, 3, 3)
    assert writers.items(r, f"{tmp_path}/items") == 40
    exact = items.rank_by_shuffle(r.drop("rank")).collect()
    import random

    order = sorted(x.qa_id for x in exact)
    random.Random(42).shuffle(order)
    assert [x.qa_id for x in sorted(exact, key=lambda x: x.rank)] == order


class Fails(runs.Answerer):
    def answer(self, item):
        if item["rank"] >= 30:
            raise RuntimeError("no")
        return item["question"].split()[0]


def test_run_append_resume(spark, tmp_path):
    o = runs.RunOptions(model_id="m", limit=10, max_consecutive_errors=3)
    r = ranked(spark).coalesce(1).cache()
    first = runs.run(runs.plan(r, None, o), Fails, o).drop("error").withColumns({"model_tag": F.lit("m"), "shard": F.lit(0)})
    writers.responses(first, f"{tmp_path}/out")
    (tmp_path / "more").mkdir()
    (tmp_path / "more/a.jsonl").write_text('{"qa_id": "q1"}\n\n{"qa_id": "q2"}\n{"qa_id": "q3", "raw')
    assert {x.qa_id for x in readers.done_ids(spark, [f"{tmp_path}/more", f"{tmp_path}/more/*.jsonl", f"{tmp_path}/none"]).collect()} == {"q1", "q2"}
    done = spark.read.schema(vocab.RESPONSES).json(f"{tmp_path}/out")
    assert done.count() == 10
    rest = runs.plan(r, done, runs.RunOptions())
    assert rest.count() == 30 and {x.rank for x in rest.collect()} == set(range(10, 40))
    out = runs.run(rest.repartition(1), Fails, o).collect()
    # twenty answers, two failures that are written, and the third that stops the run
    assert [x.raw_output for x in out][-2:] == ["", ""] and len(out) == 22
    assert runs.plan(r, spark.createDataFrame([("q0", ""), ("q1", "x")], "qa_id string, raw_output string"), runs.RunOptions(retry_empty=True)).count() == 39
    assert runs.dry_run(rest).count() == 3
    with pytest.raises(ValueError):
        runs.RunOptions(shard=2, num_shards=2)


def test_stream_resumes(spark, tmp_path):
    r = ranked(spark, 12)
    for part in (r.where("rank < 6"), r.where("rank < 12")):
        part.write.mode("append").json(f"{tmp_path}/in")
        resume.answer_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", runs.FirstWord).awaitTermination()
    out = spark.read.json(f"{tmp_path}/out")
    assert out.count() == 12 and out.select("qa_id").distinct().count() == 12


def test_latency_rules(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([9, 9, 9, 1, 3])] + [("b", i, 2.0 * i) for i in range(4)], "model_id string, i int, latency_s double")
    out = {r.model_id: (r.mean_s, r.warm_mean_s) for r in runs.latency(df, ["model_id"], ["i"]).collect()}
    assert out == {"a": (6.2, 2.0), "b": (3.0, 3.0)}


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" + b"\0" * 12


def test_headers():
    riff = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(body)) + body
    tiff = lambda o, mark: mark + struct.pack(o + "IH", 8, 2) + struct.pack(o + "HHIHH", 256, 3, 1, 640, 0) + struct.pack(o + "HHII", 257, 4, 1, 480)
    ispe = lambda w, h: struct.pack(">I", 20) + b"ispe" + struct.pack(">III", 0, w, h)
    assert images.header(riff(b"VP8X", b"\0" * 4 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"))) == (640, 480)
    assert images.header(riff(b"VP8L", b"\x2f" + (639 | 479 << 14).to_bytes(4, "little"))) == (640, 480)
    assert images.header(riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480))) == (640, 480)
    assert images.header(tiff("<", b"II*\0")) == images.header(tiff(">", b"MM\0*")) == (640, 480)
    assert images.header(struct.pack(">I", 24) + b"ftypheic" + b"\0" * 12 + ispe(320, 240) + ispe(4032, 3024)) == (4032, 3024)
    assert images.header(b"II*\0\xff\xff\xff\x7f") is images.header(riff(b"VP8 ", b"")) is images.header(b"GIF") is None


def test_sizes_by_range(spark, tmp_path):
    # The size of the JPEG stands behind 300 kB of other segments, that of the TIFF at its end.
    late = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 60_000) + b"\xff" * 59_998) * 5 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" + b"\0" * 500_000
    end = b"II*\0" + struct.pack("<I", 400_000) + b"\0" * 399_992 + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480)
    heif = struct.pack(">I", 24) + b"ftypheic" + b"\0" * 16_360 + struct.pack(">I", 20) + b"ispe" + struct.pack(">III", 0, 320, 240)
    files = {"a b.jpg": late, "é%.tif": end, "c.png": png(5, 6), "d.jpg": b"zz", "f.jpg": late[:200_000], "g.heic": heif, "h.gif": b"GIF89a"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = readers.images(spark, str(tmp_path), [".jpg", ".tif", ".png", ".heic", ".gif"])
    got = {r.name: (r.w, r.h) for r in found.join(images.dimensions_at(found), "path").collect()}
    assert got == {"a b.jpg": (40, 30), "é%.tif": (640, 480), "c.png": (5, 6), "d.jpg": (None, None), "f.jpg": (None, None), "g.heic": (320, 240), "h.gif": (None, None)}
    assert {k: images.header(v) or (None, None) for k, v in files.items()} == got

    class Counting(io.BytesIO):
        read_ = 0

        def size(self):
            return len(self.getbuffer())

        def read_at(self, n, at):
            Counting.read_ += n
            return self.getbuffer()[at : at + n].tobytes()

    assert images.header(images.Ranges(Counting(late))) == (40, 30) and Counting.read_ < 200_000
    Counting.read_ = 0
    assert images.header(images.Ranges(Counting(end))) == (640, 480) and Counting.read_ < 50_000


def test_images(spark, tmp_path):
    for folder, files in {"House 1": {"B.png": png(3000, 1500), "a.PNG": png(5, 6), "x.txt": b"", "bad.jpg": b"zz"}, "House 02": {"c.jpg": JPEG}, "misc": {"d.png": png(1, 1)}}.items():
        (tmp_path / folder).mkdir()
        for name, content in files.items():
            (tmp_path / folder / name).write_bytes(content)
    found = readers.image_folders(spark, str(tmp_path))
    sizes = found.join(images.dimensions(found), "name").withColumn("ok", F.col("w").isNotNull())
    rows = images.manifest(images.number(sizes))
    writers.manifest(rows, f"{tmp_path}/manifest")
    assert readers.csv(spark, f"{tmp_path}/manifest").columns == writers.MANIFEST_COLUMNS
    got = {r.image_id: (r.original_relpath, r.original_format, r.final_width, r.final_height, r.orientation) for r in rows.collect()}
    assert got == {"H01_0001": ("House 1/a.PNG", "png", 5, 6, "portrait"), "H01_0002": ("House 1/B.png", "png", 2048, 1024, "landscape"), "H02_0001": ("House 02/c.jpg", "jpg", 40, 30, "landscape")}
    flat = readers.images(spark, f"{tmp_path}/House 1", content=True)
    assert sorted(r.name for r in flat.collect()) == ["B.png", "a.PNG", "bad.jpg"]
    todo = images.jobs(flat, spark.createDataFrame([("a.jpg",)], "name string"))
    status = images.resize(todo, work=lambda c, side, q: (_ for _ in ()).throw(ValueError("unreadable")) if c == b"zz" else (c, 7, 8)).cache()
    assert {r.status: r.n for r in images.status_counts(status).collect()} == {"done": 1, "failed": 1}
    assert [r.message for r in status.where("status = 'failed'").collect()] == ["ValueError: unreadable"]
    numbered = images.number(sizes)
    made = images.ingest(numbered.select("house_id", "image_id", "name", "content"), work=lambda c, edge, q: (b"%d,%d" % (edge, q), 1, 1))
    written = writers.images(made, f"{tmp_path}/out")
    assert {r.dst_name: r.bytes for r in written.collect()} == {"H01/H01_0001.jpg": 7, "H01/H01_0002.jpg": 7, "H02/H02_0001.jpg": 7}
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["H01/H01_0001.jpg", "H01/H01_0002.jpg", "H02/H02_0001.jpg"]
    assert (tmp_path / "out/H01/H01_0002.jpg").read_bytes() == b"2048,95"
    assert not images.verdict(flat, 4).first().ok and images.verdict(flat, 3).first().ok


def test_statistics_and_audits(spark):
    box = lambda i, n, b: {"object_id": i, "bangla_name": n, "bbox": b, "bbox_pct": [0.0]}
    qa = lambda i, t, q, a: {"qa_id": i, "type": t, "question": q, "answer": a}
    rows = [
        ("H01_0001", "H01", "A1", "H01/H01_0001.jpg", 100, 50, "overview", "kitchen", [box("b1", " চেয়ার ", [0, 0, 50, 10])], [qa("q1", "count", "কয়টি?", "৩টি।"), qa("q2", "object", "কী  আছে?", "কী আছে")]),
        ("H02_0002", "H02", "A2", "x.jpg", None, None, "closeup", "NA", [], [qa("q2", "count", "n?", "3"), qa("", "obj_name", "", " ")]),
    ]
    r = spark.createDataFrame(rows, vocab.RELEASE)
    s = stats.summary(r, spark.createDataFrame([("H01", "train")], "house_id string, split string")).first()
    assert (s.images_total, s.houses_total, s.qa_pairs_total, s.bounding_boxes_named) == (2, 2, 4, 1)
    assert s.split_counts == {"": 1, "train": 1} and s.orientation_counts == {"landscape": 1, "square": 1} and s.image_size_counts == {"100x50": 1, "NonexNone": 1}
    assert s.per_split[0].split == "train" and s.per_split[0].qa_by_type == {"count": 1, "object": 1} and len(s.per_split) == 1
    assert s.integrity.duplicate_qa_ids == 1 and s.integrity.blank_qa_ids == 1 and s.integrity.records_missing_image_dims == 1
    assert s.box_area_fraction.max == 0.1 and s.object_lexicon.size == 1 and s.object_lexicon_top[0].n == 1
    c = audit.convention_counts(audit.pairs(r)).first().asDict()
    assert c == {"pairs": 4, "count_answers": 2, "count_with_digit": 2, "other_with_digit": 0, "ascii_digit": 1, "no_daari": 2, "copied": 1, "blank": 1}
    p = audit.packaging_counts(r).first()
    assert (p.with_folder, p.stem_differs) == (1, 1)
    names = {x["name"]: x for x in stats.box_rows(r).collect()}
    assert len(names) == 1
