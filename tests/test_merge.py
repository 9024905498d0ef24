import json

import pytest

from quillspark.operators import merge, validate
from quillspark.sources import readers, writers


def choice(field, value, i="c"):
    return {"from_name": field, "id": i, "type": "choices", "value": {"choices": [value]}}


def area(field, value, i="t"):
    return {"from_name": field, "id": i, "type": "textarea", "value": {"text": value}}


def rect(i, x, y, w, h, ow=1000, oh=500):
    return {"from_name": "bbox", "id": i, "type": "rectanglelabels", "original_width": ow, "original_height": oh, "value": {"x": x, "y": y, "width": w, "height": h}}


def task(image, result, i=1, upload=True, **more):
    return {"id": i, "file_upload": f"abc-{image}.jpg" if upload else None, "data": {"image": f"/d/{image}.jpg"}, "annotations": [{"was_cancelled": False, "result": result}], **more}


SCENE = [choice("capture_type", "overview"), choice("room_type", "kitchen"), rect("r1", 10, 10, 20, 20), area("bbox_name", ["চেয়ার"], "r1")]
QA = [area(f"{k}_{n}", ["প্রশ্ন"]) for n in ("scene", "object", "spatial", "count", "assistive") for k in "qa"]


@pytest.fixture
def merged(spark, tmp_path):
    one = [
        task("H01_0001", SCENE + QA),
        task("H01_0002", [choice("capture_type", "closeup"), choice("room_type", "bedroom"), area("q_obj_name", "কী?"), area("a_obj_name", ["a", " ", "b"])], upload=False),
        task("h02_0003", [*SCENE, choice("exclude", "privacy")]),
        task("H02_0004", [choice("capture_type", "group"), choice("room_type", "NA"), rect("r1", 99, 10, 20, 20)]),
        {"id": 5, "file_upload": "none.jpg", "data": {"image": ""}, "annotations": []},
        {"id": 6, "file_upload": "H02_0006.jpg", "annotations": [{"was_cancelled": True, "result": SCENE}, {"was_cancelled": False, "result": []}]},
        task("H03_0007", [choice("capture_type", "overview"), choice("capture_type", "odd"), rect("b", -10, 20, 30, 30), rect("a", 50, 5, 60, 10), rect("z", 110, 50, 5, 5), area("bbox_name", "Lamp 3", "a")]),
    ]
    two = [task("H01_0001", [*SCENE[:2], rect("q", 0, 0, 50, 50, 800, 400)] + QA, i=9), task("H02_0003", SCENE + QA)]
    (tmp_path / "a1.json").write_text(json.dumps(one))
    (tmp_path / "a2.json").write_text(json.dumps(two))
    (tmp_path / "a3.json").write_text('[{"id": 1')
    (tmp_path / "assign.csv").write_bytes("\ufeffhouse_id,annotator_name,annotator_id\nh01,x,A1\nH02,y,A0\n H02 ,y, A2 \n".encode())
    (tmp_path / "man.csv").write_text("image_id,final_width,final_height\nH01_0001,1000,500\nH01_0002,,\nH02_0003,640,480\nH02_0006,1,1\nH09_0009,5.0,x\n")
    tasks, bad = readers.exports(spark, [f"{tmp_path}/a*.json", f"{tmp_path}/gone.json"])
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad.collect()) == ["a3.json", "gone.json"]
    man = readers.manifest(spark, f"{tmp_path}/man.csv")
    return merge.merge(tasks, readers.assignment(spark, f"{tmp_path}/assign.csv"), man), man


def rows(df, key="image_id"):
    return {r[key]: r for r in df.collect()}


def test_routing_and_last_wins(merged):
    m, man = merged
    kept = rows(m.records)
    assert sorted(kept) == ["H01_0001", "H01_0002", "H02_0003", "H03_0007"]
    assert sorted(rows(m.excluded)) == ["H02_0003"] and sorted(rows(m.degenerate)) == ["H02_0004"]
    r = kept["H01_0001"]
    assert (r.annotator_id, r.image_w, r.image_h) == ("A1", 1000, 500) and r["_dims_conflict"] == "manifest=1000x500 ls=[(800, 400)]"
    assert [o.object_id for o in r.objects] == ["H01_0001_b1"] and r.objects[0].bbox == [0, 0, 400, 200]
    assert kept["H02_0003"].annotator_id == "A2" and len(r.qa_pairs) == 5
    c = kept["H01_0002"]
    assert c.room_type == "NA" and c["_room_raw"] == "bedroom" and c.qa_pairs[0].answer == "a b" and c.image_w is None
    assert sorted((r.id, r.issue) for r in m.issues.collect()) == [("5", "no_image_id"), ("6", "skipped_or_empty"), ("H01_0001", "duplicate_image_id_across_exports"), ("H02_0003", "duplicate_image_id_across_exports")]
    done = merge.completeness(m, man).first().asDict()
    assert done == {"manifest_total": 5, "in_dataset": 4, "excluded": 1, "dropped_degenerate": 1, "intentional_skips": 1, "real_gap_count": 1, "extra_not_in_manifest_count": 2}
    assert sorted(map(tuple, merge.gaps(m, man).collect())) == [("H02_0004", "extra_not_in_manifest"), ("H03_0007", "extra_not_in_manifest"), ("H09_0009", "real_gap")]


def test_boxes_numbers_and_problems(merged):
    m, _ = merged
    r = rows(m.records)["H03_0007"]
    # by y, then x; the box outside the frame is dropped after numbering, so its number stays free
    assert [(o.object_id, o.bangla_name, o.bbox) for o in r.objects] == [("H03_0007_b1", "Lamp 3", [500, 25, 500, 50]), ("H03_0007_b2", "", [0, 100, 200, 150])]
    assert r.capture_type == "odd"
    p = rows(m.problems)["H03_0007"].problems
    assert p == ["bad_capture_type:'odd'", "bad_room_type:''", "missing_annotator_id", "qa_count=0(expected 3)", "latin_chars_in_bbox_name", "missing_bbox_name"]
    kinds = {x.kind: x.n for x in validate.kinds(m.problems).collect()}
    assert kinds["dims_conflict"] == 2 and kinds["missing_bbox_name"] == 2
    clip = merge.clip_audit(m.all_records).first()
    assert (clip.out_of_frame, clip.clipped, clip.empty_after_clip, clip.dropped_degenerate) == (4, 4, 1, 2)
    assert [r.object_id for r in merge.worst_boxes(m.all_records, 2).collect()] == ["H02_0004_b1", "H03_0007_b3"]
    assert [tuple(r) for r in merge.room_fixes(m.all_records).collect()] == [("H01_0002", "bedroom")]
    assert merge.text_audit(m.tasks).first().fields_seen == 36


def test_report_and_release_files(merged, spark, tmp_path):
    m, man = merged
    writers.release(m.records, f"{tmp_path}/release")
    back = readers.json_lines(spark, f"{tmp_path}/release", readers.vocab.RELEASE)
    assert back.count() == 4 and not [c for c in back.columns if c.startswith("_")]
    rep = merge.report(m, man, "x.json")
    writers.report(rep, f"{tmp_path}/report")
    r = rep.first()
    assert r.counts.total == 4 and r.images_per_annotator == {"": 1, "A1": 2, "A2": 1} and r.completeness.real_gap_count == 1 and r.rows["duplicates"] == 2
    assert {k: df.count() for k, df in merge.report_tables(m, man).items()} == r.rows and sorted(x.id for x in merge.report_tables(m, man)["duplicates"].collect()) == ["H01_0001", "H02_0003"]


def test_text_areas_are_judged_by_their_type(spark, tmp_path):
    texts = ["[abc] def", "[1] chair", '["a"]', ["a", " ", "b"], [], "", " x ", None, 7, [1, "[2]"]]
    (tmp_path / "t.json").write_text(json.dumps([task("H01_0001", [choice("capture_type", "closeup"), *[area(f"f{i}", t) for i, t in enumerate(texts)]])]))
    t, _ = readers.exports(spark, [f"{tmp_path}/t.json"])
    got = {r.field: r.raw for r in merge.regions(merge.picked(t)).where("type = 'textarea'").collect()}
    assert [got[f"f{i}"] for i in range(len(texts))] == ["[abc] def", "[1] chair", '["a"]', "a b", "", "", " x ", None, "7", "1 [2]"]


def test_options(spark, tmp_path, merged):
    tasks = merged[0].tasks
    del tasks
    m, man = merged
    (tmp_path / "b.json").write_text(json.dumps([task("H01_0002", [choice("capture_type", "closeup"), choice("room_type", "bedroom"), rect("r", 90, 0, 20, 10), choice("exclude", "x")]), task("H01_0002", SCENE)]))
    t, _ = readers.exports(spark, [f"{tmp_path}/b.json"])
    none = readers.assignment(spark, None)
    o = merge.MergeOptions
    kept = merge.merge(t, none, man, o(keep_excluded=True)).records.collect()
    assert [x.capture_type for x in kept] == ["overview"]
    strict = merge.merge(t, none, man, o(strict_exclusion=True))
    assert strict.records.count() == 0 and strict.excluded.count() == 1
    first = merge.merge(t.where("pos = 0"), none, man, o(keep_closeup_room=True, clip_boxes=False)).excluded.first()
    assert first.room_type == "bedroom" and first.objects[0].bbox == [900, 0, 200, 50]
    with pytest.raises(ValueError):
        (tmp_path / "bad.csv").write_text("house_id,x\nH01,1\n")
        readers.assignment(spark, f"{tmp_path}/bad.csv")


def test_exports_are_kept_as_what_is_picked(spark, tmp_path):
    result = [*SCENE, choice("exclude", "a"), choice("exclude", "b"), rect("r1", -5, 1, 9, 9), rect("r2", 2, 1, 50, 120), rect(None, 1, 1, 1, 1)]
    (tmp_path / "p.json").write_text(json.dumps([task("H01_0001", result), task("H01_0001", SCENE), {"id": 2, "file_upload": "H02_0002.jpg", "annotations": []}]))
    seen, _ = readers.exports(spark, [f"{tmp_path}/p.json"], pick=merge.pick)
    (tmp_path / "p.json").unlink()
    assert sorted((r.pos, r.image_id, r["_exclude"], r.issue) for r in seen.collect()) == [(0, "H01_0001", "b", None), (1, "H01_0001", "", None), (2, "H02_0002", "", "skipped_or_empty")]
    m = merge.merge(seen, readers.assignment(spark, None), readers.manifest(spark, None))
    assert [(r.pos, len(r.objects)) for r in m.records.collect()] == [(1, 1)] and [(r.pos, r["_exclude"]) for r in m.excluded.collect()] == [(0, "b")]
    want = [(r.pos, i, *[b[c] for c in ("object_id", "bbox", "over_px", "lost", "out_of_frame", "degenerate")]) for r in m.all_records.select("pos", "_boxes").collect() for i, b in enumerate(r["_boxes"])]
    got = m.boxes.select("pos", "i", "object_id", "bbox", "over_px", "lost", "out_of_frame", "degenerate").collect()
    assert len(want) == 3 and sorted(map(tuple, got)) == sorted(want)
