import json
import random

import pytest
from test_merge import QA, SCENE, area, choice, rect, task

from quillspark.operators import merge
from quillspark.operators.incremental import Store
from quillspark.sources import readers


def exports(folder, n=5):
    """Files in which ids come again, are excluded and kept, skipped and lost."""
    rng = random.Random(n)
    for f in range(n):
        tasks = []
        for i in range(12):
            image = f"H0{rng.randrange(1, 4)}_000{rng.randrange(9)}"
            result = rng.choice([SCENE, [choice("capture_type", "closeup"), area("q_obj_name", f"f{f}")], [choice("capture_type", "group"), rect("r", 99, 10, 20, 20)]])
            result = [*result, *(QA if rng.random() < 0.5 else []), *([choice("exclude", f"x{f}")] if rng.random() < 0.3 else [])]
            tasks.append(task(image, result, i=100 * f + i) if rng.random() < 0.85 else {"id": 100 * f + i, "file_upload": f"{image}.jpg", "annotations": []})
        (folder / f"e{f}.json").write_text(json.dumps(tasks))
    (folder / "e9.json").write_text("[{")


def outputs(m, man):
    rows = lambda df: sorted((str(r.asDict(recursive=True)) for r in df.collect()))
    return {
        "records": rows(m.records), "excluded": rows(m.excluded), "degenerate": rows(m.degenerate), "issues": rows(m.issues), "problems": rows(m.problems), "completeness": rows(merge.completeness(m, man)),
        "gaps": rows(merge.gaps(m, man)), "clip": rows(merge.clip_audit(m.all_records)), "text": rows(merge.text_audit(m.tasks)),
    }


@pytest.mark.parametrize("options", [merge.MergeOptions(), merge.MergeOptions(strict_exclusion=True)])
def test_file_by_file_equals_all_at_once(spark, tmp_path, options):
    exports(tmp_path)
    (tmp_path / "man.csv").write_text("image_id,final_width,final_height\n" + "".join(f"H01_000{i},640,480\n" for i in range(9)))
    man, none = readers.manifest(spark, f"{tmp_path}/man.csv"), readers.assignment(spark, None)
    tasks, bad = readers.exports(spark, [f"{tmp_path}/e*.json"])
    want = outputs(merge.merge(tasks, none, man, options), man)
    store = Store(spark, f"{tmp_path}/store", options)
    for patterns in ([f"{tmp_path}/e0.json"], [f"{tmp_path}/e[0-3].json"], [f"{tmp_path}/e*.json"]):
        state = store.add(patterns, none, man)
    assert state.version == 3 and [f.rsplit("/", 1)[1] for f in state.files] == ["e0.json", "e1.json", "e2.json", "e3.json", "e4.json", "e9.json"] and len(state.unreadable) == 1
    assert store.add([f"{tmp_path}/e*.json"], none, man).version == 3
    assert outputs(store.merged(), man) == want
    assert store.sweep() > 0 and outputs(store.merged(), man) == want


def test_an_update_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    exports(tmp_path, 2)
    man, none = readers.manifest(spark, None), readers.assignment(spark, None)
    store = Store(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError):
        store.merged()
    store.add([f"{tmp_path}/e0.json"], none, man)
    before = outputs(store.merged(), man)
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.add([f"{tmp_path}/e1.json"], none, man)
    assert outputs(store.merged(), man) == before
    stale = store.state()
    store.add([f"{tmp_path}/e1.json"], none, man)
    stale.version += 1
    with pytest.raises(RuntimeError, match="another update"):
        store._commit(stale)
    assert store.state().version == 2
