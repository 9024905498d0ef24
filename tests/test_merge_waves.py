"""The exports of the merge queries come in waves, and what nothing reads any more goes."""

import pytest

from quillspark.operators import merge
from quillspark.plans import catalog, merging
from quillspark.sources import scratch

PARTS = ["counts", "records_with_box_by_capture", "normalization", "bbox_clipping", "capture_x_room", "images_per_annotator", "completeness", "rows"]


@pytest.fixture
def waves(spark, monkeypatch, tmp_path):
    """Three waves of exports; the numbers of files that are on disk together, by wave."""
    at_once, exports = [], merging.readers.exports

    def seen(s, patterns, *more):
        at_once.append(len({p.parent for x in patterns for p in tmp_path.glob(x.removeprefix(f"{tmp_path}/"))}))
        return exports(s, patterns, *more)

    monkeypatch.setattr(scratch, "folder", lambda s, name, n=iter(range(10**6)): f"{tmp_path}/{name}-{next(n)}")
    monkeypatch.setattr(merging.readers, "exports", seen)
    monkeypatch.setattr(merging, "_WAVE", 3, raising=False)
    return at_once


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_waves_give_the_same_tasks_in_the_same_order(spark, sf_dir, waves, monkeypatch):
    order = lambda df: [(r.task_id, r.image_id, r.issue) for r in df.orderBy("file_no", "pos").select("task_id", "image_id", "issue").collect()]
    got = order(merging._read(spark, sf_dir))
    assert waves == [2, 3, 3]
    monkeypatch.setattr(merging, "_WAVE", 8)
    assert got == order(merging._read(spark, sf_dir)) and waves[3:] == [8] and len(got) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_keys_without_a_number_or_below_zero_come_in_the_first_wave(spark, tmp_path, waves, monkeypatch):
    keys = [None, -11, -3, *range(40)]
    spark.createDataFrame([(k, "O", "1-URGENT") for k in keys], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/t/orders.parquet")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/t/lineitem.parquet")
    order = lambda df: [r.task_id for r in df.orderBy("file_no", "pos").select("task_id").collect()]
    got = order(merging._read(spark, f"{tmp_path}/t"))
    monkeypatch.setattr(merging, "_WAVE", 8)
    assert len(waves) == 3 and got == order(merging._read(spark, f"{tmp_path}/t")) and len(got) == len(keys)


@pytest.mark.parametrize("name", ["merge_pairs", "merge_routes", "merge_records", "merge_problem_kinds"])
def test_queries_of_the_last_records_leave_no_tasks(spark, sf_dir, waves, monkeypatch, tmp_path, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert len(waves) == 3 and not left & {"exports", "elements", "routed"} and "records" in left
    got = _rows(df)
    monkeypatch.setattr(merging, "_WAVE", 8)
    assert got and got == _rows(catalog.QUERIES[name](spark, sf_dir))


def test_a_report_makes_what_is_asked_for(spark, sf_dir, monkeypatch):
    made, table = [], scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name: made.append(name) or table(df, name))
    got = catalog.QUERIES["merge_report"](spark, sf_dir)
    assert "records" in made and not {"boxes", "accounts"} & set(made)
    m, manifest = merging._merged(spark, sf_dir)
    whole = merge.report(m, manifest, "release").cache().first()
    assert got.first().total == whole.counts.total and set(whole.asDict()) == {"schema_version", "out_file", "thresholds", *PARTS}
    for part in PARTS:
        one = merge.report(m, manifest, "release", parts=[part])
        assert one.columns == ["schema_version", "out_file", "thresholds", part] and one.first()[part] == whole[part]
    with pytest.raises(ValueError):
        merge.report(m, manifest, "release", parts=["none"])
