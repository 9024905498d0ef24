import json

import pytest
from pyspark.sql import functions as F

from quillspark import vocab
from quillspark.operators import runs
from quillspark.sources import ledger, writers
from quillspark.sources.ledger import Ledger
from quillspark.streaming import resume


def answers(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("q"), "id").alias("qa_id"), F.lit("m").alias("model_id"), F.lit("x").alias("raw_output"), F.lit(0.5).alias("latency_s"), F.lit("t").alias("run_ts"), F.lit("m").alias("model_tag"), (F.col("id") % 2).cast("int").alias("shard"))


def test_a_killed_and_repeated_batch_counts_once(spark, tmp_path, monkeypatch):
    book = Ledger(spark, f"{tmp_path}/out")
    assert book.read().collect() == [] and book.commit(answers(spark, 0, 6), 0)
    # An attempt dies after its files are written and before its entry is.
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_store", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            book.commit(answers(spark, 6, 9), 1)
    assert book.read().count() == 6 and len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert book.commit(answers(spark, 6, 9), 1) and not book.commit(answers(spark, 6, 9), 1) and not book.commit(answers(spark, 0, 6), 0)
    rows = book.read().collect()
    assert sorted(r.qa_id for r in rows) == [f"q{i}" for i in range(9)] and {r.shard for r in rows} == {0, 1}
    assert book.sweep() == 1 and book.sweep() == 0 and book.read().count() == 9
    # Of two attempts at once, the first rename counts.
    with monkeypatch.context() as m:
        m.setattr(Ledger, "committed", lambda *a: False)
        assert not book.commit(answers(spark, 50, 60), 1)
    assert book.read().count() == 9


def test_entries_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "COMPACT", 3)
    book = Ledger(spark, f"{tmp_path}/out")
    for n in range(8):
        assert book.commit(answers(spark, n, n + 1), n if n % 2 else f"run {n}")
    names = [n for n in book._names("_ledger") if not n.startswith("compact")]
    assert len(names) < 3 and len(book.files()) == 8 and book.read().count() == 8
    assert all(book.committed(n if n % 2 else f"run {n}") for n in range(8)) and not book.committed(9)
    assert not book.commit(answers(spark, 0, 1), "run 0") and book.read().count() == 8


def test_responses_follow_the_ledger(spark, tmp_path):
    writers.responses(answers(spark, 0, 4), f"{tmp_path}/out", "a")
    writers.responses(answers(spark, 0, 4), f"{tmp_path}/out", "a")
    writers.responses(answers(spark, 4, 5), f"{tmp_path}/out")
    assert Ledger(spark, f"{tmp_path}/out").read().count() == 5


def item_rows(spark, ranks):
    return spark.createDataFrame([(r, f"q{r}", f"H{r}", "H01", "x.jpg", "count", "A", "how many?", "3") for r in ranks], vocab.ITEMS)


class FailsAtTwelve(runs.Answerer):
    def answer(self, item):
        if 8 <= item["rank"] < 40:
            raise RuntimeError("no")
        return f"a{item['rank']}"


def test_failures_in_a_row_over_batches(spark, tmp_path):
    # 8 answers, 12 failures; then 8 more failures, of which the last makes twenty.
    o = runs.RunOptions(model_id="m", max_consecutive_errors=20)
    counts = []
    for ranks in (range(0, 20), range(20, 45), range(45, 50)):
        item_rows(spark, ranks).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        resume.answer_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", FailsAtTwelve, o).awaitTermination()
        counts.append(Ledger(spark, f"{tmp_path}/out").read().count())
    assert counts == [20, 27, 27]
    rows = Ledger(spark, f"{tmp_path}/out").read().collect()
    assert sorted(int(r.qa_id[1:]) for r in rows) == list(range(27)) and sum(r.raw_output == "" for r in rows) == 19


def test_shards_stop_each_for_itself(spark, tmp_path):
    o = runs.RunOptions(model_id="m", num_shards=2, max_consecutive_errors=5)
    item_rows(spark, [r for r in range(60) if r % 2 or r < 8 or r >= 50]).write.json(f"{tmp_path}/in")
    resume.answer_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", FailsAtTwelve, o).awaitTermination()
    got = {k: sorted(int(r.qa_id[1:]) for r in Ledger(spark, f"{tmp_path}/out").read().collect() if r.shard == k) for k in (0, 1)}
    assert got == {0: [0, 2, 4, 6, 50, 52, 54, 56, 58], 1: [1, 3, 5, 7, 9, 11, 13, 15]}


def test_failures_in_a_row_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    o = runs.RunOptions(model_id="m", max_consecutive_errors=20)
    out = runs.run(item_rows(spark, range(100)).repartition(6), FailsAtTwelve, o).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(int(r.qa_id[1:]) for r in out) == list(range(27))
    o = runs.RunOptions(model_id="m", max_consecutive_errors=33)
    assert runs.run(item_rows(spark, range(100)).repartition(6), FailsAtTwelve, o).count() == 100


def test_ledger_lines_are_json(spark, tmp_path):
    book = Ledger(spark, f"{tmp_path}/out")
    book.commit(answers(spark, 0, 2), 7)
    entry = json.loads((tmp_path / "out/_ledger/batch-00000000000000000007.json").read_text())
    assert list(entry) == ["files"] and all(f.startswith("batch=") for f in entry["files"])
