"""Answering items as they arrive, shard by shard, with what must outlive a batch kept as state.

The state of a model and shard is the length of its open run of failures, and whether it has stopped; so failures are counted in a row over batches and tasks, as one
worker would that answers the shard's items one after the other. Batches are committed to a ledger under their number: a batch that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import vocab
from ..operators import items as items_
from ..operators import runs
from ..sources.ledger import Ledger

STATE = "failed long, stopped boolean"
_ITEM = [c.split()[0] for c in vocab.ITEMS.split(", ")]


def item_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(vocab.ITEMS).option("maxFilesPerTrigger", files).json(folder)


def answered(items: DataFrame, make: Callable[[], runs.Answerer], options: runs.RunOptions = runs.RunOptions()) -> DataFrame:
    """The responses to a stream of planned items, by shard. A shard's items of a batch are answered in the order of ranks by one worker, as long as
    fewer than ``max_consecutive_errors`` have failed in a row; the row that makes it so many isn't given, and from then on the shard has no more responses."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, stopped = state.get if state.exists else (0, False)
        if not stopped:
            pdf = pd.concat(list(frames)).sort_values(["rank", "qa_id"])
            worker, out = runs.Worker(make, options, failed), []
            for item in pdf.to_dict("records"):
                row = worker.answer(item)
                if worker.stopped:
                    break
                out.append((*row[:-1], options.model_id, key[0]))
            state.update((worker.failed, worker.stopped))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in f"{vocab.RESPONSES}, model_tag string, shard int".split(", ")])

    dealt = items.withColumn("shard", F.pmod("rank", F.lit(options.num_shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandasWithState(work, f"{vocab.RESPONSES}, model_tag string, shard int", STATE, "append", GroupStateTimeout.NoTimeout)


def answer_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, make: Callable[[], runs.Answerer], options: runs.RunOptions = runs.RunOptions(), every_shard: bool = True, files: int = 1000) -> StreamingQuery:
    """Answers what arrives in ``folder`` and commits the responses to the ledger at ``out``. Items that have a response when the query starts are left out, and so are items that come
    again. With ``every_shard`` all shards are answered, else that of the options."""
    ledger = Ledger(spark, out)
    items = items_.todo(item_stream(spark, folder, files).dropDuplicates(["qa_id"]), ledger.read().select("qa_id"))
    if not every_shard:
        items = items_.shard(items, options.shard, options.num_shards)
    planned = items.select(*_ITEM).transform(lambda df: runs.plan(df, None, runs.RunOptions(group_a_tokens=options.group_a_tokens, group_b_tokens=options.group_b_tokens, instruction=options.instruction)))
    # The name tells the runs of different queries apart that share the ledger.
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    made = answered(planned, make, options)
    return made.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ledger.commit(df, f"{name}-{n:012d}") and None).trigger(availableNow=True).start()
