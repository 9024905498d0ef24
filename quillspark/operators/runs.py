"""Model runs: pluggable answers with isolated failures, and what is measured of them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry, scalars, text
from ..sources import scratch
from . import items as items_
from . import ordered

RESPONSE = "qa_id string, model_id string, raw_output string, latency_s double, run_ts string, error string"


class Answerer:
    """Answers one item. Made once for each partition; ``setup`` loads what is costly."""

    def setup(self) -> None:
        pass

    def answer(self, item: dict) -> str:
        raise NotImplementedError


class FirstWord(Answerer):
    """A stub without a model: the first word of the question."""

    def answer(self, item: dict) -> str:
        return (item["question"] or "").split()[0]


@dataclass(frozen=True)
class RunOptions:
    model_id: str = "stub"
    shard: int = 0
    num_shards: int = 1
    limit: int = 0
    group_a_tokens: int = vocab.GROUP_A_TOKENS
    group_b_tokens: int = vocab.GROUP_B_TOKENS
    max_consecutive_errors: int = 20
    #: Items whose response is empty are tried again.
    retry_empty: bool = False
    instruction: str = ""

    def __post_init__(self):
        if self.num_shards < 1 or not 0 <= self.shard < self.num_shards:
            raise ValueError(f"shard {self.shard} of {self.num_shards}")
        if self.max_consecutive_errors < 1:
            raise ValueError("max_consecutive_errors starts at 1")


def plan(items: DataFrame, responses: DataFrame | None, options: RunOptions = RunOptions()) -> DataFrame:
    """The items left to do, with token budget and prompt."""
    part = items_.shard(items, options.shard, options.num_shards)
    if responses is not None:
        done = responses.where(F.coalesce("raw_output", F.lit("")) != "") if options.retry_empty else responses
        part = items_.todo(part, done, options.limit)
    elif options.limit:
        part = part.orderBy("rank").limit(options.limit)
    return part.select("*", scalars.token_budget(F.col("group"), F.col("qa_type"), options.group_a_tokens, options.group_b_tokens).alias("max_tokens"), scalars.prompt(options.instruction, F.col("question")).alias("prompt"))


def dry_run(planned: DataFrame, n: int = 3) -> DataFrame:
    return planned.orderBy("rank").limit(n)


class Worker:
    """Answers items one after the other and counts the failures in a row."""

    def __init__(self, make: Callable[[], Answerer], options: RunOptions, failed: int = 0):
        self.answerer, self.options, self.failed = make(), options, failed
        self.answerer.setup()

    @property
    def stopped(self) -> bool:
        return self.failed >= self.options.max_consecutive_errors

    def answer(self, item: dict) -> tuple:
        began, error, said = time.perf_counter(), None, ""
        try:
            said = self.answerer.answer(item).strip()
            self.failed = 0
        except Exception as e:  # noqa: BLE001 - any failure of a model is one item's failure
            error, self.failed = f"{type(e).__name__}: {e}", self.failed + 1
        return item["qa_id"], self.options.model_id, said, round(time.perf_counter() - began, 3), time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), error


_COLUMNS = [c.split()[0] for c in RESPONSE.split(", ")]


def run(planned: DataFrame, make: Callable[[], Answerer], options: RunOptions = RunOptions()) -> DataFrame:
    """A response for each item. A failure gives an empty answer and its error; after too many in a row, in the order of ranks over all tasks, nothing more is
    kept, nor the row that stops the run. Tasks answer ranges of ranks side by side; each ends early at so many failures of its own, and what later ranges have answered
    in vain is cut off."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = None
        for pdf in frames:
            worker, out = worker or Worker(make, options), []
            for item in pdf.to_dict("records"):
                if worker.stopped:
                    break
                out.append((*worker.answer(item), item["rank"]))
            yield pd.DataFrame(out, columns=[*_COLUMNS, "rank"])
            if worker.stopped:
                return

    ranged = planned.repartitionByRange("rank").sortWithinPartitions("rank")
    made = scratch.table(ranged.mapInPandas(work, f"{RESPONSE}, rank long"), "responses")
    return cut_off(made, options.max_consecutive_errors).select(*_COLUMNS)


def cut_off(responses: DataFrame, most: int, order: str = "rank") -> DataFrame:
    """The responses before the one that makes it ``most`` failures in a row."""
    runs = ordered.islands(responses.withColumn("_failed", F.col("error").isNotNull()), [], order, "_failed")
    stop = runs.where(F.col("n") >= most).agg(F.min(F.col("first") + most - 1).alias("_stop"))  # one row
    return ordered.placed(responses, [], [order]).join(F.broadcast(stop), F.lit(True)).where(F.coalesce(F.col("_pos") < F.col("_stop"), F.lit(True))).select(*responses.columns)


def error_runs(responses: DataFrame, order: str, failed: str) -> DataFrame:
    """(start, end, n) of runs of consecutive failures in the order of ``order``, per model."""
    return ordered.islands(responses, ["model_id"], order, failed).select("model_id", "start", "end", "n")


def latency(responses: DataFrame, by: list[str], order: list[str], column: str = "latency_s", drop: int = vocab.WARM_UP) -> DataFrame:
    """Mean latency, and that after the first ``drop`` where there are more than one more. Each task hands on no more than its first ``drop`` rows of a key; rows
    that are equal in order and latency change nothing by their order."""
    along = [*order, column]
    first = responses.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*along))).where(F.col("_n") <= drop)
    last = first.groupBy(*by).agg(F.max(F.struct(*along)).alias("_last"), F.count(F.lit(1)).alias("_warm_up"))
    keys = [F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    both = responses.alias("r").join(last.alias("f"), reduce(Column.__and__, keys), "left").select("r.*", "_last", "_warm_up")
    at = F.struct(*along)
    n, late = F.count(F.lit(1)), at > F.col("_last")
    out = both.groupBy(*by).agg(n.alias("n"), F.avg(column).alias("mean_s"), F.sum(F.when(late, F.col(column))).alias("_sum"), F.count_if(late).alias("_late"), F.max(f"_last.{column}").alias("_tie"))
    # Of rows equal to the last one that is dropped, some may stay.
    stay = F.col("n") - drop - F.col("_late")
    warm = (F.coalesce("_sum", F.lit(0.0)) + F.when(stay > 0, stay * F.col("_tie")).otherwise(F.lit(0.0))) / (F.col("n") - drop)
    return out.select(*by, "n", "mean_s", F.when(F.col("n") > drop + 1, warm).otherwise(F.col("mean_s")).alias("warm_mean_s"))


def projection(speed: DataFrame, items: int, warm: str = "warm_mean_s", workers: list[int] = [1, 2, 3, 4, 6, 8], session_hours: float = 12.0) -> DataFrame:
    """Hours that all items take on so many workers, and whether a session is long enough."""
    grid = speed.select("*", F.explode(F.array(*map(F.lit, workers))).alias("workers"))
    return grid.withColumn("hours", F.lit(float(items)) / F.col("workers") * F.col(warm) / 3600.0).withColumn("fits", F.col("hours") <= session_hours)


def quality(responses: DataFrame, by: list[str], column: str = "raw_output") -> DataFrame:
    """Empty answers; of the others, those without Bangla letters and the long ones."""
    a = F.coalesce(F.col(column), F.lit(""))
    some = text.strip(a) != ""
    return responses.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~some).alias("empty"), F.count_if(some & ~text.has_bangla(a)).alias("no_bangla"), F.count_if(some & (text.word_count(a) > vocab.LONG_ANSWER_WORDS)).alias("long"))


def score(items: DataFrame, responses: DataFrame, by: list[str]) -> DataFrame:
    """Strict and relaxed accuracy of responses (an extension: items and responses meet on qa_id)."""
    both = items.join(responses, "qa_id").withColumns({"_p": text.clean_for_scoring(F.col("raw_output")), "_r": text.clean_for_scoring(F.col("gold"))})
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(text.strict_match(F.col("_p"), F.col("_r"))).alias("strict"), F.count_if(text.relaxed_match(F.col("_p"), F.col("_r"))).alias("relaxed"))


guard_plan = geometry.guard_plan
