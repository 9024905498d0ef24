"""The permutation of a seeded shuffle as a table, without the list.

A shuffle swaps places i = n - 1, ..., 1 with a random place j <= i each. Only the random numbers must be drawn one after the other: they go to a table in blocks. What a
place holds follows from the swaps that touched it: place i, just before its own swap, holds what the last swap before wrote there, that is what the
smallest i' > i with j = i held before its own swap, or still i. These pointers are followed by doubling, a join in each round; their chains are as long as the
logarithm of n. At its own swap, place i gets for good what its j holds then.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Random numbers that the driver holds at a time.
BLOCK = 1 << 20


def _swaps(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, j) of the swaps."""
    source, path, frame = random.Random(seed), scratch.folder(spark, "swaps"), None
    for high in range(n - 1, 0, -BLOCK):
        low = max(0, high - BLOCK)
        j = np.fromiter((source.randrange(i + 1) for i in range(high, low, -1)), np.int64, high - low)
        frame = spark.createDataFrame(pa.table({"i": np.arange(high, low, -1, dtype=np.int64), "j": j}))
        if n - 1 > BLOCK:
            frame.write.mode("append").parquet(path)
    if frame is None:
        return spark.createDataFrame([], "i long, j long")
    return frame if n - 1 <= BLOCK else spark.read.schema("i long, j long").parquet(path)


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(rank, pos): the place that each rank comes from, for the shuffle of ``n`` places."""
    swaps = scratch.table(_swaps(spark, n, seed), "swaps")
    real = swaps.where("j < i")
    # What the place j holds at the swap i was written by the next larger i with the same j, if any.
    later = F.lead("i").over(Window.partitionBy("j").orderBy("i"))
    asked = real.select(F.col("i").alias("rank"), later.alias("ask"), F.col("j").alias("own"))
    asked = asked.union(swaps.where("j = i").select(F.col("i").alias("rank"), F.col("i").alias("ask"), F.col("i").alias("own")))
    asked = asked.union(spark.range(min(1, n)).select(F.col("id").alias("rank"), F.col("id").alias("ask"), F.col("id").alias("own")))
    now = scratch.table(real.groupBy(F.col("j").alias("p")).agg(F.min("i").alias("to")), "pointers")
    while True:
        ahead = now.select(F.col("p").alias("to"), F.col("to").alias("far"))
        step = scratch.table(now.join(ahead, "to", "left").select("p", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "pointers")
        scratch.release(now)
        now = step.select("p", "to")
        now._scratch_path = step._scratch_path
        if step.where("moved").isEmpty():
            break
    held = now.select(F.col("p").alias("ask"), F.col("to").alias("holds"))
    return asked.join(held, "ask", "left").select("rank", F.coalesce("holds", "ask", "own").alias("pos"))
