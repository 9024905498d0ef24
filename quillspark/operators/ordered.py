"""Computations along an order, without a window over all rows of a key.

Rows are dealt to ranges of (key, order), so that one key with most rows is spread over many tasks. What a range has to say about a key (how many rows, which runs touch its
ends) is one row each, and the ranges of a key are put together by sums over these few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with _part (its range), _pos (its place in its key, from 0) and _size (rows of the key); nulls come first, and rows that are equal in ``order`` in any order."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    # Equal rows are told apart, so that they need not be in one range.
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row")
    held = scratch.table(ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "ranges")
    runs = held.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*by)  # as many rows as there are ranges of a key
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_size"))
    same = reduce(Column.__and__, [F.col(f"h.`{n}`").eqNullSafe(F.col(f"r.`{n}`")) for n in (*by, "_part")])
    out = held.alias("h").join(runs.alias("r"), same)
    return out.select(*[F.col(f"h.`{c}`") for c in df.columns], "h._part", (F.col("_row") + F.col("_shift")).alias("_pos"), "_size")


def islands(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """(by, start, end, n, first): runs of consecutive rows of a key that have ``flag``: the first and last ``order``, the rows, and the place of the first."""
    at = placed(df.select(*by, order, F.coalesce(flag, F.lit(False)).alias("_flag")), by, [order])
    inside = Window.partitionBy(*by, "_part")
    marked = at.withColumns({"_low": F.min("_pos").over(inside), "_high": F.max("_pos").over(inside), "_run": F.col("_pos") - F.row_number().over(Window.partitionBy(*by, "_part", "_flag").orderBy("_pos"))})
    runs = marked.where("_flag").groupBy(*by, "_part", "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first"), F.max("_pos").alias("last"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    runs = scratch.table(runs, "islands")
    names = [*by, "start", "end", "n", "first"]
    touches = (F.col("first") == F.col("_low")) | (F.col("last") == F.col("_high"))
    # At most two runs of a range and key touch its ends.
    along = Window.partitionBy(*by).orderBy("first")
    opened = F.coalesce(F.lag("last").over(along) + 1 != F.col("first"), F.lit(True))
    joined = runs.where(touches).withColumn("_new", opened.cast("int")).withColumn("_island", F.sum("_new").over(along))
    joined = joined.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return runs.where(~touches).select(*names).unionByName(joined.select(*names))
