"""Benchmark items: flattening, deterministic order, shards and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import nested, scalars, text
from . import ordered, shuffled


def build(raw: DataFrame, extension: str = ".jpg") -> tuple[DataFrame, DataFrame]:
    """Items (unranked) and records with their layout, of rows of (json), each a whole record file."""
    found = nested.containers(raw).withColumn("m", F.from_json("record", "map<string,string>"))
    image = F.coalesce(nested.present(F.col("m"), vocab.IMAGE_ID_KEYS), F.lit(""))
    house = nested.present(F.col("m"), vocab.HOUSE_ID_KEYS)
    file = nested.present(F.col("m"), vocab.IMAGE_FILE_KEYS)
    r = found.select("container", "pos", "record", image.alias("image_id"), file.alias("file"), house.alias("house"))
    r = r.withColumn("house_id", F.coalesce("house", scalars.house_from_prefix(F.col("image_id")))).withColumn("image_file", F.when(F.col("file").isNull(), F.concat("image_id", F.lit(extension))).otherwise(scalars.flat_image_file(F.col("file"), extension)))
    records = nested.question_answers(r.drop("house", "file"))
    q = records.where("image_id <> ''").select("image_id", "house_id", "image_file", F.explode("qas").alias("q"))
    items = q.select(F.col("q.qa_id"), "image_id", "house_id", "image_file", F.col("q.qa_type"), scalars.group_of(F.col("q.qa_type")).alias("group"), text.nfc(F.col("q.question")).alias("question"), text.nfc(F.col("q.gold")).alias("gold"))
    return items, records


def rank_by_hash(items: DataFrame, seed: int = 42, key: str = "qa_id") -> DataFrame:
    """A random order that the seed fixes: by the md5 of seed and id. Ranks are counted per range of the hash, whose first
    digits deal out the rows evenly, and the few ranges are then added up; no window spans all rows."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key), F.lit(""))))
    keyed = items.withColumn("_h", h).withColumn("_range", F.substring("_h", F.lit(1), F.lit(3)))
    sizes = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    return keyed.withColumn("_in", inside).join(before, "_range").select((F.col("_before") + F.col("_in")).alias("rank"), *[F.col(f"`{c}`") for c in items.columns])


def rank_by_shuffle(items: DataFrame, seed: int = 42) -> DataFrame:
    """The order of a seeded shuffle of the items sorted by (image_id, qa_id, qa_type). The permutation depends on their number only; it is a table that is joined by place."""
    at = ordered.placed(items, [], ["image_id", "qa_id", "qa_type"])
    order = shuffled.permutation(items.sparkSession, at.count(), seed)
    return at.join(order, at["_pos"] == order["pos"]).select("rank", *[F.col(f"`{c}`") for c in items.columns])


def shard(items: DataFrame, k: int, n: int) -> DataFrame:
    if n < 1 or not 0 <= k < n:
        raise ValueError(f"shard {k} of {n}")
    return items.where(F.pmod(F.col("rank"), F.lit(n)) == k)


def shard_sizes(count: DataFrame, shards: list[int] = [2, 3, 4, 6, 8, 9]) -> DataFrame:
    """(shards, k, size) of a one-row frame with the number of items ``n``."""
    n, s, k = F.col("n"), F.col("shards"), F.col("k")
    grid = count.select("n", F.explode(F.array(*map(F.lit, shards))).alias("shards")).select("n", "shards", F.explode(F.sequence(F.lit(0), s - 1)).alias("k"))
    return grid.select("shards", "k", (F.floor(n / s) + (k < F.pmod(n, s)).cast("int")).cast("long").alias("size"))


def todo(items: DataFrame, done: DataFrame, limit: int = 0) -> DataFrame:
    """Items whose id has no response yet, in rank order if limited."""
    left = items.join(done.select("qa_id").distinct(), "qa_id", "left_anti").select(*[F.col(f"`{c}`") for c in items.columns])
    return left.orderBy("rank").limit(limit) if limit else left


def largest(df: DataFrame, value: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` rows of the largest value; of equal ones, the first by ``order``."""
    return df.orderBy(F.desc(value), *order).limit(n)
