"""Release audits: packaging, references in both directions, text conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text


def packaging(records: DataFrame) -> DataFrame:
    """image_file with a folder prefix, and whether its stem is the image_id."""
    path = F.coalesce(F.col("image_file"), F.lit(""))
    return records.select("image_id", path.alias("image_file"), path.rlike(r"[/\\]").alias("has_folder"), (scalars.stem(path) != F.coalesce("image_id", F.lit(""))).alias("stem_differs"))


def packaging_counts(records: DataFrame) -> DataFrame:
    return packaging(records).agg(F.count(F.lit(1)).alias("paths"), F.count_if("has_folder").alias("with_folder"), F.count_if("stem_differs").alias("stem_differs"))


def missing(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    r = right.select(F.col(other or key).alias(key))
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(r, key, "left_anti")


def references(referenced: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that are on one side only."""
    return missing(referenced, present, key).withColumn("side", F.lit("missing")).union(missing(present, referenced, key).withColumn("side", F.lit("unreferenced")))


def image_check(items: DataFrame, files: DataFrame, extension: str = ".jpg") -> DataFrame:
    """(image_id, image_file, status) of items' images against a folder: ok, missing, or wrong_extension where only the stem is there."""
    named = files.select(F.col("name").alias("_name"), scalars.stem(F.col("name")).alias("_stem"))
    want = items.select("image_id", "image_file").distinct().withColumn("_stem", scalars.stem(F.col("image_file")))
    found = want.join(named, "_stem", "left").groupBy("image_id", "image_file").agg(F.max(F.coalesce(F.col("_name") == F.col("image_file"), F.lit(False))).alias("same"), F.count("_name").alias("n"))
    right = F.endswith(F.lower("image_file"), F.lit(extension.lower()))
    return found.select("image_id", "image_file", F.when(F.col("n") == 0, "missing").when(~F.col("same") | ~right, "wrong_extension").otherwise("ok").alias("status"))


def pairs(records: DataFrame) -> DataFrame:
    """Type, id, answer and question of each pair, nulls as empty strings."""
    p = records.select(F.explode("qa_pairs").alias("p"))
    return p.select(*[F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c) for c in ("type", "qa_id", "answer", "question")])


def digits(rows: DataFrame) -> DataFrame:
    """Pairs whose answer holds a digit, with its kind; counting questions apart."""
    return rows.select("qa_id", "type", "answer", (F.col("type") == "count").alias("counts"), text.digit_kind(F.col("answer")).alias("kind")).where("kind is not null")


def conventions(rows: DataFrame) -> DataFrame:
    """Which conventions each pair breaks."""
    a, q = F.col("answer"), F.col("question")
    return rows.select("qa_id", "type", "answer", "question", text.digit_kind(a).alias("digit_kind"), text.lacks_daari(a).alias("no_daari"), text.copied(a, q).alias("copied"), text.blank(q, a).alias("blank"))


def convention_counts(rows: DataFrame) -> DataFrame:
    c = conventions(rows)
    count = F.col("type") == "count"
    digit = F.col("digit_kind").isNotNull()
    return c.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(count).alias("count_answers"), F.count_if(count & digit).alias("count_with_digit"), F.count_if(~count & digit).alias("other_with_digit"), F.count_if(F.col("digit_kind") == "ASCII").alias("ascii_digit"), F.count_if("no_daari").alias("no_daari"), F.count_if("copied").alias("copied"), F.count_if("blank").alias("blank"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
