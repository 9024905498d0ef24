"""Descriptive statistics of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry, scalars, text
from .merge import counts_map


def describe(c: Column) -> Column:
    """min, median (mean of the middle two), mean, max, n; null without values."""
    return F.when(F.count(c) > 0, F.struct(F.min(c).alias("min"), F.median(c).alias("median"), scalars.half_up(F.avg(c), 2).alias("mean"), F.max(c).alias("max"), F.count(c).alias("n")))


def with_split(release: DataFrame, splits: DataFrame) -> DataFrame:
    """A record's own split, else that of its house, else ''."""
    s = splits.select("house_id", F.col("split").alias("_house_split"))
    own = F.col("split") if "split" in release.columns else F.lit(None).cast("string")
    return release.join(s, "house_id", "left").withColumn("_split", F.coalesce(own, F.col("_house_split"), F.lit(""))).drop("_house_split")


def group_counts(release: DataFrame) -> DataFrame:
    """(metric, key, n) of seven groupings in one pass."""
    labels = {
        "room_type": F.col("room_type"), "capture_type": F.col("capture_type"), "split": F.col("_split"), "annotator_id": F.col("annotator_id"), "house_id": F.col("house_id"),
        "image_size": scalars.size_label(F.col("image_w"), F.col("image_h")), "orientation": scalars.orientation3(F.col("image_w"), F.col("image_h")),
    }
    tall = release.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(v, F.lit("")).alias("key")) for k, v in labels.items()])).alias("x"))
    return tall.groupBy("x.metric", "x.key").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, key: str, name: str = "n", count: str = "records") -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(count))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def qa_rows(release: DataFrame) -> DataFrame:
    """A row for each pair with its lengths in characters and words."""
    q = release.select("image_id", F.explode("qa_pairs").alias("p")).select("image_id", "p.*")
    return q.select("*", F.length("question").alias("q_chars"), F.length("answer").alias("a_chars"), text.word_count(F.col("question")).alias("q_words"), text.word_count(F.col("answer")).alias("a_words"), text.not_nfc(F.col("question"), F.col("answer")).alias("not_nfc"))


def box_rows(release: DataFrame) -> DataFrame:
    b = release.select("image_id", "capture_type", "image_w", "image_h", F.explode("objects").alias("o")).select("image_id", "capture_type", "image_w", "image_h", "o.*")
    frac = geometry.area_fraction(F.get("bbox", F.lit(2)), F.get("bbox", F.lit(3)), F.nullif("image_w", F.lit(0)), F.nullif("image_h", F.lit(0)))
    return b.select("image_id", "capture_type", "object_id", text.nfc(text.strip(F.col("bangla_name"))).alias("name"), frac.alias("area_fraction"))


def frequencies(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """(key, n, first): counts, and the place of the first occurrence, which breaks ties."""
    first = F.min(F.struct(*order)) if order else F.min(key)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def top(freq: DataFrame, k: int) -> DataFrame:
    """The most common; of equal counts, those seen first."""
    return freq.orderBy(F.desc("n"), "first").limit(k).drop("first")


def lexicon(freq: DataFrame) -> DataFrame:
    """Size and thresholds of a lexicon, one row."""
    n = F.col("n")
    return freq.agg(F.count(F.lit(1)).alias("size"), F.count_if(n >= 20).alias("ge20"), F.count_if(n >= 10).alias("ge10"), F.count_if(n >= 5).alias("ge5"), F.count_if(n == 1).alias("singletons"), F.coalesce(F.sum(n), F.lit(0)).alias("named"))


def reuse(df: DataFrame, key: str) -> DataFrame:
    n, d = F.count(F.lit(1)), F.countDistinct(key)
    return df.agg(n.alias("total"), d.alias("unique"), scalars.half_up(1 - d / F.greatest(n, F.lit(1)), 4).alias("reuse_rate"))


def integrity(release: DataFrame) -> DataFrame:
    """Duplicate and blank ids, texts that are not composed, missing dimensions; one row."""
    q = qa_rows(release).agg((F.count(F.lit(1)) - F.countDistinct(F.coalesce("qa_id", F.lit("")))).alias("duplicate_qa_ids"), F.count_if(F.coalesce("qa_id", F.lit("")) == "").alias("blank_qa_ids"), F.count_if("not_nfc").alias("qa_fields_not_nfc"))
    b = box_rows(release).agg((F.count(F.lit(1)) - F.countDistinct(F.coalesce("object_id", F.lit("")))).alias("duplicate_object_ids"), F.count_if(F.coalesce("object_id", F.lit("")) == "").alias("blank_object_ids"))
    r = release.agg((F.count(F.lit(1)) - F.countDistinct(F.coalesce("image_id", F.lit("")))).alias("duplicate_image_ids"), F.count_if(~F.coalesce((F.col("image_w") != 0) & (F.col("image_h") != 0), F.lit(False))).alias("records_missing_image_dims"))
    return r.join(q, F.lit(True)).join(b, F.lit(True))


def per_split(release: DataFrame) -> DataFrame:
    """A row for each known split that occurs, with counts and four maps."""
    r = release.where(F.col("_split").isin(vocab.SPLITS))
    base = r.groupBy("_split").agg(F.count(F.lit(1)).alias("images"), F.countDistinct("house_id").alias("houses"), F.sum(F.size("qa_pairs")).alias("qa_pairs"), F.sum(F.size("objects")).alias("boxes"))

    def of(df, key, name):
        g = df.groupBy("_split", F.coalesce(F.col(key), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return g.groupBy("_split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    for key in ("room_type", "capture_type", "annotator_id"):
        base = base.join(of(r, key, key), "_split", "left")
    types = of(r.select("_split", F.explode("qa_pairs.type").alias("t")), "t", "qa_by_type")
    return base.join(types, "_split", "left").withColumnRenamed("_split", "split")


def summary(release: DataFrame, splits: DataFrame, k: int = 30) -> DataFrame:
    """All statistics in one nested row."""
    r = with_split(release, splits)
    q, b = qa_rows(r), box_rows(r)
    freq = frequencies(b.where("name <> ''"), "name", ["image_id", "object_id"])
    per_house = r.groupBy("house_id").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    by_type = q.groupBy("type").agg(describe(F.col("q_words")).alias("question"), describe(F.col("a_words")).alias("answer"))
    parts = [
        r.agg(F.count(F.lit(1)).alias("images_total"), F.countDistinct("house_id").alias("houses_total"), F.countDistinct("annotator_id").alias("annotators_total"), F.array_sort(F.collect_set("annotator_id")).alias("annotator_ids"), describe(F.size("qa_pairs")).alias("qa_pairs_per_image"), describe(F.size("objects")).alias("boxes_per_record")),
        per_house.agg(describe(F.col("n")).alias("images_per_house")),
        *[counts_map(r, c, n) for n, c in (("images_per_house_detail", F.col("house_id")), ("images_per_annotator", F.col("annotator_id")), ("room_type_counts", F.col("room_type")), ("capture_type_counts", F.col("capture_type")), ("capture_x_room", F.concat_ws("|", "capture_type", "room_type")), ("image_size_counts", scalars.size_label(F.col("image_w"), F.col("image_h"))), ("orientation_counts", scalars.orientation3(F.col("image_w"), F.col("image_h"))), ("split_counts", F.col("_split")))],
        per_split(r).agg(F.collect_list(F.struct("split", "images", "houses", "qa_pairs", "boxes", "room_type", "capture_type", "annotator_id", "qa_by_type")).alias("per_split")),
        q.agg(F.count(F.lit(1)).alias("qa_pairs_total"), *[describe(F.col(c)).alias(n) for c, n in (("q_chars", "question_length_chars"), ("a_chars", "answer_length_chars"), ("q_words", "question_length_words"), ("a_words", "answer_length_words"))], F.countDistinct("question").alias("unique_questions"), F.countDistinct("answer").alias("unique_answers"), scalars.half_up(1 - F.countDistinct("question") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("question_reuse_rate")),
        counts_map(q, F.col("type"), "qa_pairs_by_type"),
        rows(by_type, "length_words_by_qa_type"),
        b.agg(F.count(F.lit(1)).alias("bounding_boxes_total"), F.count_if(F.col("name") != "").alias("bounding_boxes_named"), describe(F.col("area_fraction")).alias("box_area_fraction")),
        counts_map(r.where("size(objects) > 0"), F.col("capture_type"), "records_with_box_by_capture_type"),
        row(lexicon(freq), "object_lexicon"),
        top(freq, k).agg(F.collect_list(F.struct("name", "n")).alias("object_lexicon_top")),
        row(integrity(r), "integrity"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out
