"""Structural checks as an array of problem strings for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars, text


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def rules() -> Column:
    """The 17 rules over a record's columns, in the order of the report."""
    cap, room, w, h = F.col("capture_type"), F.col("room_type"), F.col("image_w"), F.col("image_h")
    scene = cap.isin(vocab.SCENE_CAPTURES)
    sized = F.coalesce((w != 0) & (h != 0), F.lit(False))
    n_qa, expected = F.size("qa_pairs"), F.when(scene, 5).otherwise(3)
    top = F.array(
        F.when(~cap.isin(vocab.CAPTURE_TYPES), F.concat(F.lit("bad_capture_type:"), _quoted(cap))),
        F.when(~room.isin(vocab.ROOM_TYPES), F.concat(F.lit("bad_room_type:"), _quoted(room))),
        F.when(F.col("annotator_id") == "", "missing_annotator_id"),
        F.when(~sized, "missing_image_dims"),
        F.when(F.col("_dims_conflict") != "", F.concat(F.lit("dims_conflict("), F.col("_dims_conflict"), F.lit(")"))),
        F.when(n_qa != expected, F.format_string("qa_count=%d(expected %d)", n_qa, expected)),
    )
    types = F.transform("qa_pairs", lambda q: q["type"])
    twice = F.filter(F.array_distinct(types), lambda t: F.size(F.filter(types, lambda u: u == t)) > 1)
    repeated = F.transform(twice, lambda t: F.concat(F.lit("duplicate_qa_type:"), t))

    def pair(q):
        both = F.concat(q["question"], q["answer"])
        say = lambda rule, name: F.when(rule, F.concat(F.lit(f"{name}:"), q["type"]))
        return F.array(say(text.strip(q["question"]) == "", "empty_question"), say(text.strip(q["answer"]) == "", "empty_answer"), say(text.has_latin(both), "latin_chars"), say(text.has_ascii_digit(both), "ascii_digits"))

    one_box = F.array(F.when(scene & (F.size("objects") != 1), F.format_string("scene_boxes=%d(expected 1)", F.size("objects"))))

    def box(o):
        b, name = o["bbox"], F.coalesce(o["bangla_name"], F.lit(""))
        x, y, bw, bh = (F.get(b, F.lit(i)) for i in range(4))
        place = F.when(b.isNull(), "bbox_missing_dims").when(sized & ((bw <= 0) | (bh <= 0)), F.concat(F.lit("bbox_nonpositive:"), o["object_id"])).when(sized & ((x < -1) | (y < -1) | (x + bw > w + 1) | (y + bh > h + 1)), F.concat(F.lit("bbox_out_of_bounds:"), o["object_id"]))
        return F.array(F.when(text.strip(name) == "", "missing_bbox_name"), F.when(text.has_latin(name), "latin_chars_in_bbox_name"), place)

    return F.array_compact(F.flatten(F.array(top, repeated, F.flatten(F.transform("qa_pairs", pair)), one_box, F.flatten(F.transform("objects", box)))))


def problems(records: DataFrame) -> DataFrame:
    """(image_id, problems) of the records that have any."""
    df = records if "_dims_conflict" in records.columns else records.withColumn("_dims_conflict", F.lit(""))
    return df.select("image_id", rules().alias("problems")).where("size(problems) > 0")


def kinds(found: DataFrame) -> DataFrame:
    """How often each kind of problem occurs, most frequent first."""
    return found.select(F.explode("problems").alias("p")).groupBy(scalars.problem_kind(F.col("p")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def item_problems(items: DataFrame, records: DataFrame) -> DataFrame:
    """(image_id, problem) of items and records: no image id, no pair, empty question or answer."""
    blank = lambda c: F.coalesce(text.strip(F.col(c)), F.lit("")) == ""
    none = records.where(F.coalesce("image_id", F.lit("")) == "").select(F.lit("").alias("image_id"), F.lit("no image id").alias("problem"))
    bare = records.where((F.coalesce("image_id", F.lit("")) != "") & (F.size("qas") == 0)).select("image_id", F.lit("no QA").alias("problem"))
    q = items.where(blank("question")).select("image_id", F.concat(F.lit("empty question: "), "qa_id").alias("problem"))
    a = items.where(blank("gold")).select("image_id", F.concat(F.lit("empty answer: "), "qa_id").alias("problem"))
    return none.union(bare).union(q).union(a)


def expected_counts(observed: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """(key, observed, expected, verdict): PASS, MISMATCH, or UNKNOWN for keys that are not expected."""
    want = observed.sparkSession.createDataFrame(sorted(expected.items()), "k string, expected long")
    seen = observed.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("observed"))
    out = seen.join(want, "k", "full").select(F.col("k").alias(key), F.coalesce("observed", F.lit(0)).alias("observed"), "expected")
    return out.withColumn("verdict", F.when(F.col("expected").isNull(), "UNKNOWN").when(F.col("observed") == F.col("expected"), "PASS").otherwise("MISMATCH"))


def totals(items: DataFrame, qa: int = vocab.EXPECTED_QA, images: int = vocab.EXPECTED_IMAGES) -> DataFrame:
    """Lines, distinct ids, images and groups against what is expected; ``ok`` is the verdict."""
    one = items.agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("qa_id").alias("ids"), F.countDistinct("image_id").alias("images"), F.count_if(F.col("group") == "A").alias("group_a"), F.count_if(F.col("group") == "B").alias("group_b"))
    return one.withColumn("ok", (F.col("lines") == qa) & (F.col("ids") == F.col("lines")) & (F.col("images") == images))
