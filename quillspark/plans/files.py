"""Queries that go through files: what is built from the tables is written by the sinks, read back by the sources, and worked on from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import nested, scalars
from ..operators import audit, images, items, runs, stats, validate
from ..sources import readers, scratch, writers
from ..sources.ledger import Ledger
from .registry import query, read

TYPES = list(vocab.GROUPS)
_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
#: Images that one task writes.
_IMAGES = 5000
#: Conversations of one record file.
_RECORDS = 20
_PAIRS = f"""t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS gold FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot, printf('H%02d_%04d', conv_id % 50, conv_id) AS image_id, text AS question, gold FROM t WHERE role = 'user' AND next_role = 'assistant'),
q AS (SELECT *, image_id || '_q' || slot AS qa_id, {_TYPES_SQL}[((conv_id + slot) % 8 + 1)::INT] AS qa_type FROM p),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || qa_id), qa_id) - 1 AS rank FROM q)"""


def _pairs(spark, d) -> DataFrame:
    """(conv_id, image_id, slot, type, question, answer): each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    t = t.where("role = 'user' and next_role = 'assistant'").withColumn("slot", F.row_number().over(w))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col("conv_id") + F.col("slot"), F.lit(8)) + 1).cast("int"))
    return t.select("conv_id", F.format_string("H%02d_%04d", F.pmod("conv_id", F.lit(50)), F.col("conv_id")).alias("image_id"), "slot", kind.alias("type"), "question", "answer")


def _documents(spark, pairs: DataFrame) -> DataFrame:
    """Writes the records of conversations as files of three layouts (a list, a list under a known key, one under another) and reads them back: (json) a file each."""
    r = pairs.groupBy("conv_id", "image_id").agg(F.array_sort(F.collect_list(F.struct("slot", "type", "question", "answer"))).alias("p"))
    pair = F.transform(F.filter("p", lambda x: x["type"].isNotNull()), lambda x: F.struct(x["type"].alias("type"), x["question"].alias("question"), x["answer"].alias("answer")))
    record = F.to_json(F.struct(F.nullif("image_id", F.lit("")).alias("image_id"), pair.alias("qa_pairs")))
    number = F.floor(F.col("conv_id") / _RECORDS)
    one = r.groupBy(number.alias("file")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ","), F.lit("]")).alias("x"))
    kind = F.pmod("file", F.lit(3))
    json = F.when(kind == 0, F.col("x")).when(kind == 1, F.concat(F.lit('{"version": 1, "data": '), "x", F.lit("}"))).otherwise(F.concat(F.lit('{"version": [2], "zzz": '), "x", F.lit("}")))
    path = scratch.folder(spark, "records")
    one.select("file", json.alias("value")).write.partitionBy("file").text(path)
    return spark.read.text(f"{path}/file=*", wholetext=True).select(F.col("value").alias("json"))


@query(f"""WITH {_PAIRS}, todo AS (SELECT rank, qa_id, CASE WHEN qa_type IN ('obj_function', 'assistive') THEN 96 ELSE 32 END AS max_tokens FROM ranked WHERE rank % 5 <> 0 AND rank % 7 <> 0)
SELECT *, row_number() OVER (ORDER BY rank) <= 5 AS shown FROM todo""")
def files_items(spark, d):
    """Record files become items, which are written, read back and planned without those that output files of two folders answer; the first are shown."""
    built, _ = items.build(_documents(spark, _pairs(spark, d)))
    root = scratch.folder(spark, "items")
    writers.items(items.rank_by_hash(built), f"{root}/items")
    ranked = readers.json_lines(spark, f"{root}/items", vocab.ITEMS)
    for name, some in (("a", F.col("rank") % 5 == 0), ("b", F.col("rank") % 7 == 0)):
        ranked.where(some).select("qa_id", F.lit("x").alias("raw_output")).write.json(f"{root}/{name}")
    done = readers.done_ids(spark, [f"{root}/a/part-*", f"{root}/b/*.json", f"{root}/none"])
    planned = runs.plan(ranked, done.withColumn("raw_output", F.lit("x")))
    shown = runs.dry_run(planned, 5).select("qa_id", F.lit(True).alias("shown"))
    return planned.join(shown, "qa_id", "left").select("rank", "qa_id", "max_tokens", F.coalesce("shown", F.lit(False)).alias("shown"))


_ODD = f"""WITH {_PAIRS}, o AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN '' ELSE image_id END AS image_id, qa_id, conv_id % 13 = 0 AS bare, (conv_id + slot) % 6 = 0 AS no_q, (conv_id + slot) % 7 = 0 AS no_a FROM q)"""


@query(f"""{_ODD} SELECT DISTINCT '' AS image_id, 'no image id' AS problem, count(DISTINCT conv_id) AS n FROM o WHERE image_id = '' HAVING count(*) > 0 UNION ALL SELECT DISTINCT image_id, 'no QA', 1 FROM o WHERE image_id <> '' AND bare
UNION ALL SELECT image_id, 'empty question: ' || qa_id, 1 FROM o WHERE image_id <> '' AND NOT bare AND no_q UNION ALL SELECT image_id, 'empty answer: ' || qa_id, 1 FROM o WHERE image_id <> '' AND NOT bare AND no_a""")
def files_problems(spark, d):
    """V2 on record files some of whose records lack an image, all pairs, or texts."""
    p, k = _pairs(spark, d), F.col("conv_id") + F.col("slot")
    p = p.select("conv_id", F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.col("image_id")).alias("image_id"), "slot", F.when(F.col("conv_id") % 13 != 0, F.col("type")).alias("type"), F.when(k % 6 == 0, " ").otherwise(F.col("question")).alias("question"), F.when(k % 7 == 0, "").otherwise(F.col("answer")).alias("answer"))
    built, records = items.build(_documents(spark, p))
    return validate.item_problems(built, records).groupBy("image_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PAIRS}, r AS (SELECT DISTINCT conv_id, (conv_id // {_RECORDS}) % 3 AS k FROM p)
SELECT CASE k WHEN 0 THEN 'top-level list' WHEN 1 THEN 'data' ELSE 'zzz (auto-detected)' END AS name, 'container' AS kind, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'image_id', 'scalar', count(*) FROM r UNION ALL SELECT 'qa_pairs', 'array', count(*) FROM r""")
def files_layout(spark, d):
    """Where the records of each file are, and what keys they have."""
    found = nested.containers(_documents(spark, _pairs(spark, d)))
    by = found.groupBy(F.col("container").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", F.lit("container").alias("kind"), "n")
    return by.union(nested.schema_of(found).select("key", "kind", "n"))


_HOUSE_SPLIT = "CASE WHEN o_custkey % 97 < 50 THEN 'train' WHEN o_custkey % 97 < 70 THEN 'val' WHEN o_custkey % 97 < 90 THEN 'test' ELSE '' END"


@query(f"""WITH l AS (SELECT l_orderkey AS k, count(*) AS boxes FROM lineitem GROUP BY 1), r AS (SELECT o_custkey % 97 AS house, o_custkey % 7 AS a, coalesce(boxes, 0) AS boxes, {_HOUSE_SPLIT} AS split, o_orderstatus AS cap, o_orderpriority AS question, 'C' || o_custkey AS answer FROM orders LEFT JOIN l ON k = o_orderkey),
h AS (SELECT house, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS images_total, count(DISTINCT house) AS houses_total, count(DISTINCT a) AS annotators_total, count(*) AS qa_pairs_total, sum(boxes)::BIGINT AS bounding_boxes_total, max(boxes)::INT AS most_boxes, median(boxes)::DOUBLE AS median_boxes, (SELECT median(n) FROM h)::DOUBLE AS median_house, (SELECT max(n) FROM h) AS largest_house,
median(length(question))::DOUBLE AS q_chars, median(len(list_filter(string_split(question, ' '), lambda x: x <> '')))::DOUBLE AS q_words, max(length(answer))::INT AS a_chars, count(DISTINCT answer) AS unique_answers, count_if(split = 'train')::BIGINT AS train, count_if(cap = 'F')::BIGINT AS capture_f,
count_if(boxes > 0 AND cap = 'O')::BIGINT AS with_box_o, count(DISTINCT cap || '|' || question)::INT AS capture_x_room, (SELECT count(*) FROM r WHERE split = 'val') AS val_images, count_if(question LIKE '1%')::BIGINT AS counted FROM r""")
def files_release(spark, d):
    """S3, S4, S6, K1, AG4, AG5, AG7, AG10 and the rest of the summary: a release is written as one JSON document, read back, and summed up with the splits of a CSV file."""
    # Only line numbers are grouped and joined; boxes are made of them behind that.
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber")).alias("l"))
    object_id = lambda x: F.concat("o_orderkey", F.lit("_b"), x["l_linenumber"])
    box = lambda x: F.struct(object_id(x).alias("object_id"), F.lit("চেয়ার").alias("bangla_name"), F.array(F.lit(0), F.lit(0), F.lit(4), F.lit(3)).alias("bbox"), F.array(F.lit(0.0)).alias("bbox_pct"))
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")), "count").otherwise("object")
    qa = F.array(F.struct(F.concat("o_orderkey", F.lit("_q1")).alias("qa_id"), kind.alias("type"), F.col("o_orderpriority").alias("question"), F.concat(F.lit("C"), "o_custkey").alias("answer")))
    o = read(spark, d, "orders").join(lines, "o_orderkey", "left")
    house = F.concat(F.lit("H"), F.col("o_custkey") % 97)
    r = o.select(F.col("o_orderkey").cast("string").alias("image_id"), house.alias("house_id"), F.concat(F.lit("A"), F.col("o_custkey") % 7).alias("annotator_id"), F.lit("x.jpg").alias("image_file"), F.lit(40).alias("image_w"), F.lit(30).alias("image_h"), F.col("o_orderstatus").alias("capture_type"), F.col("o_orderpriority").alias("room_type"), F.coalesce(F.transform("l", box), F.array().cast(f"array<{vocab.BOX}>")).alias("objects"), qa.alias("qa_pairs"))
    root = scratch.folder(spark, "release")
    writers.document(r, f"{root}.json")
    splits = o.select(house.alias("house_id"), F.expr(_HOUSE_SPLIT).alias("split")).where("split <> ''").distinct()
    splits.write.option("header", True).csv(f"{root}-splits")
    s = stats.summary(readers.records(spark, f"{root}.json"), readers.splits(spark, f"{root}-splits"))
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).cast("long")
    val = F.get(F.filter("per_split", lambda x: x["split"] == "val"), F.lit(0))["images"]
    return s.select(
        "images_total", "houses_total", "annotators_total", "qa_pairs_total", "bounding_boxes_total", F.col("boxes_per_record.max").alias("most_boxes"), F.col("boxes_per_record.median").alias("median_boxes"), F.col("images_per_house.median").alias("median_house"), F.col("images_per_house.max").alias("largest_house"),
        F.col("question_length_chars.median").alias("q_chars"), F.col("question_length_words.median").alias("q_words"), F.col("answer_length_chars.max").alias("a_chars"), "unique_answers", at("split_counts", "train").alias("train"), at("capture_type_counts", "F").alias("capture_f"),
        at("records_with_box_by_capture_type", "O").alias("with_box_o"), F.size("capture_x_room").alias("capture_x_room"), F.coalesce(val, F.lit(0)).alias("val_images"), at("qa_pairs_by_type", "count").alias("counted"),
    )


def _png(w, h):
    """The signature and first chunk of an image of this size, which is all that sizes are read from."""
    number = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w), number(h), F.lit("080200000000000000")))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 40 + 1 AS house, p_size * 100 AS w, p_partkey % 900 + 100 AS h FROM part WHERE p_size % 7 <> 0)
SELECT printf('H%02d_%04d', house, row_number() OVER (PARTITION BY house ORDER BY p_partkey)) AS image_id, printf('%012d.png', p_partkey) AS original_filename, 'House ' || house || '/' || printf('%012d.png', p_partkey) AS original_relpath, w::INT AS orig_width, h::INT AS orig_height FROM p""")
def files_images(spark, d):
    """Image files are written into folders of houses, some of them no images, and those that have a size are numbered for the manifest."""
    p = read(spark, d, "part")
    # Rows are small and files are not: a part of the table in a task is too much to write.
    p = p.select("p_partkey", "p_size").repartition(max(spark.sparkContext.defaultParallelism, p.count() // _IMAGES))
    content = F.when(F.col("p_size") % 7 == 0, F.encode(F.lit("none"), "UTF-8")).otherwise(_png(F.col("p_size") * 100, F.col("p_partkey") % 900 + 100))
    # Names sort as numbers do.
    name = F.concat(F.lit("House "), F.col("p_partkey") % 40 + 1, F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(".png"))
    root = scratch.folder(spark, "images")
    writers.images(p.select(name.alias("dst_name"), content.alias("content")), root)
    found = readers.image_folders(spark, root, content=False)
    sizes = images.sized(found).withColumn("ok", F.col("w").isNotNull())
    writers.manifest(images.manifest(images.number(sizes)), f"{root}-manifest")
    m = readers.csv(spark, f"{root}-manifest")
    return m.select("image_id", "original_filename", "original_relpath", scalars.as_int(F.col("orig_width")).alias("orig_width"), scalars.as_int(F.col("orig_height")).alias("orig_height"))


class FailsInRuns(runs.Answerer):
    """The last word of the question; fails on seven items in a row of each thirty-seven from the third hundred on, and on five before."""

    def answer(self, item: dict) -> str:
        if item["rank"] % 37 >= (30 if item["rank"] >= 100 else 32):
            raise RuntimeError("no answer")
        return (item["question"] or "").split()[-1]


@query(f"""WITH {_PAIRS}, f AS (SELECT rank, qa_id, question, rank % 37 >= CASE WHEN rank >= 100 THEN 30 ELSE 32 END AS failed FROM ranked),
i AS (SELECT *, row_number() OVER (ORDER BY rank) - row_number() OVER (PARTITION BY failed ORDER BY rank) AS island FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY failed, island ORDER BY rank) AS k FROM i)
SELECT qa_id, CASE WHEN failed THEN '' ELSE list_last(list_filter(string_split_regex(question, '\\s+'), lambda x: x <> '')) END AS raw_output, 0 AS shard FROM n WHERE rank < coalesce((SELECT min(rank) FROM n WHERE failed AND k = 7), 9223372036854775807)""")
def run_answers(spark, d):
    """All items are answered in many tasks, with failures; seven in a row end the run. The responses are committed to a ledger and read back from it."""
    ranked = items.rank_by_hash(items.build(_documents(spark, _pairs(spark, d)))[0])
    options = runs.RunOptions(model_id="m", max_consecutive_errors=7)
    made = runs.run(runs.plan(ranked, None, options), FailsInRuns, options)
    path = scratch.folder(spark, "responses")
    writers.responses(made.drop("error").withColumns({"model_tag": F.lit("m"), "shard": F.lit(0)}), path, "run")
    return Ledger(spark, path).read().select("qa_id", "raw_output", "shard")


_ANSWER = "CASE conv_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '৩টি' ELSE gold END"


@query(f"""WITH {_PAIRS}, a AS (SELECT qa_id, qa_type AS type, {_ANSWER} AS answer FROM q) SELECT qa_id, type = 'count' AS counts, CASE WHEN regexp_matches(answer, '[0-9]') THEN 'ASCII' ELSE 'Bangla' END AS kind FROM a WHERE regexp_matches(answer, '[0-9০-৯]')""")
def answer_digits(spark, d):
    """Pairs of records whose answer holds a digit."""
    p = _pairs(spark, d).withColumnRenamed("answer", "gold")
    qa = F.struct(F.concat("image_id", F.lit("_q"), "slot").alias("qa_id"), "type", "question", F.expr(_ANSWER).alias("answer"))
    records = p.groupBy("image_id").agg(F.collect_list(qa).alias("qa_pairs"))
    return audit.digits(audit.pairs(records)).select("qa_id", "counts", "kind")
