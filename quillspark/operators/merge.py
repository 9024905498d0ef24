"""Annotation merge: nested tasks become validated records.

The regions of a task stay in its row; a shuffle of ids and places tells the last task of each id, and records are made of those. Audits read all
tasks, so they also cover those that later drop out.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry, scalars, text
from ..sources import scratch
from .items import largest


@dataclass(frozen=True)
class MergeOptions:
    keep_closeup_room: bool = False
    min_box_area_pct: float = vocab.MIN_BOX_AREA_PCT
    min_box_side_px: int = vocab.MIN_BOX_SIDE_PX
    clip_boxes: bool = True
    keep_excluded: bool = False
    #: An id that any export excludes leaves the records too.
    strict_exclusion: bool = False


def pick(tasks: DataFrame) -> DataFrame:
    """``task`` becomes task_id, image_id, house_id, the result of the first annotation that is neither cancelled nor empty, what it excludes the image for, and ``issue`` where
    a task gives no record; the other columns stay. ``readers.exports`` takes this, so that what no output reads is never written."""
    t = F.col("task")
    real = F.filter(t["annotations"], lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)) & (F.coalesce(F.size(a["result"]), F.lit(0)) > 0))
    others = [c for c in tasks.columns if c != "task"]
    out = tasks.select(*others, t["id"].alias("task_id"), scalars.image_id(t["file_upload"], t["data"]["image"]).alias("image_id"), F.get(real, F.lit(0))["result"].alias("result"))
    reasons = F.filter("result", lambda r: (r["type"] == "choices") & (r["from_name"] == "exclude"))
    exclude = F.coalesce(F.get(F.try_element_at(reasons, F.lit(-1))["value"]["choices"], F.lit(0)), F.lit(""))
    issue = F.when(F.col("image_id").isNull(), "no_image_id").when(F.col("result").isNull(), "skipped_or_empty")
    return out.select("*", scalars.house_id(F.col("image_id")).alias("house_id"), exclude.alias("_exclude"), issue.alias("issue"))


def picked(tasks: DataFrame) -> DataFrame:
    """Tasks as ``pick`` leaves them."""
    return pick(tasks.select("file_no", "file", "pos", "task")) if "task" in tasks.columns else tasks


def _text(value: Column) -> Column:
    """A text area holds a list of strings or one string; its JSON type tells, not how it begins."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), text.join_parts(F.try_variant_get(value, "$", "array<string>"))).when(kind != "VOID", F.try_variant_get(value, "$", "string"))


def regions(tasks: DataFrame) -> DataFrame:
    """One row for each entry of the picked results, with its position; text areas have their raw text."""
    r = tasks.where("issue is null").select("file_no", "pos", "image_id", F.posexplode("result").alias("at", "r"))
    return r.select("file_no", "pos", "image_id", "at", F.col("r.from_name").alias("field"), F.col("r.id").alias("region"), F.col("r.type").alias("type"), F.col("r.original_width").alias("ow"), F.col("r.original_height").alias("oh"), F.get(F.col("r.value.choices"), F.lit(0)).alias("choice"), _text(F.col("r.value.text")).alias("raw"), F.struct("r.value.x", "r.value.y", "r.value.width", "r.value.height").alias("v"))


def _entries(of: str, when, key: str, value) -> Column:
    """(k, v) of the regions in their order that ``when`` picks and that have a key."""
    return F.transform(F.filter(of, lambda r: when(r) & r[key].isNotNull()), lambda r: F.struct(r[key].alias("k"), value(r).alias("v")))


def _last_of_each(name: str) -> Column:
    """The last of the entries of each key."""
    e = F.col(name)
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]))
    once = F.size(F.array_distinct(F.transform(e, lambda x: x["k"]))) == F.size(e)
    return F.when(once, e).otherwise(last)


def _to_map(name: str) -> Column:
    """A map of entries that keeps the last of each key."""
    return F.map_from_entries(_last_of_each(name))


_PLACED = ("bangla_name", "bbox", "bbox_pct", "over_px", "lost", "out_of_frame", "clipped", "empty_after_clip")


def in_place(boxes: str | Column, at) -> Column:
    """Boxes in the order of their place: by y, then x, each to four digits, then by what ``at`` (x, y, tie) gives third."""

    def key(b):
        x, y, tie = at(b)
        return F.struct(geometry.signed_round(y, 4).alias("y4"), geometry.signed_round(x, 4).alias("x4"), tie.alias("tie"), b.alias("box"))

    return F.transform(F.array_sort(F.transform(boxes, key)), lambda z: z["box"])


def records(tasks: DataFrame, assignment: DataFrame, manifest: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """Internal records of all tasks that give one: the release columns, ``_``-prefixed internals, and file_no, pos.

    ``_boxes`` keeps all boxes, also those dropped as degenerate, for the audits."""
    areas = F.transform(F.filter("result", lambda r: r["type"] == "textarea"), lambda r: F.struct(r["from_name"].alias("field"), r["id"].alias("region"), _text(r["value"]["text"]).alias("raw")))
    found = tasks.where("issue is null").select("file_no", "pos", "image_id", "result", areas.alias("areas"))
    found = found.withColumn("clean", text.clean_each_for_storage(F.transform("areas", lambda a: a["raw"])))
    found = found.withColumn("areas", F.zip_with("areas", "clean", lambda a, c: F.struct(a["field"].alias("field"), a["region"].alias("region"), c.alias("clean"))))
    box = lambda r: F.struct(r["value"]["x"].alias("x"), r["value"]["y"].alias("y"), r["value"]["width"].alias("w"), r["value"]["height"].alias("h"), r["original_width"].alias("ow"), r["original_height"].alias("oh"))
    is_name = lambda a: F.coalesce(a["field"] == "bbox_name", F.lit(False))
    parts = {
        "_choices": _entries("result", lambda r: r["type"] == "choices", "from_name", lambda r: F.get(r["value"]["choices"], F.lit(0))),
        "_fields": _entries("areas", lambda a: ~is_name(a), "field", lambda a: a["clean"]),
        "_names": _entries("areas", is_name, "region", lambda a: a["clean"]),
        "_rects": _entries("result", lambda r: r["type"] == "rectanglelabels", "id", box),
    }
    by_task = found.select("file_no", "pos", "image_id", *[c.alias(n) for n, c in parts.items()])
    by_task = by_task.select("file_no", "pos", "image_id", *[_to_map(n).alias(n) for n in parts]).withColumn("house_id", scalars.house_id(F.col("image_id")))
    man = manifest.select("image_id", scalars.as_int(F.col("final_width")).alias("_mw"), scalars.as_int(F.col("final_height")).alias("_mh"))
    out = by_task.join(man, "image_id", "left").join(assignment.select("house_id", "annotator_id"), "house_id", "left")
    choice = lambda k: F.coalesce(F.try_element_at("_choices", F.lit(k)), F.lit(""))
    known = lambda w, h: F.coalesce((F.col(w) != 0) & (F.col(h) != 0), F.lit(False))
    dims = F.array_sort(F.array_distinct(F.transform(F.filter(F.map_values("_rects"), lambda b: (F.coalesce(b["ow"], F.lit(0)) != 0) & (F.coalesce(b["oh"], F.lit(0)) != 0)), lambda b: F.struct(b["ow"].alias("w"), b["oh"].alias("h")))))
    out = out.withColumn("_dims", dims)
    shown = F.concat(F.lit("["), F.array_join(F.transform("_dims", lambda d: F.format_string("(%d, %d)", d["w"], d["h"])), ", "), F.lit("]"))
    clash = known("_mw", "_mh") & (F.size("_dims") > 0) & ~F.array_contains("_dims", F.struct(F.col("_mw").alias("w"), F.col("_mh").alias("h")))
    fallback = ~known("_mw", "_mh") & (F.size("_dims") > 0)
    out = out.select(
        "*",
        F.when(fallback, F.get("_dims", F.lit(0))["w"]).otherwise(F.col("_mw")).alias("image_w"),
        F.when(fallback, F.get("_dims", F.lit(0))["h"]).otherwise(F.col("_mh")).alias("image_h"),
        F.when(clash, F.concat(F.format_string("manifest=%dx%d ls=", "_mw", "_mh"), shown)).otherwise("").alias("_dims_conflict"),
        choice("capture_type").alias("capture_type"),
        choice("room_type").alias("_room_raw"),
        choice("exclude").alias("_exclude"),
    )
    room = F.col("_room_raw") if options.keep_closeup_room else F.when(F.col("capture_type") == "closeup", "NA").otherwise(F.col("_room_raw"))

    def placed(e: Column) -> Column:
        v = e["value"]
        g = geometry.box(v["x"], v["y"], v["w"], v["h"], v["ow"], v["oh"], options.clip_boxes)
        return F.struct(
            F.coalesce(F.try_element_at(F.col("_names"), e["key"]), F.lit("")).alias("bangla_name"), g["px"].alias("bbox"), g["pct"].alias("bbox_pct"), g["over_px"].alias("over_px"), g["lost"].alias("lost"),
            g["out_of_frame"].alias("out_of_frame"), g["clipped"].alias("clipped"), g["empty_after_clip"].alias("empty_after_clip"),
        )

    # Columns one by one: nested functions take Spark's analysis many times as long, and a function over what another has made computes it once.
    out = out.withColumn("_boxes", in_place(F.map_entries("_rects"), lambda e: (e["value"]["x"], e["value"]["y"], e["key"])))
    out = out.withColumn("_boxes", F.transform("_boxes", placed))
    judged = lambda b: geometry.degenerate(b["bbox"], b["lost"], options.min_box_area_pct, options.min_box_side_px).alias("degenerate")
    numbered = F.transform("_boxes", lambda b, i: F.struct(scalars.slot_id(F.col("image_id"), "b", i + 1).alias("object_id"), *[b[c].alias(c) for c in _PLACED], judged(b)))
    out = out.withColumn("room_type", room).withColumn("_boxes", numbered)
    objects = F.transform(F.filter("_boxes", lambda b: ~b["degenerate"]), lambda b: F.struct(b["object_id"], b["bangla_name"], b["bbox"], b["bbox_pct"]))

    def pairs(slots):
        field = lambda k: F.coalesce(F.try_element_at("_fields", F.lit(k)), F.lit(""))
        each = F.array(*[F.struct(F.concat(F.col("image_id"), F.lit(f"_q{n}")).alias("qa_id"), F.lit(t).alias("type"), field(q).alias("question"), field(a).alias("answer")) for n, t, q, a in slots])
        return F.filter(each, lambda p: (p["question"] != "") | (p["answer"] != ""))

    return out.select(
        "file_no", "pos", "image_id", "house_id", F.coalesce("annotator_id", F.lit("")).alias("annotator_id"), scalars.image_file(F.col("house_id"), F.col("image_id")).alias("image_file"), "image_w", "image_h", "capture_type", "room_type",
        objects.cast(f"array<{vocab.BOX}>").alias("objects"), F.when(F.col("capture_type") == "closeup", pairs(vocab.OBJECT_SLOTS)).otherwise(pairs(vocab.SCENE_SLOTS)).alias("qa_pairs"), "_room_raw", "_exclude", "_dims_conflict", "_boxes",
    )


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Rows of a key are merged as they are read, so a hot key needs no sort of all its rows."""
    value = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_r")).select("_r.*")


@dataclass
class Merged:
    records: DataFrame
    excluded: DataFrame
    degenerate: DataFrame
    issues: DataFrame
    tasks: DataFrame
    all_records: DataFrame
    problems: DataFrame
    #: A row for each box of all records.
    boxes: DataFrame | None = None


def merge(tasks: DataFrame, assignment: DataFrame, manifest: DataFrame, options: MergeOptions = MergeOptions()) -> Merged:
    """Routes records: kept, excluded, dropped for lack of a usable box; and the issues of tasks and ids. The last task of each id and route is told before any record is
    made, and only those records are written; those of all tasks, and their boxes, are made for the audits that read them."""
    seen = scratch.table(picked(tasks), "tasks") if "task" in tasks.columns else tasks
    last = scratch.table(_last_places(seen.where("issue is null"), options), "last")
    sizes = sizes_of(manifest, last)
    only = records(seen.join(last.select("_at"), _place() == F.col("_at"), "left_semi"), assignment, sizes, options)
    return routes(seen, records(seen, assignment, sizes, options), scratch.table(only.withColumn("_out", _out(options)), "records"), options, boxes(seen, options))


def _place() -> Column:
    """A number that orders tasks by file and position."""
    return F.shiftleft(F.col("file_no").cast("long"), 32) + F.col("pos")


def sizes_of(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """The sizes of the images that are found; without the others a join is a broadcast if few are left."""
    return scratch.table(manifest.select("image_id", "final_width", "final_height").join(found.select("image_id").distinct(), "image_id", "left_semi"), "sizes")


def _out(options: MergeOptions) -> Column:
    return F.lit(False) if options.keep_excluded else F.col("_exclude") != ""


def _last_places(df: DataFrame, options: MergeOptions) -> DataFrame:
    """(image_id, _at): the last place of each id and route. Only ids and places are grouped."""
    return df.groupBy("image_id", _out(options).alias("_out")).agg(F.max(_place()).alias("_at")).select("image_id", "_at")


def last_routed(every: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """The last record of each id and route; ``_out`` is the route. The records that are picked keep their columns apart, so an output reads those that it needs."""
    last = scratch.table(_last_places(every, options).select("_at"), "last")
    return every.withColumn("_out", _out(options)).join(last, _place() == F.col("_at"), "left_semi")


def boxes(tasks: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """A row for each box of the records of all tasks, as ``_boxes`` has them but for their names: file_no, pos, image_id, i, object_id, bbox, over_px and so on."""
    r = F.filter("result", lambda r: (r["type"] == "rectanglelabels") & r["id"].isNotNull())
    box = F.transform(r, lambda r: F.struct(r["id"].alias("k"), r["value"]["x"].alias("x"), r["value"]["y"].alias("y"), r["value"]["width"].alias("w"), r["value"]["height"].alias("h"), r["original_width"].alias("ow"), r["original_height"].alias("oh")))
    found = tasks.where("issue is null").select("file_no", "pos", "image_id", box.alias("b"))
    found = found.select("file_no", "pos", "image_id", _last_of_each("b").alias("b")).withColumn("b", in_place("b", lambda b: (b["x"], b["y"], b["k"])))
    each = found.select("file_no", "pos", "image_id", F.posexplode("b").alias("i", "b")).select("file_no", "pos", "image_id", "i", "b.*")
    g = geometry.box(*[F.col(c) for c in ("x", "y", "w", "h", "ow", "oh")], options.clip_boxes)
    each = each.select("file_no", "pos", "image_id", "i", g["px"].alias("bbox"), *[g[c].alias(c) for c in ("over_px", "lost", "out_of_frame", "clipped", "empty_after_clip")])
    degenerate = geometry.degenerate(F.col("bbox"), F.col("lost"), options.min_box_area_pct, options.min_box_side_px)
    return each.select("*", scalars.slot_id(F.col("image_id"), "b", F.col("i") + 1).alias("object_id"), degenerate.alias("degenerate"))


def issues(seen: DataFrame) -> DataFrame:
    """(file, id, image_id, issue) of tasks that give no record, and of records whose id came before."""
    # Ids and first places are grouped before they meet the tasks, so an id that all tasks have is no group of all tasks.
    given = seen.where("issue is null").select("file", "image_id", _place().alias("at"))
    again = given.join(given.groupBy("image_id").agg(F.min("at").alias("first")), "image_id").where("at > first")
    # A task without a record is known by its own id, a record that comes again by its image's.
    return seen.where("issue is not null").select("file", F.col("task_id").alias("id"), "image_id", "issue").union(again.select("file", F.col("image_id").alias("id"), "image_id", F.lit("duplicate_image_id_across_exports").alias("issue")))


def routes(seen: DataFrame, every: DataFrame, last: DataFrame, options: MergeOptions = MergeOptions(), boxes: DataFrame | None = None) -> Merged:
    """What a merge gives, of all tasks, all records and the last record of each id and route; boxes are those of all records."""
    from .validate import problems

    if options.strict_exclusion:  # two rows of an id at most
        last = last_wins(last.withColumn("_out", F.max("_out").over(Window.partitionBy("image_id"))), ["image_id", "_out"], ["file_no", "pos"])
    kept, excluded = last.where("not _out"), last.where("_out").drop("_out")
    lost = F.col("capture_type").isin(vocab.SCENE_CAPTURES) & (F.size("objects") == 0)
    good = kept.where(~lost).drop("_out")
    if boxes is None:
        boxes = every.select("file_no", "pos", "image_id", F.posexplode("_boxes").alias("i", "b")).select("file_no", "pos", "image_id", "i", "b.*")
    return Merged(good, excluded, kept.where(lost).drop("_out"), issues(seen), seen, every, problems(good), boxes)


def text_audit(tasks: DataFrame) -> DataFrame:
    """What cleaning changed in all text areas of all tasks, one row."""
    raw = regions(tasks).where("type = 'textarea'")
    return text.storage_audit(raw, "raw")


def clip_audit(every: DataFrame) -> DataFrame:
    """Of all records, or of their boxes as rows: counts of boxes past the frame, and the spread of how far they reach out and what they lose. Both are rounded to a tenth or a hundredth, so they
    are counted by value, and the (upper) median is the value at which the counts reach the middle; no value is collected."""
    b = every.select(F.explode("_boxes").alias("b")).select("b.*") if "_boxes" in every.columns else every
    totals = b.agg(*[F.count_if(c).alias(c) for c in ("out_of_frame", "clipped", "empty_after_clip")], F.count_if("degenerate").alias("dropped_degenerate"), F.count_if(F.col("over_px") > 0).alias("reaching_out"))
    values = b.where("over_px > 0").select(F.explode(F.create_map(F.lit("overflow_px"), F.col("over_px"), F.lit("area_lost_pct"), F.col("lost"))).alias("k", "v"))
    counts = values.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    # Windows over the distinct rounded values of each of the two measures.
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("v"))).withColumn("all", F.sum("n").over(Window.partitionBy("k")))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("v")))
    spread = upto.groupBy("k").agg(F.min("v").alias("min"), middle.alias("median"), F.max("v").alias("max"))
    flat = spread.agg(*[F.max(F.when(F.col("k") == k, F.col(x))).alias(f"{k}_{x}") for k in ("overflow_px", "area_lost_pct") for x in ("min", "median", "max")])
    return totals.join(flat, F.lit(True))


def worst_boxes(every: DataFrame, n: int = 10) -> DataFrame:
    b = every
    if "_boxes" in every.columns:
        b = every.select("file_no", "pos", F.posexplode("_boxes").alias("i", "b")).select("file_no", "pos", "i", "b.object_id", "b.over_px", "b.lost")
    return largest(b.where("over_px > 0"), "over_px", ["file_no", "pos", "i"], n).select("object_id", "over_px", "lost")


def room_fixes(every: DataFrame) -> DataFrame:
    """Close-ups whose room label was set to NA."""
    return every.where("capture_type = 'closeup' and room_type = 'NA' and _room_raw <> 'NA'").select("image_id", F.col("_room_raw").alias("was"))


def _accounts(m: Merged, manifest: DataFrame) -> dict[str, DataFrame]:
    ids = manifest.select("image_id").distinct()
    routed = {"in_dataset": m.records, "excluded": m.excluded, "dropped_degenerate": m.degenerate}
    tagged = scratch.table(reduce(DataFrame.union, [df.select("image_id", F.lit(k).alias("side")).distinct() for k, df in routed.items()]), "accounts")
    some = lambda df: df.select("image_id").distinct()
    annotated = some(tagged)
    skips = some(m.tasks.where("issue = 'skipped_or_empty'")).join(ids, "image_id", "left_semi")
    gap = ids.join(annotated.union(skips), "image_id", "left_anti")
    extra = annotated.join(ids, "image_id", "left_anti")
    return {"manifest_total": ids, **{k: tagged.where(F.col("side") == k).select("image_id") for k in routed}, "intentional_skips": skips, "real_gap": gap, "extra_not_in_manifest": extra}


def completeness(m: Merged, manifest: DataFrame, accounts: dict[str, DataFrame] | None = None) -> DataFrame:
    """How many manifest images are accounted for; one row of counts. ``gaps`` has the ids."""
    every = None
    parts = accounts or _accounts(m, manifest)
    for k, df in parts.items():
        one = df.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"))
        every = one if every is None else every.union(one)
    return every.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k if k not in ("real_gap", "extra_not_in_manifest") else f"{k}_count") for k in parts])


def gaps(m: Merged, manifest: DataFrame, accounts: dict[str, DataFrame] | None = None) -> DataFrame:
    """(image_id, side) of the ids that are in the manifest only (real_gap) or in the records only (extra_not_in_manifest)."""
    parts = accounts or _accounts(m, manifest)
    tag = lambda k: parts[k].select("image_id", F.lit(k).alias("side"))
    return tag("real_gap").union(tag("extra_not_in_manifest"))


def release_counts(kept: DataFrame) -> DataFrame:
    scene = F.col("capture_type").isin(vocab.SCENE_CAPTURES)
    return kept.agg(F.count(F.lit(1)).alias("total"), F.count_if(scene).alias("scene"), F.count_if(F.col("capture_type") == "closeup").alias("closeup"), F.coalesce(F.sum(F.size("qa_pairs")), F.lit(0)).alias("qa_pairs"), F.coalesce(F.sum(F.size("objects")), F.lit(0)).alias("boxes"))


def counts_map(df: DataFrame, key: Column, name: str) -> DataFrame:
    """A one-row map from key to count."""
    g = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit("")).alias("k"), "n")))).alias(name))


def report(m: Merged, manifest: DataFrame, out_file: str, options: MergeOptions = MergeOptions(), parts: Collection[str] | None = None) -> DataFrame:
    """The nested merge report, one row of counts and of maps over houses' annotators, captures and rooms; its parts are one-row frames that are put side by
    side. What grows with the records is in ``report_tables``, and here as a number of rows. A report of some ``parts`` reads and writes nothing for the others."""
    row = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    asked = lambda *names: parts is None or not set(names).isdisjoint(parts)
    # The boxes of all records are judged once for the audit and the numbers of rows.
    audited = scratch.table(m.boxes.select("out_of_frame", "clipped", "empty_after_clip", "degenerate", "over_px", "lost"), "boxes") if asked("bbox_clipping", "rows") else None
    accounts = _accounts(m, manifest) if asked("completeness", "rows") else None

    def sizes():
        tables = report_tables(m, manifest, accounts) | {"clipped_boxes": audited.where("over_px > 0"), "dropped_boxes": audited.where("degenerate")}
        each = reduce(DataFrame.union, [df.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n")) for k, df in tables.items()])
        return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("rows"))  # a row for each table

    made = {
        "counts": lambda name: row(release_counts(m.records), name),
        "records_with_box_by_capture": lambda name: counts_map(m.records.where("size(objects) > 0"), F.col("capture_type"), name),
        "normalization": lambda name: row(text_audit(m.tasks), name),
        "bbox_clipping": lambda name: row(clip_audit(audited), name),
        "capture_x_room": lambda name: counts_map(m.records, F.concat_ws("|", "capture_type", "room_type"), name),
        "images_per_annotator": lambda name: counts_map(m.records, F.col("annotator_id"), name),
        "completeness": lambda name: row(completeness(m, manifest, accounts), name),
        "rows": lambda name: sizes(),
    }
    if unknown := set(parts or ()) - set(made):
        raise ValueError(f"a report has no {sorted(unknown)}; it has {list(made)}")
    out = m.records.sparkSession.range(1).select(F.lit(vocab.SCHEMA_VERSION).alias("schema_version"), F.lit(out_file).alias("out_file"), F.struct(F.lit(options.min_box_area_pct).alias("min_area_pct"), F.lit(options.min_box_side_px).alias("min_side_px")).alias("thresholds"))
    for name, part in made.items():
        if asked(name):
            out = out.join(part(name), F.lit(True))
    return out


def report_tables(m: Merged, manifest: DataFrame, accounts: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The lists of the merge report, a table each."""
    boxes = m.all_records.select("image_id", F.explode("_boxes").alias("b")).select("image_id", "b.*")
    return {
        "clipped_boxes": boxes.where("over_px > 0").select("image_id", "object_id", "over_px", "lost"),
        "dropped_boxes": boxes.where("degenerate").select("image_id", "object_id", "bbox", "bangla_name", (100.0 - F.col("lost")).alias("kept_area_pct")),
        "dropped_degenerate": m.degenerate.select("image_id"),
        "closeup_room_normalized": room_fixes(m.all_records),
        "no_annotator_id": m.records.where("annotator_id = ''").select("image_id"),
        "excluded": m.excluded.select("image_id", F.col("_exclude").alias("reason")),
        "skipped_ids": m.tasks.where("issue = 'skipped_or_empty'").select("image_id").distinct(),
        "validation": m.problems.select("image_id", "problems"),
        "duplicates": m.issues.where("issue = 'duplicate_image_id_across_exports'").select("id"),
        "gaps": gaps(m, manifest, accounts),
    }
