"""SpotSigs fingerprints, in DataFrame functions only.

A signature is a common word (anchor) with the next ``CHAIN`` content words that follow within ``REACH`` words; content words are
those that are no anchors. A document's fingerprint is the digest of its set of distinct signatures. ``report`` compares given
pairs of sets by plain Jaccard similarity, as each pair's exact value is asked for; sizes bound nothing there.

``join`` finds all similar pairs of classes of equal sets: sets are partitioned by size, so that similar sets are in one partition or in
neighbouring ones, and a pair whose sizes leave room for the threshold is compared if it shares one of the rarest signatures of both that the threshold
leaves room for (prefix filtering), which loses none.

Defined cases: words are runs of letters and digits, lower-cased; a text without any signature has its distinct words
as signatures, so that unlike texts stay unlike; a text without words has the empty set, alike (1.0) only to another empty set; a
null text is empty; a very long one is one row's memory in one task. A document's next is that of the next smaller doc_id, and after the smallest comes the largest; rows that share a doc_id
follow one another in the order of their texts; a single row is its own next; null doc_ids are no neighbours and have an empty text for their next. An empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .quality import let

CHAIN, REACH = 2, 8
#: Common words of the corpus languages.
ANCHORS = (
    "a an the is was are be of and or to in on for that this with by it as at "
    "le la les des du de un une et est que qui en au aux par pour dans pas "
    "der die das und den dem ein eine ist zu von mit im nicht auf für als auch "
    "el los las y no una es por con para del al se lo su"
).split()


def signatures(text: Column) -> Column:
    """The sorted distinct 64-bit signatures of a text."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")
    common = sorted(set(ANCHORS))

    def chain(w, x, i):
        content = F.filter(F.slice(w, i + 2, REACH), lambda y: ~y.isin(common))
        return F.when(x.isin(common), let(content, lambda c: F.when(F.size(c) >= CHAIN, F.xxhash64(x, *[F.get(c, F.lit(k)) for k in range(CHAIN)]))))

    def of(w):
        spots = F.filter(F.transform(w, lambda x, i: chain(w, x, i)), lambda s: s.isNotNull())
        return let(spots, lambda s: F.sort_array(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(F.transform(w, lambda x: F.xxhash64(x))))))

    return let(words, of)


def fingerprint(sigs: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sigs, lambda x: F.hex(x)), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(both / (F.size(a) + F.size(b) - both))


def range_part(ids: DataFrame, n: int) -> Column:
    """A column that deals doc_ids into about ``n`` ranges of as many rows each. The ranges' borders are found by the cell of an
    even grid that the id falls in, so that a row looks at the few borders of its cell only. Borders and grid are one constant of the plan; ids
    may be any longs."""
    lo, hi, borders = ids.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()
    if lo is None:
        return F.lit(0)
    cells = 4 * n
    width = (hi - lo) // cells + 1
    borders = sorted(set(borders))
    before = [0] * (cells + 1)  # borders in the cells before each
    for b in borders:
        before[(b - lo) // width + 1] += 1
    for i in range(cells):
        before[i + 1] += before[i]
    grid = F.from_json(F.lit(json.dumps({"before": before, "borders": borders})), "before array<int>, borders array<bigint>")
    cell = F.expr(f"cast((cast(doc_id as decimal(38,0)) - cast('{lo}' as decimal(38,0))) div cast('{width}' as decimal(38,0)) as int)")

    def place(c):
        first = F.get(grid["before"], c)
        inside = F.slice(grid["borders"], first + 1, F.get(grid["before"], c + 1) - first)
        return first + F.size(F.filter(inside, lambda b: b <= F.col("doc_id")))

    return let(cell, place)


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sigs, edited_sigs, next_sigs: the last third of each text is replaced by the beginning of the next
    document's. Each range of doc_ids is ordered by itself, with the first document of the following range as a guest at its end."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    some = own.where("doc_id is not null")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = some.withColumn("part", range_part(some, n))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    ring = Window.orderBy(F.desc("part"))  # a row for each range
    hosts = heads.select("doc_id", F.coalesce(F.lag("part").over(ring), F.last("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"))
    # One row for each range, so its size is bounded by their number; no text is moved to find the guests.
    guests = some.join(F.broadcast(hosts), "doc_id").groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "x.text", "part", F.lit(True).alias("guest"))
    every = dealt.select("doc_id", "text", "part", F.lit(False).alias("guest")).union(guests)
    order = Window.partitionBy("part").orderBy("guest", F.desc("doc_id"), "text")
    length = F.length("text")
    take = F.floor(length / 3).cast("int")

    def edit(head: Column) -> Column:
        return F.concat(F.substring("text", F.lit(1), length - take), F.substring(head, F.lit(1), take))

    near = every.withColumn("edit", edit(F.coalesce(F.lead("text").over(order), F.lit(""))))
    near = near.withColumn("sigs", signatures(F.col("text")))
    near = near.withColumn("next_sigs", F.lead("sigs").over(order)).where("not guest").select("doc_id", "text", "edit", "sigs", "next_sigs")
    lone = own.where("doc_id is null").select("doc_id", "text", edit(F.lit("")).alias("edit"), signatures(F.col("text")).alias("sigs"), signatures(F.lit("")).alias("next_sigs"))
    return near.union(lone).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "sigs", signatures(F.col("edit")).alias("edited_sigs"), "next_sigs")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures."""
    return edited(docs).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


def join(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class) and the pairs of classes (a, b, likeness) of at least ``threshold``, a < b. Classes are documents with
    equal signatures; the empty set is linked with nothing."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    sets = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("sigs")).withColumn("class", F.xxhash64("sigs")), "sets")
    classes = table(sets.where("size(sigs) > 0").groupBy("class").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "classes")
    # Sizes in one step of the scale differ by less than the threshold; similar sets are in the same or the next step.
    step = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(min(threshold, 0.999)))).cast("int")
    each = classes.select("class", "n", step.alias("step"), F.explode("sigs").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("class").orderBy("df", "s")
    prefix = each.join(often, "s").withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = prefix.where("df > 1").select(F.col("class").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    right = prefix.where("df > 1").select(F.col("class").alias("b"), F.col("n").alias("nb"), "s", "step")
    close = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (F.col("a") != F.col("b"))
    found = left.join(right, ["s", "step"]).where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: classes.select(F.col("class").alias(c), F.col("sigs").alias(f"sigs_{c}"))
    pairs = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).where(F.col("likeness") >= threshold)
    return sets.select("doc_id", "class"), pairs
