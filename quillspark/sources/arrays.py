"""JSON arrays of objects that are read in byte ranges: one file is parsed by as many tasks as it has splits.

A split's text comes as fragments that end with ``}``, which Spark's text source can cut anywhere in a file. What a range does to the state of a parser depends on
the state it begins in, so each range is first summed up as a table: for a begin outside and inside a string, whether it ends inside one, by how much the depth
changes, and how many objects end at each relative depth. Ranges of a file are chained by prefix sums over these few rows, which gives each range its state and the number of
the element it begins in. A second pass then cuts the top-level elements; those that lie in one range never move, the pieces of the others are put together by number.

An array is taken as a whole or not at all: between elements there must be one comma, at the ends the brackets, and every element must be valid.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: The chained ranges are broadcast to all tasks: so many at most, about 60 bytes each.
MAX_RANGES = 2_000_000
_SPACE = r"[ \t\n\r]*"


def _fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(paths).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.col("value"))


_STEP = np.zeros(256, np.int8)
_STEP[[123, 91]], _STEP[[125, 93]] = 1, -1
_MARK = _STEP != 0
_MARK[34] = True


class _Scan:
    """The fragments' bytes with their separators, and each one's end. Of the bytes, only quotes, braces and brackets are looked at (``marks``). For a begin ``inside`` a string
    or not: which marks are outside of strings, and the change of depth there."""

    def __init__(self, col: pa.Array, separator: str = "}"):
        closed = pc.binary_join_element_wise(col.cast(pa.large_string()), pa.scalar(separator, pa.large_string()), pa.scalar("", pa.large_string()))
        off = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + len(closed) + 1]
        self.data, self.ends = np.frombuffer(closed.buffers()[2], np.uint8)[off[0] : off[-1]], off[1:] - off[0]
        self.marks = np.flatnonzero(_MARK[self.data])
        kind = self.data[self.marks]
        quote, slash = kind == 34, np.flatnonzero(self.data == 92)
        if len(slash):
            # A backslash escapes if it has an odd place in its run.
            place = np.arange(len(slash))
            begins = np.concatenate(([True], np.diff(slash) > 1))
            odd = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            escaped = np.zeros(len(self.data) + 1, bool)
            escaped[slash[odd] + 1] = True
            quote &= ~escaped[self.marks]
        self.within = np.cumsum(quote) % 2 == 1
        self.step = _STEP[kind]

    def states(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        within = self.within ^ inside
        return ~within, np.cumsum(np.where(within, 0, self.step), dtype=np.int64)

    def ended(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """The states at the closing braces of the fragments."""
        at = np.searchsorted(self.marks, self.ends - 1)
        outside, depth = self.states(inside)
        return outside[at], depth[at]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The runs of rows of one range."""
    if not batch.num_rows:
        return
    path, block = batch.column("path"), batch.column("block").to_numpy()
    other = pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield (path[low].as_py(), int(block[low])), batch.slice(low, high - low)


_RANGE = "path string, block long, size long, bytes long, inside array<boolean>, depth array<long>, ends array<map<long,long>>"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RANGE.split(", ")]
    key, row = None, None

    def told():
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.map_(pa.int64(), pa.int64()))]
        values = [*key, row["size"], row["bytes"], row["inside"], row["depth"], [sorted(x.items()) for x in row["ends"]]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    for b in batches:
        for k, part in _parts(b):
            if k != key:
                if row is not None:
                    yield told()
                key, row = k, {"size": part.column("size")[0].as_py(), "bytes": 0, "inside": [False, True], "depth": [0, 0], "ends": [{}, {}]}
            scan = _Scan(part.column("value"))
            for begin in (0, 1):
                outside, depth = scan.ended(row["inside"][begin])
                values, counts = np.unique(row["depth"][begin] + depth[outside], return_counts=True)
                for v, n in zip(values.tolist(), counts.tolist()):
                    row["ends"][begin][v] = row["ends"][begin].get(v, 0) + n
                row["inside"][begin], row["depth"][begin] = not bool(outside[-1]), row["depth"][begin] + int(depth[-1])
            row["bytes"] += len(scan.data)
    if row is not None:
        yield told()


def _chained(ranges: DataFrame) -> DataFrame:
    """The state in which each range begins, the number of elements before it, and whether its file is an array by its ends. Windows run over the ranges of a file."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    flips = F.coalesce(F.sum(F.when(F.col("inside")[0], 1).otherwise(0)).over(before), F.lit(0)) % 2
    r = ranges.withColumn("begin", flips.cast("int"))
    r = r.withColumn("by", F.get("depth", F.col("begin"))).withColumn("level", F.coalesce(F.sum("by").over(before), F.lit(0)))
    r = r.withColumn("n", F.coalesce(F.try_element_at(F.get("ends", F.col("begin")), 1 - F.col("level")), F.lit(0)))
    # The closing brace behind the last fragment isn't in the file.
    sound = (F.sum("bytes").over(whole) == F.col("size") + 1) & (F.sum("by").over(whole) == -1) & (F.sum(F.when(F.col("inside")[0], 1).otherwise(0)).over(whole) % 2 == 0)
    return r.select("path", "block", "begin", "level", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("element"), sound.alias("sound"))


_PIECE = "path string, element long, block long, part long, first boolean, last boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of elements: what one batch has of each."""
    key, inside, depth, element, fresh, part_no = None, False, 0, 0, True, 0
    for b in batches:
        for k, part in _parts(b):
            if k != key:
                key, part_no = k, 0
                inside, depth, element = (part.column(c)[0].as_py() for c in ("begin", "level", "element"))
                # Behind a brace, depth 1 outside of strings is the end of an element.
                fresh = depth < 2 and not inside
            scan = _Scan(part.column("value"))
            outside, by = scan.ended(bool(inside))
            closes, raw = np.flatnonzero(outside & (depth + by == 1)), scan.data.tobytes()
            cuts = [0, *scan.ends[closes].tolist()]
            rest = cuts[-1] < len(raw)
            texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:])] + ([raw[cuts[-1] :].decode("utf-8", "replace")] if rest else [])
            n = len(texts)
            first = np.ones(n, bool)
            first[0] = fresh
            last = np.ones(n, bool)
            if rest:
                last[-1] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0]] * n), pa.array(element + np.arange(n)), pa.array(np.full(n, k[1])), pa.array(np.full(n, part_no)), pa.array(first), pa.array(last), pa.array(texts, pa.string())],
                names=[x.split()[0] for x in _PIECE.split(", ")],
            )
            inside, depth, element, fresh, part_no = not bool(outside[-1]), depth + int(by[-1]), element + len(closes), not rest, part_no + 1


#: Files that Spark reads from begin to end.
PACKED = (".gz", ".deflate", ".lz4", ".snappy", ".zst")
_OPENS, _COMMA = re.compile(rb"[ \t\n\r]*\[[ \t\n\r]*"), re.compile(rb"[ \t\n\r]*,[ \t\n\r]*")
_ELEMENT = "path string, pos long, text string, sound boolean"


def _cut_packed(separator: str):
    """Elements of files that come from begin to end, each whole and without what stands before it, and behind them a row without a place that says whether the file is an
    array by its ends. An element that no bracket or single comma precedes, or that is no object, is not sound. Of a file, no more than a batch and the element that it breaks off in is held."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, element, held = None, False, 0, 0, []

        def bare(text: bytes, first: bool) -> tuple[str, bool | None]:
            head = (_OPENS if first else _COMMA).match(text)
            at = head.end() if head else 0
            return text[at:].decode("utf-8", "replace"), None if head and text[at : at + 1] == b"{" else False

        def rows(texts, pos, sound):
            return pa.RecordBatch.from_arrays([pa.array([key] * len(texts), pa.string()), pa.array(pos, pa.int64()), pa.array(texts, pa.string()), pa.array(sound, pa.bool_())], names=[x.split()[0] for x in _ELEMENT.split(", ")])

        def told():
            # The separator behind the last fragment isn't in the file.
            rest = b"".join(held)[: -len(separator)]
            sound = not inside and depth + (separator == "}") == 0 and re.fullmatch(rb"[ \t\n\r]*\][ \t\n\r]*" if element else rb"[ \t\n\r]*\[[ \t\n\r]*\][ \t\n\r]*", rest) is not None
            return rows([None], [None], [sound])

        for b in batches:
            for (path, _), part in _parts(b):
                if path != key:
                    if key is not None:
                        yield told()
                    key, inside, depth, element, held = path, False, 0, 0, []
                scan = _Scan(part.column("value"), separator)
                outside, by = scan.states(inside)
                raw, cuts = scan.data.tobytes(), (scan.marks[outside & (scan.step < 0) & (depth + by == 1)] + 1).tolist()
                if cuts:
                    texts = [b"".join([*held, raw[: cuts[0]]]), *[raw[x:y] for x, y in zip(cuts, cuts[1:])]]
                    told_of = [bare(x, not element and not i) for i, x in enumerate(texts)]
                    yield rows([x for x, _ in told_of], element + np.arange(len(texts)), [x for _, x in told_of])
                    held, element = [], element + len(texts)
                held.append(raw[cuts[-1] :] if cuts else raw)
                if len(by):
                    inside, depth = not bool(outside[-1]), depth + int(by[-1])
        if key is not None:
            yield told()

    return cut


def _judged(text: Column) -> tuple[Column, Column]:
    """An element without what stands before it, and whether it is a valid object behind the bracket or one comma."""
    head = F.when(F.col("pos") == 0, rf"^{_SPACE}\[{_SPACE}").otherwise(rf"^{_SPACE},{_SPACE}")
    json = F.regexp_replace(text, head, F.lit(""))
    return json, (F.length(json) < F.length(text)) & json.startswith("{") & F.try_parse_json(json).isNotNull()


def _packed(spark: SparkSession, paths: list[str], separator: str, value: Column, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", separator).text(paths).select(meta["file_path"].alias("path"), F.lit(0).cast("long").alias("block"), F.col("value"))
    cut = lines.mapInArrow(_cut_packed(separator), _ELEMENT).select("path", "pos", F.col("text").alias("json"), F.col("pos").isNotNull().alias("ended"), F.coalesce("sound", F.try_parse_json("text").isNotNull()).alias("good"))
    return pick(cut.select("path", "pos", value, "ended", "good"))


def elements(spark: SparkSession, paths: list[str], schema: str | None = None, separator: str = "}", pick: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> tuple[DataFrame, DataFrame]:
    """(path, pos, json) of the elements of all files that are arrays of objects, and (path, good) of all files that have any text: whether they are. Both come
    from written tables. With a schema, elements are parsed before they are written: (path, pos, task), and ``pick`` says what is kept of the parsed rows.

    Compressed files are read from begin to end, in one pass, each by one task; their text comes cut at ``separator``, which no batch of fragments depends on but in size."""
    value = F.col("json") if schema is None else F.from_json("json", schema).alias("task")
    packed = [p for p in paths if p.endswith(PACKED)]
    plain = [p for p in paths if not p.endswith(PACKED)]
    tables = [t for t in (_plain(spark, plain, value, pick) if plain else None, (scratch.table(_packed(spark, packed, separator, value, pick), "elements"), None) if packed else None) if t]
    found = verdicts = None
    for table, begun in tables:
        # Files are listed by the driver, so their verdicts are few enough for every task.
        of = table.select("path", "good") if begun is None else table.select("path", "good").union(begun)
        found, verdicts = (table, of) if found is None else (found.unionByName(table), verdicts.union(of))
    files = scratch.table(verdicts.groupBy("path").agg(F.min("good").alias("good")), "files")
    for _, begun in tables:
        if begun is not None:
            scratch.release(begun)
    whole = found.where("ended").join(F.broadcast(files.where("good")), "path", "left_semi").drop("ended", "good")
    return scratch.reading(whole, *[table for table, _ in tables]), files


def _plain(spark: SparkSession, paths: list[str], value: Column, pick: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(path, pos, value, ended, good) of what the ranges hold, and (path, good) by the ends of the files; tables both."""
    ranges = scratch.table(_fragments(spark, paths).mapInArrow(_sum_up, _RANGE), "ranges")
    begun = scratch.table(_chained(ranges), "begun")
    if begun.count() > MAX_RANGES:
        raise ValueError("more byte ranges than are broadcast: raise spark.sql.files.maxPartitionBytes")
    # A broadcast join keeps the order of the fragments.
    placed = _fragments(spark, paths).join(F.broadcast(begun.where("sound").drop("sound")), ["path", "block"]).select("path", "block", "value", "begin", "level", "element")
    pieces = scratch.table(placed.mapInArrow(_cut, _PIECE), "pieces")
    whole = pieces.where("first and last").select("path", F.col("element").alias("pos"), "text", F.lit(True).alias("ended"))
    parts = pieces.where("not first or not last").groupBy("path", F.col("element").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"), F.max("last").alias("ended"))
    every = whole.unionByName(parts.select("path", "pos", F.array_join("p.text", "").alias("text"), "ended"))
    # The rest of a file holds the closing bracket, and the opening one if there is no element.
    tail = F.when(F.col("pos") == 0, F.col("text").rlike(rf"^{_SPACE}\[{_SPACE}\]{_SPACE}\}}$")).otherwise(F.col("text").rlike(rf"^{_SPACE}\]{_SPACE}\}}$"))
    json, sound = _judged(F.col("text"))
    good = F.when(F.col("ended"), sound).otherwise(tail)
    judged = every.select("path", "pos", json.alias("json"), "ended", F.coalesce(good, F.lit(False)).alias("good"))
    found = scratch.table(pick(judged.select("path", "pos", value, "ended", "good")), "elements")
    ends = scratch.table(begun.select("path", F.col("sound").alias("good")), "ends")
    scratch.release(ranges, begun, pieces)
    return found, ends
