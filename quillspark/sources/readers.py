"""Sources: annotation exports, record files, CSV dimensions, JSON lines, image folders.

Every reader returns a DataFrame; where order matters (last wins, slots), rows carry ``file`` and ``pos``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import strip
from . import arrays, scratch


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths that match each pattern, sorted pattern by pattern; a pattern without a match stays as it is."""
    out: list[str] = []
    for pattern in patterns:
        fs, p = _fs(spark, pattern)
        hits = sorted(str(x.getPath()) for x in (fs.globStatus(p) or []))
        out += hits or [pattern]
    return out


def expand_outputs(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Output files of folders (``*.jsonl``), patterns and paths, each once; what does not exist is left out."""
    out: dict[str, None] = {}
    for pattern in patterns:
        fs, p = _fs(spark, pattern)
        for hit in sorted(fs.globStatus(p) or [], key=lambda x: str(x.getPath())):
            inside = fs.globStatus(_fs(spark, f"{hit.getPath()}/*.jsonl")[1]) if hit.isDirectory() else [hit]
            for x in sorted(str(i.getPath()) for i in inside or []):
                out[str(fs.resolvePath(_fs(spark, x)[1]))] = None
    return list(out)


def exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def exports(spark: SparkSession, patterns: list[str], separator: str = "}", pick: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> tuple[DataFrame, DataFrame]:
    """Tasks (file_no, file, pos, task) of JSON-array exports in the order of their files, and the files that can't be read. Files are parsed in byte ranges,
    so a large export is the work of many tasks (``arrays``); compressed ones are a task's each, and may be cut at another separator, as line ends. With ``pick``, only what it makes
    of ``task`` is written and returned, and the files themselves are read no more when this returns. ``scratch.release`` deletes what was written."""
    found: list[str] = []
    gone: list[str] = []
    for pattern in patterns:  # one listing for each pattern, none for its files
        fs, p = _fs(spark, pattern)
        hits = sorted(str(x.getPath()) for x in (fs.globStatus(p) or []))
        found += hits
        gone += [] if hits else [pattern]
    missing = spark.createDataFrame([(p, "unreadable") for p in gone], "file string, error string")
    if not found:
        none = pick(spark.createDataFrame([], f"path string, pos int, task {vocab.TASK}"))
        return scratch.reading(none.select(F.lit(0).alias("file_no"), F.col("path").alias("file"), "pos", *none.columns[2:])), missing
    order = spark.createDataFrame([(i, re.sub("^[a-z0-9]+:(//[^/]*)?", "", p)) for i, p in enumerate(found)], "file_no int, file string")
    parsed, files = arrays.elements(spark, sorted(set(found)), vocab.TASK, separator, pick)
    name = F.regexp_replace(F.url_decode("path"), "^[a-z0-9]+:(//[^/]*)?", "")
    named = scratch.table(files.where("good").select("path", name.alias("file")).join(F.broadcast(order), "file"), "order")
    tasks = parsed.join(F.broadcast(named), "path")
    # A file without any text has no entry.
    bad = order.select("file").distinct().join(named.select("file"), "file", "left_anti")
    told = tasks.select("file_no", "file", F.col("pos").cast("int").alias("pos"), *[c for c in parsed.columns if c not in ("path", "pos")])
    return scratch.reading(told, parsed), missing.union(bad.select("file", F.lit("unreadable").alias("error")))


def records(spark: SparkSession, path: str, schema: str = vocab.RELEASE) -> DataFrame:
    """Rows of JSON arrays, which are parsed once, in byte ranges, or of other JSON texts, a file in a task, which is read when they are."""
    found, files = arrays.elements(spark, [path], schema)
    rows = found.select("task.*")
    others = [r.path for r in files.where("not good").collect()]
    return rows.unionByName(spark.read.schema(schema).option("multiLine", True).json(others)) if others else rows


def json_lines(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def done_ids(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Distinct qa_ids of output files; cut-off lines are passed over."""
    paths = expand_outputs(spark, patterns)
    if not paths:
        return spark.createDataFrame([], "qa_id string")
    return spark.read.schema("qa_id string").option("mode", "DROPMALFORMED").json(paths).where("qa_id <> ''").distinct()


def _last(df: DataFrame, key: Column, values: list[str]) -> DataFrame:
    """The last row of each key in file order: position in the file decides."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    keyed = df.select(F.upper(strip(key)).alias("key"), *[F.col(v) for v in values], at.alias("at")).where("key <> ''")
    return keyed.groupBy("key").agg(*[F.max_by(F.coalesce(F.col(v), F.lit("")), "at").alias(v) for v in values])


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header; a byte-order mark is removed and all values are strings."""
    return spark.read.option("header", True).csv(path)


def assignment(spark: SparkSession, path: str | None) -> DataFrame:
    """house_id, annotator_id; a missing file is empty, a missing annotator_id column an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], "house_id string, annotator_id string")
    df = csv(spark, path)
    if "annotator_id" not in df.columns:
        raise ValueError(f"{path} has no annotator_id column; it has {df.columns}")
    return _last(df, F.col("house_id"), ["annotator_id"]).select(F.col("key").alias("house_id"), strip(F.col("annotator_id")).alias("annotator_id"))


def manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """image_id, final_width, final_height as strings, the last row of each id."""
    if not exists(spark, path):
        return spark.createDataFrame([], "image_id string, final_width string, final_height string")
    return _last(csv(spark, path), F.col("image_id"), ["final_width", "final_height"]).withColumnRenamed("key", "image_id")


def splits(spark: SparkSession, path: str | None) -> DataFrame:
    """house_id, split; a missing file is empty, missing columns are an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], "house_id string, split string")
    df = csv(spark, path)
    if not {"house_id", "split"} <= set(df.columns):
        raise ValueError(f"{path} needs the columns house_id and split; it has {df.columns}")
    return _last(df, F.col("house_id"), ["split"]).select(F.col("key").alias("house_id"), strip(F.col("split")).alias("split"))


def _extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "(\\.[^./]*)$", 1))


def store(path: str):
    """The file system that tasks reach a path of Spark in, and the path there. Paths of Spark are not encoded, and a local one has a single slash."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _listed(spark: SparkSession, root: str) -> DataFrame | None:
    """(path) of the files one level below ``root``: the driver lists the folders, tasks what is in them. None where tasks don't reach the store."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/*")
    folders = [str(x.getPath()) for x in fs.globStatus(p) or [] if x.isDirectory()]
    try:
        for f in folders[:1]:
            store(f)
    except (OSError, ValueError, NotImplementedError):
        return None

    def names(batches):
        from pyarrow import fs

        for b in batches:
            for folder in b.column("path").to_pylist():
                files, at = store(folder)
                found = [x.base_name for x in files.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File]
                # As in Spark's own listing, hidden names are none.
                shown = [f"{folder}/{n}" for n in found if n[0] != "." and (n[0] != "_" or "=" in n)]
                yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string())], names=["path"])

    parallel = spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame([(f,) for f in folders], "path string").repartition(max(1, min(len(folders), 4 * parallel))).mapInArrow(names, "path string")
    return listed.repartition(4 * parallel)


def image_folders(spark: SparkSession, root: str, extensions: list[str] = vocab.INGEST_EXTENSIONS, content: bool = True) -> DataFrame:
    """folder, name, path (and content) of the images one level below ``root``. Without content no file is opened, and the files, which may be many and small, are listed in tasks."""
    df = None if content else _listed(spark, root)
    if df is None:
        df = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*")
    parts = F.split("path", "/")
    out = df.where(_extension(F.col("path")).isin(extensions)).select(F.get(parts, F.size(parts) - 2).alias("folder"), F.get(parts, F.size(parts) - 1).alias("name"), "path", *(["content"] if content else []))
    return out


def images(spark: SparkSession, root: str, extensions: list[str] = vocab.RESIZE_EXTENSIONS, content: bool = False) -> DataFrame:
    """name, path (and content) of the images in a flat folder; without content, no file is opened."""
    df = spark.read.format("binaryFile").load(root)
    return df.where(_extension(F.col("path")).isin(extensions)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", *(["content"] if content else []))
