"""Sinks: release and report JSON, CSV manifest, JSON lines, append-only responses."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from . import scratch
from .ledger import Ledger

#: The columns of the manifest in their order.
MANIFEST_COLUMNS = [c.split()[0] for c in vocab.MANIFEST.split(", ")]


def public(df: DataFrame) -> DataFrame:
    """Without the internal columns, whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def release(df: DataFrame, path: str) -> None:
    """Records as JSON lines, ordered by image_id over the files."""
    public(df).orderBy("image_id").write.option("ignoreNullFields", False).json(path)


def document(df: DataFrame, path: str, order: str = "image_id") -> None:
    """Records as one JSON array in one file, ordered over the parts that tasks write side by side: each row brings the separator before it, the first the bracket. The
    parts, which are packed, and the closing bracket are then copied together in their order, each part goes when it has been copied, and the file is renamed to ``path``."""
    spark, staged = df.sparkSession, scratch.folder(df.sparkSession, "document")
    rows = public(df)
    json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    lines = rows.select(F.col(order).alias("_order"), json.alias("_json")).orderBy("_order", "_json")
    with scratch.freed(spark):
        lines.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(","), "_json").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path
    fs = name(staged).getFileSystem(conf)
    parts = sorted((x.getPath() for x in fs.listStatus(name(staged)) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda p: p.getName())
    whole = name(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(whole, True)
    try:
        for p in parts:  # bytes are handed through, a buffer at a time
            source = jvm.java.util.zip.GZIPInputStream(fs.open(p))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
            fs.delete(p, False)
        out.write(b"]\n" if out.getPos() else b"[]\n")  # a packed part without rows has some bytes
    finally:
        out.close()
    fs.delete(name(staged), True)
    if fs.exists(name(path)):
        fs.delete(name(path), False)
    if not fs.rename(whole, name(path)):
        raise OSError(f"{path} could not be written")


def report(df: DataFrame, path: str) -> None:
    """A one-row nested DataFrame as one JSON object."""
    df.coalesce(1).write.option("ignoreNullFields", False).json(path)


def manifest(df: DataFrame, path: str) -> None:
    """Fixed column order; columns that people fill in later are written empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in MANIFEST_COLUMNS]).write.option("header", True).option("emptyValue", "").csv(path)


def items(df: DataFrame, path: str) -> int:
    """Items in rank order as JSON lines; returns how many lines are read back."""
    df.select("rank", "qa_id", "image_id", "house_id", "image_file", "qa_type", "group", "question", "gold").orderBy("rank").write.json(path)
    return df.sparkSession.read.text(path).count()


def responses(df: DataFrame, path: str, batch: str | int | None = None) -> bool:
    """Commits rows of (model_tag, shard, ...) to the ledger at ``path``: a batch is there as a whole or not at all, and once under its number or name. Without one,
    the rows are a batch of their own."""
    return Ledger(df.sparkSession, path).commit(df, uuid.uuid4().hex if batch is None else batch)


def images(made: DataFrame, root: str) -> DataFrame:
    """Writes the content of rows (dst_name, content) as files below ``root``, a URI or an absolute path in a store that all executors reach, and returns
    (dst_name, bytes) of the files. Each is written under another name and then moved, so that a task that runs again leaves whole files. Like the other
    sinks it writes at once: the rows that it returns are a table of what was written."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made_folders = set()
        for b in batches:
            names, sizes = [], []
            for name, content in zip(b.column("dst_name").to_pylist(), b.column("content").to_pylist()):
                path = f"{base.rstrip('/')}/{name}"
                if (folder := path.rpartition("/")[0]) not in made_folders:
                    store.create_dir(folder, recursive=True)
                    made_folders.add(folder)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, path)
                names.append(name)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["dst_name", "bytes"])

    out = made.where("content is not null").select("dst_name", "content").mapInArrow(run, "dst_name string, bytes long")
    path = scratch.folder(made.sparkSession, "images")
    out.write.parquet(path)
    return made.sparkSession.read.parquet(path)
