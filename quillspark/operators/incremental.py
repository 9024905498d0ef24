"""A merge that takes exports as they come.

The store holds the last record of each id and route, dealt to ``BUCKETS`` folders by id, with the file and place each came from; and the tasks and records of each update, from which
audits and issues are made. An update parses its new files only, merges their records into the buckets that they touch, and writes these anew; the other buckets
stay as they are. Excluded ids stay as rows of their route, so a later export changes what an earlier one has decided just as it does in one merge.

One file of state names what counts: it is written aside and renamed to the next version. An update that dies before leaves nothing that is seen; a file that has been merged
isn't merged again; and of two updates at once, the second fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from . import merge

BUCKETS = 64


@dataclass
class State:
    version: int = 0
    #: Files in the order in which they were merged, and those of them that could not be read.
    files: list[str] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)
    tasks: list[str] = field(default_factory=list)
    records: list[str] = field(default_factory=list)
    buckets: dict[str, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, options: merge.MergeOptions = merge.MergeOptions()):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> State:
        folder = self._path(f"{self.root}/_state")
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        if not names:
            return State()
        stream = self._fs.open(self._path(f"{self.root}/_state/{names[-1]}"))
        try:
            return State(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, state: State) -> None:
        part, to = self._path(f"{self.root}/_staging/{uuid.uuid4().hex}"), self._path(f"{self.root}/_state/{state.version:012d}.json")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(part, True)
        out.write(json.dumps(vars(state)).encode())
        out.close()
        if self._fs.exists(to) or not self._fs.rename(part, to):
            raise RuntimeError(f"version {state.version} has been written by another update")

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> tuple[str, DataFrame]:
        folder = f"{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")

    def _last(self, state: State, some: list[str] | None = None) -> DataFrame | None:
        folders = [f for b, f in state.buckets.items() if some is None or b in some]
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def add(self, patterns: list[str], assignment: DataFrame, manifest: DataFrame) -> State:
        """Merges the exports that are not yet merged, in the order of the patterns."""
        state = self.state()
        new = [f for f in readers.expand(self.spark, patterns) if f not in set(state.files)]
        if not new:
            return state
        tasks, bad = readers.exports(self.spark, new)
        later = len(state.files)
        tasks_at, seen = self._write(merge.picked(tasks.withColumn("file_no", F.col("file_no") + later)), "tasks")
        records_at, every = self._write(merge.records(seen, assignment, merge.sizes_of(manifest, seen.where("issue is null")), self.options), "records")
        last = merge.last_routed(every, self.options)
        keyed = last.withColumn("_bucket", F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("string"))
        keyed = self._write(keyed, "new")[1]
        touched = [r[0] for r in keyed.select("_bucket").distinct().collect()]  # BUCKETS at most
        old = self._last(state, touched)
        both = keyed.drop("_bucket") if old is None else keyed.drop("_bucket").unionByName(old)
        one = merge.last_wins(both, ["image_id", "_out"], ["file_no", "pos"])
        last_at, _ = self._write(one.withColumn("_bucket", F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("string")), "last", "_bucket")
        done = State(state.version + 1, state.files + new, state.unreadable + [r.file for r in bad.collect()], [*state.tasks, tasks_at], [*state.records, records_at], state.buckets | {b: f"{last_at}/_bucket={b}" for b in touched})
        self._commit(done)
        return done

    def merged(self) -> merge.Merged:
        """What one merge of all files would give."""
        state = self.state()
        if not state.files:
            raise ValueError("nothing has been merged")
        tables = [self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) for folders in (state.tasks, state.records)]
        last = self._last(state)
        return merge.routes(*tables, merge.last_routed(tables[1].limit(0), self.options) if last is None else last, self.options)

    def sweep(self) -> int:
        """Deletes folders that the state doesn't name; no update may be under way. Returns their number."""
        state = self.state()
        kept = {f.split("/")[0] for f in [*state.tasks, *state.records, *state.buckets.values()]} | {"_state"}
        gone = [x.getPath() for x in self._fs.listStatus(self._path(self.root)) if x.getPath().getName() not in kept]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
