"""Responses under a ledger: batches are staged under names of their own, and one renamed file commits each.

A batch has a number, or any name, that its repetitions share. Its rows go to a new folder; then the entry of the batch, which names the folder and its files, is written beside the
ledger and renamed into it. Of several attempts, the first rename counts, and a batch that has an entry isn't written again. Readers take the files that entries name and nothing
else, so what a killed attempt has left is never seen; ``sweep`` deletes it. Every ``COMPACT`` entries are put together in one, so a reader opens few.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import vocab

COMPACT = 20
PARTS = ["model_tag", "shard"]


class Ledger:
    def __init__(self, spark: SparkSession, root: str, schema: str = f"{vocab.RESPONSES}, model_tag string, shard int"):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_ledger/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _store(self, name: str, entry: dict) -> bool:
        """Whether the entry is there because of this call."""
        part, to = self._path(f"{self.root}/_staging/{uuid.uuid4().hex}"), self._path(f"{self.root}/_ledger/{name}")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(part, True)
        out.write(json.dumps(entry).encode())
        out.close()
        # A rename onto an entry that is there fails in stores that have no replacing rename; where it would replace, the look before decides.
        done = not self._fs.exists(to) and bool(self._fs.rename(part, to))
        if not done:
            self._fs.delete(part, False)
        return done

    def committed(self, batch: str | int) -> bool:
        name = _entry(batch)
        return bool(self._fs.exists(self._path(f"{self.root}/_ledger/{name}"))) or name in {e for c in self._compacts()[-1:] for e in self._load(c)["entries"]}

    def _compacts(self) -> list[str]:
        return [n for n in self._names("_ledger") if n.startswith("compact-")]

    def commit(self, df: DataFrame, batch: str | int) -> bool:
        """Writes the rows of a batch, unless it is there; says whether this call has committed it."""
        if self.committed(batch):
            return False
        folder = f"{self.root}/batch={uuid.uuid4().hex}"
        df.write.partitionBy(*[c for c in PARTS if c in df.columns]).json(folder)
        walk, files = self._fs.listFiles(self._path(folder), True), []
        while walk.hasNext():
            p = walk.next().getPath()
            if p.getName().startswith("part-"):
                files.append(str(p)[str(p).index(folder.rsplit("/", 1)[1]) :])
        done = self._store(_entry(batch), {"files": sorted(files)})
        if done:
            self._compact()
        return done

    def _entries(self) -> dict[str, dict]:
        """All entries: those of the last compact one, and those after it."""
        names = self._names("_ledger")
        last = [n for n in names if n.startswith("compact-")][-1:]
        found = {k: {"files": v} for c in last for k, v in self._load(c)["entries"].items()}
        return found | {n: self._load(n) for n in names if not n.startswith("compact-") and n not in found}

    def _compact(self) -> None:
        loose = [n for n in self._names("_ledger") if not n.startswith("compact-")]
        if len(loose) < COMPACT:
            return
        every = self._entries()
        number = len(self._compacts())
        if self._store(f"compact-{number:012d}", {"entries": {k: v["files"] for k, v in every.items()}}):
            for n in loose:
                if n in every:
                    self._fs.delete(self._path(f"{self.root}/_ledger/{n}"), False)

    def files(self) -> list[str]:
        return [f"{self.root}/{f}" for _, e in sorted(self._entries().items()) for f in e["files"]]

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        files = self.files()
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.root).json(files).select(*[c.split()[0] for c in self.schema.split(", ")])

    def sweep(self) -> int:
        """Deletes the folders that no entry names, and what is staged; no batch may be under way. Returns the number of folders."""
        kept = {f.split("/")[0] for e in self._entries().values() for f in e["files"]}
        gone = [n for n in self._names("") if n.startswith("batch=") and n not in kept]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        self._fs.delete(self._path(f"{self.root}/_staging"), True)
        return len(gone)


def _entry(batch: str | int) -> str:
    """Numbers sort as numbers."""
    name = f"{batch:020d}" if isinstance(batch, int) else re.sub(r"[^\w.=-]", "_", batch)
    return f"batch-{name}.json"
