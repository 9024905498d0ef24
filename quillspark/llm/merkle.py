"""A Merkle manifest of a dataset, built and verified in supersteps over RDDs of messages.

A row's leaf is the digest of its fields. The leaves of a source, by doc_id, are the lowest vertices of its tree; in each superstep upwards all vertices of a level
send their digest to their parent, which has received one message from each of its up to ``FAN`` children, hashes them in order and sends its own
digest on. A vertex knows its place and the size of its level, so a parent can tell that it is complete. The sources' subroots are then the leaves of one
more tree. Reverse supersteps send the path, the digests of each run on the way with the place in it, from the root down to the leaves, which
fold theirs upwards again.

Places come from one sort by ranges of (source, doc_id), a count for each range and source, and the sums of those of the ranges before, so a source with
most of the rows is spread over many tasks, and no group holds more than ``FAN`` vertices. Only digests travel, never texts. Each level is written to a table of the shared
folder, so a lost executor repeats one superstep. The path of a leaf's parent reaches its up to ``FAN`` leaves as one message.

Defined cases: a null field is ``-``; a null source is a source of its own and the first; a null doc_id comes first, and isn't tampered with; rows that share source and doc_id
go by their leaves; equal rows are leaves of their own; a lone leaf is its subroot, and a lone subroot the root, with nothing hashed for an empty path; a null text stays null when
tampered with; a very long text is one row's memory in one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, table

FAN = 16
#: Vertices that one task of a superstep takes.
VERTICES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
LEVEL = "tree string, place long, size long, digest binary, run binary"


def digest(run: bytes) -> bytes:
    """The digest of digests as hex text."""
    return sha256(run.hex().encode()).digest()


def leaf(text: Column) -> Column:
    fields = [*(F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")), text]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source), doc_id, digest, and tampered: the digest after the change, where the row is one that changes."""
    changes = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).alias("digest"),
        F.when(changes, leaf(F.translate("text", UPPER, LOWER))).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place in their tree by ``order`` and the size of the tree."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    apart = F.monotonically_increasing_id()  # equal rows may all be in one range otherwise
    ranged = rows.withColumn("row", apart).repartitionByRange(*keys, "row").sortWithinPartitions(*keys, "row")
    held = table(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "places")
    runs = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    # As many rows of a tree as there are ranges.
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    out = table(held.join(runs, ["tree", "part"]).withColumn("place", F.col("row") + F.col("shift")).drop("row", "part", "shift"), "placed")
    release(held)
    return out


def tasks(n: int) -> int:
    return max(1, -(-n // VERTICES))


def _receive(inbox: tuple) -> tuple:
    """A parent's vertex, once all its children have sent."""
    (tree, place), messages = inbox
    messages = sorted(messages)
    size = messages[0][1]
    if [m[0] for m in messages] != list(range(place * FAN, min(size, place * FAN + FAN))):
        raise ValueError(f"vertex {place} of {tree!r} has not heard of all its children")
    run = b"".join(m[2] for m in messages)
    return tree, place, -(-size // FAN), digest(run), run


def up(nodes: DataFrame) -> list[DataFrame]:
    """The vertices of each level above ``nodes``, with the run of their children's digests."""
    out: list[DataFrame] = []
    while n := nodes.where("size > 1").count():
        sent = nodes.where("size > 1").select("tree", "place", "size", "digest").rdd.map(lambda v: ((v[0], v[1] // FAN), (v[1], v[2], bytes(v[3]))))
        nodes = table(nodes.sparkSession.createDataFrame(sent.groupByKey(tasks(n)).map(_receive), LEVEL, verifySchema=False), "level")
        out.append(nodes)
    return out


def _passed(place: int, run: bytes, message: bytes) -> Iterator[tuple[int, bytes]]:
    """The children's places and messages: a path is, from below, of each run the place in it, its length and its digests; behind the path stands the digest of the root."""
    n = len(run) // 32
    for slot in range(n):
        yield place * FAN + slot, bytes((slot, n)) + run + message


def down(grown: list[DataFrame], seeds: RDD) -> RDD:
    """The vertices of the lowest of the levels ``grown`` with their message: ((tree, place), (run, message)). ``seeds`` are the roots' ((tree, height), message)."""
    met = seeds.context.emptyRDD()
    for k in range(len(grown), 0, -1):
        roots = seeds.filter(lambda s, k=k: s[0][1] == k).map(lambda s: ((s[0][0], 0), s[1]))
        sent = met.flatMap(lambda v: [((v[0][0], p), m) for p, m in _passed(v[0][1], *v[1])])
        vertices = grown[k - 1].select("tree", "place", "run").rdd.map(lambda v: ((v[0], v[1]), bytes(v[2])))
        met = vertices.join(sent.union(roots), tasks(grown[k - 1].count()))
    return met


def folded(h: bytes, message: bytes) -> tuple[bytes, bytes]:
    """The root that ``h`` gives along the path of ``message``, and the siblings' digests."""
    at, end, siblings = 0, len(message) - 32, []
    while at < end:
        slot, n = message[at], message[at + 1]
        run = message[at + 2 : at + 2 + 32 * n]
        left, right = run[: 32 * slot], run[32 * slot + 32 :]
        siblings += [left, right]
        h = digest(left + h + right)
        at += 2 + 32 * n
    return h, b"".join(siblings)


def _to_sources(key: tuple, met: tuple) -> Iterator[tuple]:
    """The messages to the roots of the sources: the path above, and the subroot in place of the root."""
    sources, (run, message) = met
    above = dict(_passed(key[1], run, message))
    for place, source, height, sub in sources:
        yield source, height, above[place][:-32] + sub


def _verified(row: tuple, message: bytes, root: bytes) -> tuple:
    """The result of a leaf."""
    _, doc_id, h, tampered = row
    end, siblings = folded(h if tampered is None else tampered, message)
    return doc_id, h.hex(), message[-32:].hex(), root.hex(), sha256(siblings.hex().encode()).hexdigest(), end.hex(), end == root


def _of_run(key: tuple, met: tuple, root: bytes) -> Iterator[tuple]:
    rows, (run, message) = met
    messages = dict(_passed(key[1], run, message))
    for row in rows:
        yield _verified(row, messages[row[0]], root)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark = docs.sparkSession
    hashed = table(leaves(docs), "leaves")
    bottom = placed(hashed, ["doc_id", "digest"])
    release(hashed)
    low = up(bottom)
    roots = [level.where("size = 1").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.lit(k).alias("height"), "digest") for k, level in enumerate([bottom, *low])]
    subs = placed(reduce(DataFrame.unionAll, roots), ["source"])
    high = up(subs)
    top = (high[-1] if high else subs).select("digest").first()
    if top is None:
        return spark.createDataFrame([], RESULT)
    root = bytes(top[0])

    # Down the tree above the sources, to the subroots.
    met = down(high, spark.sparkContext.parallelize([(("", len(high)), root)], 1))
    told = subs.select("tree", "place", "size", "source", "height", "digest").rdd.map(lambda v: ((v[0], v[1] // FAN), (v[1], v[3], v[4], bytes(v[5]))))
    if high:
        known = told.groupByKey(tasks(subs.count())).join(met).flatMap(lambda v: _to_sources(*v))
    else:
        known = told.map(lambda v: (v[1][1], v[1][2], v[1][3]))
    seeds = table(spark.createDataFrame(known, "source string, height int, message binary", verifySchema=False), "seeds").rdd.map(lambda s: ((s[0], s[1]), bytes(s[2])))

    # Down the trees of the sources, to the leaves; a lone leaf is its source's root.
    met = down(low, seeds)
    rows = bottom.select("tree", "place", "size", "doc_id", "digest", "tampered").rdd
    kept = rows.map(lambda v: ((v[0], v[1] // FAN), v[2], (v[1], v[3], bytes(v[4]), None if v[5] is None else bytes(v[5]))))
    runs = kept.filter(lambda v: v[1] > 1).map(lambda v: (v[0], v[2])).groupByKey(tasks(bottom.count())).join(met)
    lone = kept.filter(lambda v: v[1] == 1).map(lambda v: (v[0], v[2])).join(seeds.filter(lambda s: s[0][1] == 0), tasks(bottom.where("size = 1").count()))
    out = runs.flatMap(lambda v: _of_run(*v, root)).union(lone.map(lambda v: _verified(*v[1], root)))
    return spark.createDataFrame(out, RESULT, verifySchema=False)
