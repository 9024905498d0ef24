"""MinHash near-dedup with tensored banding.

Each document has two small collections of ``tables`` keys, each key over ``half`` minhashes. The table
(i, j) has the key made of the i-th key of the one and the j-th of the other, so ``tables ** 2`` tables
of ``2 * half`` minhashes each cost only ``2 * tables * half`` minhashes. With 12 and 3, a pair at the
threshold of 0.85 meets in no table with a chance of 2.2e-5, at 0.9 of 3e-7.

1. Documents with equal shingle sets become one class, known by their number and two sums of 64 bits over independent hashes of the shingles, and
   numbered in a written table. Groups of copies of any size are merged before any key is made.
2. Keys of the small collections that only one class has are dropped, and with them every table they are in.
3. A class with ``r`` shingles that other candidates have too can share no more than ``r`` with any of them. This bound
   (for similarity at the threshold, ``r`` must reach the share of both sizes) takes out classes that are too far from all others.
4. In each bucket a pivot is compared with the other members: rows grow with the members, never with pairs. That is done for one bucket in ``FIRST``, which
   connects most of a large group, and then for all buckets and the members that are not yet connected with their pivot. In buckets whose
   members are not connected afterwards, members of different components that meet the bound are compared, each pair at the smallest key
   that it shares. Buckets of more than ``DIRECT`` open members first get more pivots, twice as many in each round, which are compared with all
   members and are then done with, until fewer are open. What is left is looked at by key of the first collection, so that a member is in at most ``tables`` groups: the members of open
   buckets with this key are dealt to blocks of about ``MEMBERS`` members and ``SHINGLES`` shingles, and a task compares two blocks through postings of their shingles. A
   row is a member in a block, never a pair, and only links that connect come out.
   So every pair that meets in a bucket is compared, bounded away or already connected.
   Pairs are confirmed on the words of the full shingle sets, not on hashes, by ``100 * intersection >= percent * union``. A pivot's text goes to ``SALT`` tasks, each
   of which compares a part of the members with it.
5. Components come from stars within tasks of about ``TASK_EDGES`` edges, joined by rounds of large and small stars over written tables.

Defined cases: A-Z is lower-cased; a null or blank text has the empty set and is linked with nothing;
fewer than ``width`` words make one shingle of all words; rows that share a doc_id are nodes of their own; a null
doc_id counts for no component's smallest doc_id (all null: null); ``kept`` holds for rows whose doc_id equals
the component's. A very long text is one chunk of its own and takes memory in proportion to its length. An empty table gives
an empty result, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, buffers, chained, chunks, complete, lists, longs, mix, release, row_key, run_ids, spans, symbols, table, trimmed, unused, word_ids

WIDTH, PERCENT, TABLES, HALF = 5, 85, 12, 3
DIRECT, FIRST, TASK_EDGES = 4096, 16, 1_000_000
MEMBERS, SHINGLES, SALT = 1024, 500_000, 32


def _runs(count: np.ndarray, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, texts) of the runs that are shingles: all of ``width`` words, and whole shorter texts."""
    n = np.diff(count)
    of = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(np.arange(len(of)) + width <= count[1:][of])
    out = [(width, full, of[full])]
    for m in range(1, width):
        short = np.flatnonzero(n == m)
        if len(short):
            out.append((m, count[short], short))
    return out


def _distinct(values: np.ndarray, docs: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the distinct values of each text, by text and value, and the texts' offsets among them."""
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return order[keep], np.searchsorted(docs[keep], np.arange(texts + 1))


def _sets(data, off, width: int, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted by the first lane, one text after the other, and their offsets."""
    low = LOWER[data]
    s, e, count = spans(low, off)
    runs = _runs(count, width)
    docs = np.concatenate([of for _, _, of in runs])
    out = []
    for lane in range(lanes):
        sym = symbols(low, s, e, lane)
        out.append(np.concatenate([chained(sym, at, m, 10 * m + lane) for m, at, _ in runs]))
    at, to = _distinct(out[0], docs, len(off) - 1)
    return [x[at] for x in out], to


def _word_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the distinct shingles of each text, by words and not by hashes, one text after the other and sorted, their offsets, and a bound of the numbers."""
    data, off = buffers(col)
    low = LOWER[data]
    s, e, count = spans(low, off)
    ids, values, docs, base = word_ids(low, s, e), [], [], 0
    for m, at, of in _runs(count, width):
        if len(at):
            values.append(base + run_ids(ids, m)[at])
            docs.append(of)
            base += len(ids)
    if not values:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), 1
    values, docs = np.concatenate(values), np.concatenate(docs)
    at, to = _distinct(values, docs, len(off) - 1)
    return values[at], to, base


def _rows(to: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of what ``some`` of the lists with the offsets ``to`` hold, and which of them each is of."""
    n = to[some + 1] - to[some]
    return np.repeat(to[some] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(some)), n)


def _overlaps(col: pa.Array, mine: np.ndarray, theirs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both sets of each pair of texts of ``col`` and of their intersection."""
    values, to, base = _word_sets(col, width)
    keys = np.repeat(np.arange(len(col)), np.diff(to)) * base + values
    at, pair = _rows(to, mine)
    wanted = theirs[pair] * base + values[at]
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    found = keys[place] == wanted if len(keys) else np.zeros(0, bool)
    size = np.diff(to)
    return size[mine], size[theirs], np.bincount(pair[found], minlength=len(mine))


def _sketch(width: int, tables: int, half: int):
    """Per row: size and two sums over its set, and the keys of both collections (even: first, odd: second)."""
    rnd = np.random.Generator(np.random.PCG64(20))
    mult = rnd.integers(0, 1 << 63, 2 * tables * half, dtype=np.uint64) * U(2) + U(1)
    add = rnd.integers(0, 1 << 63, 2 * tables * half, dtype=np.uint64)

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                (x, y), at = _sets(data, off, width, 2)
                size = np.diff(at)
                some = np.flatnonzero(size)
                first = at[:-1][some]
                total = np.zeros((2, hi - lo), U)
                keys = np.zeros((len(some), 2 * tables), U)
                if len(some):
                    total[0, some] = np.add.reduceat(mix(x), first)
                    total[1, some] = np.add.reduceat(mix(y), first)
                    for t in range(2 * tables):
                        key = np.full(len(some), t + 1, U)
                        for k in range(half):
                            h = x * mult[t * half + k] + add[t * half + k]
                            h ^= h >> U(32)
                            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, first))
                        keys[:, t] = (key & ~U(1)) | U(t % 2)
                where = np.zeros(hi - lo, np.int64)
                where[some] = 2 * tables
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi], b.column("th")[lo:hi], pa.array(size), longs(total[0]), longs(total[1]), lists(keys.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(where)]))],
                    names=["doc_id", "th", "n_shingles", "s1", "s2", "keys"],
                )

    return run


def _shingles(width: int):
    """(shingle, class) rows."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                (x,), at = _sets(data, off, width)
                yield pa.RecordBatch.from_arrays([longs(x), b.column("c")[lo:hi].take(pa.array(np.repeat(np.arange(hi - lo), np.diff(at))))], names=["s", "c"])

    return run


def _alike(both, x, y, percent: int):
    return (100 * both >= percent * (x + y - both)) & (both > 0)


def _confirm(width: int, percent: int):
    """Rows come sorted by pivot and part, the pivot first: keeps the members whose full sets are similar enough to its."""

    def run(batches):
        pivot = None
        for b in batches:
            for lo, hi, _, _ in chunks(b.column("text")):
                texts, first = b.column("text")[lo:hi], b.column("first")[lo:hi].to_numpy(zero_copy_only=False)
                if pivot is not None:
                    texts, first = pa.concat_arrays([pivot, texts]), np.append(True, first)
                of = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                mine = np.flatnonzero(~first)
                x, y, both = _overlaps(texts, mine, of[mine], width)
                keep = pa.array(mine[_alike(both, x, y, percent)] - (len(first) - (hi - lo)) + lo)
                yield pa.RecordBatch.from_arrays([b.column("c").take(keep), b.column("p").take(keep)], names=["c", "p"])
                pivot = texts[int(of[-1]) : int(of[-1]) + 1]

    return run


def _sharing(lists_: pa.Array, m: int, below: int | None = None) -> np.ndarray:
    """Which of ``m`` members share a key, or one that is smaller than ``below``."""
    keys, of = lists_.flatten().to_numpy(), np.repeat(np.arange(m), lists_.value_lengths().to_numpy())
    if below is not None:
        keys, of = keys[keys < below], of[keys < below]
    order, out = np.argsort(keys, kind="stable"), np.zeros((m, m), bool)
    for some in np.split(of[order], np.flatnonzero(np.diff(keys[order])) + 1):
        if len(some) > 1:
            out[np.ix_(some, some)] = True
    return out


def _block_pairs(width: int, percent: int):
    """Rows come sorted by key and pair of blocks (x, y): compares the members of the one block with those of the other, and gives links that connect them."""

    def links(g) -> list[tuple[int, int]]:
        col = lambda k: g.column(k).to_numpy(zero_copy_only=False)
        m, c, label, own, n, r = g.num_rows, col("c"), col("label"), col("own"), col("n"), col("r")
        x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
        ok = (label[:, None] != label) & (np.minimum(r[:, None], r) * (100 + percent) >= (n[:, None] + n) * percent)
        ok &= np.triu(np.ones((m, m), bool), 1) if x == y else (own[:, None] == x) & (own == y)
        # A pair is compared at the smallest key that it shares, if it shares one of the other collection too.
        ok &= ~_sharing(g.column("a"), m, g.column("ka")[0].as_py())
        ok &= _sharing(g.column("b"), m)
        if not ok.any():
            return []
        values, to, _ = _word_sets(g.column("text"), width)
        size, doc = np.diff(to), np.repeat(np.arange(m), np.diff(to))
        _, number = np.unique(values, return_inverse=True)
        order = np.argsort(number, kind="stable")
        post, begun = doc[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
        of, out = np.unique(label, return_inverse=True)[1], []
        for u in np.flatnonzero(ok.any(1)).tolist():
            at, _ = _rows(begun, number[to[u] : to[u + 1]])
            both = np.bincount(post[at], minlength=m)
            for v in np.flatnonzero(ok[u] & _alike(both, size[u], size, percent)).tolist():
                if of[u] != of[v]:
                    of[of == of[v]] = of[u]
                    out.append((min(c[u], c[v]), max(c[u], c[v])))
        return out

    def run(batches):
        keys = ["ka", "x", "y"]
        for b in complete(batches, keys):
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for k in keys:
                v = b.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
            out = [e for low, high in zip(cuts, cuts[1:]) for e in links(b.slice(low, high - low))]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["c", "p"])

    return run


def _forest(batches):
    """The edges of one task as stars: each node with the smallest node of its component."""
    u, v = [], []
    for b in batches:
        u.append(np.asarray(b.column("c")))
        v.append(np.asarray(b.column("p")))
    if not u or not sum(map(len, u)):
        return
    nodes, at = np.unique(np.concatenate(u + v), return_inverse=True)
    x, y = at[: len(at) // 2], at[len(at) // 2 :]
    low = np.arange(len(nodes))
    while True:
        a, b = low[x], low[y]
        new = low.copy()
        np.minimum.at(new, a, b)
        np.minimum.at(new, b, a)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    off = np.flatnonzero(low != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[low[off]])], names=["c", "p"])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) of the nodes of ``edges`` (c, p), a written table: the label is the smallest node that is reachable.

    Tasks of about ``TASK_EDGES`` edges first turn their edges into stars. If there is more than one such task, rounds
    of large and small stars join them until no edge changes; the number of rounds follows the logarithm of
    the longest path, nodes are pre-aggregated, and each round writes its edges."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("c", "p").union(e.select(F.col("p").alias("c"), F.col("c").alias("p"))) if large else e.select(F.greatest("c", "p").alias("c"), F.least("c", "p").alias("p"))
        low = both.groupBy("c").agg(F.least(F.min("p"), F.col("c")).alias("m"))
        out = both.join(low, "c")
        if large:
            out = out.where("p > c").select(F.col("p").alias("c"), F.col("m").alias("p"))
        else:
            out = out.select(F.col("p").alias("c"), F.col("m").alias("p")).union(low.select("c", F.col("m").alias("p")))
        return out.where("c <> p").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("c", "p").cast("decimal(20,0)"))).first()

    tasks = edges.count() // TASK_EDGES + 1
    now = table((edges.repartition(tasks) if tasks > 1 else edges.coalesce(1)).mapInArrow(trimmed(_forest), "c long, p long"), name)
    seen = None
    while tasks > 1:
        new = table(star(star(now, True), False), name)
        last, seen = seen or mark(now), mark(new)
        release(now)
        now = new
        if seen == last:
            break
    roots = now.select(F.col("p").alias("node"), F.col("p").alias("label")).distinct()
    return now.select(F.col("c").alias("node"), F.col("p").alias("label")).union(roots)


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, tables: int = TABLES, half: int = HALF) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept for each row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("th"))
    sketch = table(docs.mapInArrow(trimmed(_sketch(width, tables, half)), "doc_id long, th long, n_shingles long, s1 long, s2 long, keys array<long>"), "sketch")
    # A class has a number, which the written table fixes; its smallest doc_id names it, and one of its rows lends text and keys.
    same = ["n_shingles", "s1", "s2"]
    found = sketch.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first_doc"), F.min(F.struct("doc_id", "th", "keys")).alias("of"))
    classes = table(found.select(F.monotonically_increasing_id().alias("c"), *same, "first_doc", "of.doc_id", "of.th", "of.keys"), "classes")
    keys = classes.select("c", F.explode("keys").alias("k"))
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    own = keys.join(shared, "k").groupBy("c").agg(F.collect_list("k").alias("k"))
    # Classes without a shared key in both collections have no candidates.
    own = own.select("c", F.filter("k", lambda k: k.bitwiseAND(F.lit(1)) == 0).alias("a"), F.filter("k", lambda k: k.bitwiseAND(F.lit(1)) == 1).alias("b")).where("size(a) > 0 and size(b) > 0")
    own = table(own.join(classes.select("c", "doc_id", "th", "n_shingles"), "c"), "candidates")
    d = docs.alias("d")
    texts = table(d.join(own.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.th") == F.col("o.th"))).select("o.c", "d.text").dropDuplicates(["c"]), "texts")
    lone = texts.mapInArrow(trimmed(_shingles(width)), "s long, c long").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).where("n = 1").groupBy("c").agg(F.count(F.lit(1)).alias("lone"))
    bounded = own.join(lone, "c", "left").select("c", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("r"), "a", "b").where(F.col("r") * 100 >= F.col("n") * percent)
    bounded = table(bounded, "bounded")

    def rows(classes: DataFrame, *names: str) -> DataFrame:
        """A row for each class and table."""
        return classes.select(*names, "b", F.explode("a").alias("ka")).select(*names, "ka", F.explode("b").alias("kb")).withColumn("bucket", F.xxhash64("ka", "kb"))

    # |x & y| <= r and |x | y| >= |x| + |y| - r, for the smaller r of both
    near = F.least("r", "r_p") * (100 + percent) >= (F.col("n") + F.col("n_p")) * percent
    # Pivots are the members that share most with others, then by class.
    place = F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("f"), F.col("c")).alias("o")
    links = labels = None

    def connect(sure: DataFrame) -> None:
        nonlocal links, labels
        # Stars of the components so far stand for the links that made them.
        links = table(sure if labels is None else sure.union(labels.where("node <> label").select(F.col("node").alias("c"), F.col("label").alias("p"))), "links")
        labels = table(components(links), "labels")

    def confirm(pairs: DataFrame) -> None:
        """``pairs`` of a member (c) and a pivot (p)."""
        pairs = table(pairs.select("c", "p", F.pmod(F.xxhash64("c"), F.lit(SALT)).alias("salt")).distinct(), "pairs")
        pivots = pairs.select("p", "salt").distinct().select(F.col("p").alias("c"), "p", "salt", F.lit(True).alias("first"))
        rows_ = pivots.unionByName(pairs.withColumn("first", F.lit(False))).join(texts, "c")
        sorted_ = rows_.repartition("p", "salt").sortWithinPartitions("p", "salt", F.desc("first")).select("c", "p", "first", "text")
        connect(sorted_.mapInArrow(trimmed(_confirm(width, percent)), "c long, p long"))
        release(pairs)

    def with_pivots(r: DataFrame, each: int = 1, members: int = 1) -> DataFrame:
        """Each member of a bucket of more than so many with the bucket's pivots: the first of each of about ``each`` parts of it."""
        own = ["label"] if "label" in r.columns else []
        part = [F.pmod(F.xxhash64("c", "bucket"), F.lit(each)).alias("part")] if each > 1 else []
        pivots = r.groupBy("bucket", *part).agg(F.min(F.struct(place, "n", "r", *own)).alias("p"), F.count(F.lit(1)).alias("m"))
        if members > 1:
            large = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > members).select("bucket")
            pivots = pivots.join(large, "bucket")
        elif not part:
            pivots = pivots.where("m > 1")
        return r.join(pivots.select("bucket", F.col("p.o.c").alias("p"), F.col("p.n").alias("n_p"), F.col("p.r").alias("r_p"), *[F.col("p.label").alias("label_p") for _ in own]), "bucket")

    def unconnected(done: DataFrame | None) -> DataFrame:
        """Rows of buckets with more than one component, without the pivots that are done with."""
        now = bounded.join(labels, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c"))
        r = rows(now, "c", "n", "r", "label")
        if done is not None:
            r = r.join(done, ["bucket", "c"], "left_anti")
        open_ = r.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        return table(r.join(open_, "bucket"), "open")

    every = rows(bounded, "c", "n", "r").select("c", "n", "r", "bucket")
    confirm(with_pivots(every.where(F.pmod("bucket", F.lit(FIRST)) == 0)).where("c <> p").where(near))
    left = unconnected(None)
    confirm(with_pivots(left.select("c", "n", "r", "bucket", "label")).where("label <> label_p").where(near))
    release(left)
    done, left, each = None, unconnected(None), 1
    while not left.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > DIRECT).isEmpty():
        seen = table(with_pivots(left.select("c", "n", "r", "bucket", "label"), each, DIRECT), "pivots")
        confirm(seen.where("label <> label_p").where(near).select("c", "p"))
        last = seen.select("bucket", F.col("p").alias("c")).distinct()
        done = table(last if done is None else done.union(last), "done")
        release(left, seen)
        left, each = unconnected(done), 2 * each
    members = table(left.select("ka", "c", "n", "r", "label").distinct(), "members")
    blocks = members.groupBy("ka").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).alias("blocks"))
    dealt = members.join(blocks, "ka").withColumn("own", F.pmod(F.xxhash64("c", "ka"), F.col("blocks")))
    dealt = dealt.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"x": F.least("own", "of"), "y": F.greatest("own", "of")})
    keys = ["ka", "x", "y"]
    dealt = dealt.join(texts.join(bounded.select("c", "a", "b"), "c"), "c").select(*keys, "own", "c", "label", "n", "r", "a", "b", "text").repartition(*keys).sortWithinPartitions(*keys)
    connect(dealt.mapInArrow(trimmed(_block_pairs(width, percent)), "c long, p long"))
    release(members)
    release(left)
    named = classes.select("c", *same, "first_doc").join(labels, F.col("c") == F.col("node"), "left").select(*same, "first_doc", F.coalesce("label", "c").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = named.join(smallest, "label").select(*same, "component_id")
    some = sketch.where("n_shingles > 0").select("doc_id", "th", *same).join(named, same).select("doc_id", "th", "n_shingles", "component_id")
    out = some.union(sketch.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def report(docs: DataFrame, **k) -> DataFrame:
    return link(docs, **k).select("doc_id", "n_shingles", "component_id", "kept")


def dedup(docs: DataFrame, **k) -> DataFrame:
    """The rows of ``docs`` that ``link`` keeps, one of each component; of rows equal in doc_id and text, all stay or go together."""
    doc, th, key = unused(docs, "of_doc", "of_text", "text_key")
    gone = link(docs, **k).where("not kept").select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    d = docs.withColumn(key, row_key())
    return d.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
