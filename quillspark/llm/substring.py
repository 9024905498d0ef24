"""Exact substring dedup over prefix-partitioned suffix trees.

A window is ``min_words`` neighbouring words of one document; a word goes if a window around it also starts in a document with a smaller doc_id.

1. Every window has an anchor, the first run of ``ANCHOR_WORDS`` words inside it with the smallest hash. Equal windows have the same
   anchor at the same place, so suffixes are taken where they start with an anchor, about one word in eighteen, and only
   where the anchor occurs in two documents.
2. The neighbouring windows of one anchor make a block of up to 85 words: the suffix at the anchor, and the words before it that go with it. Equal blocks
   (by 128 bits of hash) are counted up in parts before they move, and each keeps the smallest document and one copy of its words, so a passage that occurs
   in any number of documents costs one block. In all other documents such a block is a repeat as a whole.
3. Blocks are split by prefixes of variable length. The shortest is the anchor, which all windows of a block share. A prefix with up to ``GROUP_ROWS`` different blocks makes a
   group, which fits in memory by far. Others are lengthened: each half of the windows shares more words around the anchor, by which its blocks are dealt again, and so on until groups
   fit or the prefix is the whole window; blocks that have this in common are counted up by its words. Prefixes are dealt by hashes, which only bring blocks together.
4. A group's suffixes, with the words before them, are sorted in word order, to the right of the anchor and (backwards) to its left. The
   words that neighbours have in common (LCP) give both trees' internal nodes: those of depth q are the runs where no LCP is below q.
   Suffixes in the same node of depth ``min_words - p`` on the right and of depth p on the left share a window that starts p words before the
   anchor; of these, the smallest document keeps it. The windows of one suffix that another document has make a maximal repeat.
   Words are compared as words here, not by hashes.
5. The repeats of each document are put together and their words taken out.

Whole copies (equal word sequences, by their sha256) are first merged into the smallest doc_id: only one row of each group of copies has suffixes.

Defined cases: a null text has no words; a null doc_id is in no order with others, so such rows
are kept whole and remove nothing; rows that share a doc_id are judged each for itself, and none
is smaller than the other; fewer than ``min_words`` words give no window; a very long text is one chunk of its own and takes memory in proportion
to its length; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Grams, buffers, chained, chunks, complete, lists, longs, mix, release, row_key, spans, symbols, table, trimmed, unused, word_ids

ANCHOR_WORDS = 15
#: Different blocks of a group that is sorted in memory, and blocks that are hashed together.
GROUP_ROWS, TOGETHER = 1000, 4096
_NONE = np.zeros(0, np.int64)


def _sliding_min(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each ``n`` neighbours and its (first) place, by doubling."""

    def lesser(x, p, by, m):
        left = x[:m] <= x[by : by + m]
        return np.where(left, x[:m], x[by : by + m]), np.where(left, p[:m], p[by : by + m])

    p, k = np.arange(len(x)), 1
    while 2 * k <= n:
        x, p = lesser(x, p, k, len(x) - k)
        k *= 2
    return lesser(x, p, n - k, len(x) - (n - k)) if n > k else (x, p)


def _blocks(data: np.ndarray, off: np.ndarray, size: int):
    """Words (starts, ends, number before each text), and the blocks of neighbouring windows with the same anchor: the text each is of,
    the first and the last start of a window, the anchor's place and its hash."""
    s, e, count = spans(data, off)
    n = len(s)
    if n < size:
        return s, e, count, _NONE, _NONE, _NONE, _NONE, np.zeros(0, U)
    k = min(ANCHOR_WORDS, size)
    v, p = _sliding_min(Grams(symbols(data, s, e)).every(k), size - k + 1)
    of = np.repeat(np.arange(len(count) - 1), np.diff(count))[: n - size + 1]
    at = np.flatnonzero(np.arange(n - size + 1) + size <= count[1:][of])
    v, p, of = v[at], p[at], of[at]
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (of[1:] != of[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return s, e, count, of[new], at[new], at[last], p[new], v[new]


def _outline(size: int):
    """Per document: number of words, digest of the words, distinct anchors."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                s, e, count, of, _, _, _, v = _blocks(data, off, size)
                order = np.lexsort((v, of))
                v, of = v[order], of[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (of[1:] != of[:-1])
                v, cuts = v[new], np.searchsorted(of[new], np.arange(hi - lo + 1))
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for x, y in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi], b.column("th")[lo:hi], pa.array(np.diff(count)), pa.array(sha, pa.string()), lists(v.view(np.int64), cuts)],
                    names=["doc_id", "th", "n_words", "sha", "anchors"],
                )

    return run


_SUFFIX = "grp long, a long, b long, doc_id long, th long, at int, left int, n int, words binary"
_NAMES = [x.split()[0] for x in _SUFFIX.split(", ")]


def _block_hash(sym: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the words of each block: every word is mixed with its place in the block before they are added up."""
    out = np.zeros(len(start), U)
    for k in range(0, len(start), TOGETHER):
        n = size[k : k + TOGETHER]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        out[k : k + TOGETHER] = np.add.reduceat(mix(sym[np.repeat(start[k : k + TOGETHER], n) + place] + (place + seed).astype(U) * U(0x9E3779B97F4A7C15)), first)
    return mix(out + (size * 4096 + left).astype(U))


def _suffixes(size: int):
    """A row for each block whose anchor occurs in another document: its prefix (the anchor), its hash, the place of the suffix, the number of words
    that go with it on the left, the number of windows, and the words, which equal blocks of a chunk of texts give once."""

    def run(batches):
        for b in batches:
            live = b.column("live")
            own_off, own = np.asarray(live.offsets).astype(np.int64), np.asarray(live.values).view(U)
            doc, th = b.column("doc_id"), b.column("th")
            for lo, hi, data, off in chunks(b.column("text")):
                s, e, count, of, at, to, p, v = _blocks(data, off, size)
                keep = np.zeros(len(v), bool)
                cuts = np.searchsorted(of, np.arange(hi - lo + 1)).tolist()
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if x < y:
                        keep[x:y] = np.isin(v[x:y], own[own_off[lo + k] : own_off[lo + k + 1]])
                of, at, to, p, v = of[keep], at[keep], to[keep], p[keep], v[keep]
                if not len(v):
                    continue
                row, raw, n = pa.array(of + lo), data.tobytes(), to - at + 1
                halves = [_block_hash(symbols(data, s, e, lane), at, n + size - 1, p - at, 1 + 1000 * lane) for lane in (0, 1)]
                order = np.lexsort((*halves, v))
                new = np.ones(len(v), bool)
                new[order[1:]] = (v[order[1:]] != v[order[:-1]]) | (halves[0][order[1:]] != halves[0][order[:-1]]) | (halves[1][order[1:]] != halves[1][order[:-1]])
                words = [raw[x:y] if k else None for k, x, y in zip(new.tolist(), s[at].tolist(), e[to + size - 1].tolist())]
                ints = [pa.array(x.astype(np.int32)) for x in (p - count[of], p - at, n)]
                yield pa.RecordBatch.from_arrays([longs(v), *map(longs, halves), doc.take(row), th.take(row), *ints, pa.array(words, pa.binary())], names=_NAMES)

    return run


_LEVEL = "grp long, low int, high int, key long, a long, b long, first_doc long, left int, words binary"
_GROUP = ["grp", "low", "high", "key"]


def _longer(size: int):
    """Deals the blocks of groups that are too large to two halves of their windows each, with the longer prefix that all windows of the half share:
    those that start ``low`` to ``high`` words before the anchor have in common what lies from ``low`` words before it to ``size - high`` words behind its start."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("words")):
                s, e, count = spans(data, off)
                sym, n = symbols(data, s, e), np.diff(count)
                left, low, high = (np.asarray(b.column(x)[lo:hi]).astype(np.int64) for x in ("left", "low", "high"))
                for x, y in np.unique(np.stack([low, high]), axis=1).T.tolist():
                    mid = (x + y) // 2
                    for p, q in ((x, mid), (mid + 1, y)):
                        some = np.flatnonzero((low == x) & (high == y) & (np.maximum(p, size - n + left) <= np.minimum(q, left)))
                        if len(some):
                            key = chained(sym, count[some] + left[some] - p, p + size - q, 77)
                            take = pa.array(some + lo)
                            fixed = [pa.array(np.full(len(some), v, np.int32)) for v in (p, q)]
                            yield pa.RecordBatch.from_arrays([b.column("grp").take(take), *fixed, longs(key), *(b.column(c).take(take) for c in ("a", "b", "first_doc", "left", "words"))], names=[c.split()[0] for c in _LEVEL.split(", ")])

    return run


def _whole_windows(size: int):
    """The words of the one window that each row is in its group for."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("words")):
                s, e, count = spans(data, off)
                raw, at = data.tobytes(), count[:-1] + np.asarray(b.column("left")[lo:hi]) - np.asarray(b.column("low")[lo:hi])
                words = [b" ".join(raw[x:y].split()) for x, y in zip(s[at].tolist(), e[at + size - 1].tolist())]
                yield pa.RecordBatch.from_arrays([*(b.column(x)[lo:hi] for x in ("grp", "a", "b", "first_doc", "low", "high")), pa.array(words, pa.binary())], names=["grp", "a", "b", "first_doc", "low", "high", "w"])

    return run


def _common(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and then word by word, and the number of first words that each has in common with the row before it."""
    order = np.lexsort((*words.T[::-1], group))
    w, g = words[order], group[order]
    other = (w[1:] != w[:-1]) | (w[1:] < 0)
    lcp = np.where(other.any(1), other.argmax(1), words.shape[1]) if words.shape[1] else np.zeros(len(other), np.int64)
    return order, np.concatenate([[-1], np.where(g[1:] == g[:-1], lcp, -1)])


def _repeats(group, low, high, doc, left, data, off, size: int) -> np.ndarray:
    """For each suffix and each p from its ``low`` to its ``high``: whether a smaller document has the window that starts p words before the anchor."""
    s, e, count = spans(data, off)
    ids, n = word_ids(data, s, e), len(doc)
    at, k = count[:-1] + left, min(ANCHOR_WORDS, size)
    right = count[1:] - at
    ahead, behind = np.arange(size), np.arange(size - k)
    limit = max(0, len(ids) - 1)
    after, lcp_after = _common(np.where(ahead < right[:, None], ids[np.minimum(at[:, None] + ahead, limit)], -1), group)
    before, lcp_before = _common(np.where(behind < left[:, None], ids[np.maximum(at[:, None] - 1 - behind, 0)], -1), group)
    found = np.zeros((size - k + 1, n), bool)
    node_after, node_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for p in range(size - k + 1):
        some = np.flatnonzero((left >= p) & (right >= size - p) & (low <= p) & (p <= high))
        if len(some) < 2:
            continue
        node_after[after] = np.cumsum(lcp_after < size - p)
        node_before[before] = np.cumsum(lcp_before < p)
        node = node_after[some] * (n + 1) + node_before[some]
        order = np.argsort(node, kind="stable")
        node, some = node[order], some[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        if len(first) < len(some):
            smallest = np.minimum.reduceat(doc[some], first)
            found[p, some] = np.repeat(smallest, np.diff(np.append(first, len(some)))) < doc[some]
    return found


_RUN = "grp long, a long, b long, first_doc long, low int, high int"


def _subtrees(size: int):
    """Rows come sorted by group; many whole groups are looked at together. A run has the windows that start ``low`` to ``high`` words before the anchor."""

    def look(b):
        data, off = buffers(b.column("words"))
        keys = [np.asarray(b.column(x)) for x in _GROUP]
        group = np.cumsum(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        found = _repeats(group, *keys[1:3], np.asarray(b.column("first_doc")), np.asarray(b.column("left")).astype(np.int64), data, off, size)
        edge = np.zeros((b.num_rows, found.shape[0] + 2), np.int8)
        edge[:, 1:-1] = found.T
        step = np.diff(edge, axis=1)
        row, low = np.nonzero(step == 1)
        high = np.nonzero(step == -1)[1] - 1
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([*(b.column(x).take(take) for x in ("grp", "a", "b", "first_doc")), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=[x.split()[0] for x in _RUN.split(", ")])

    def run(batches):
        for b in complete(batches, _GROUP):
            yield look(b)

    return run


def repeats(docs: DataFrame, min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """For rows of (doc_id, text): an outline per row (doc_id, th, n_words, sha, first_copy), where ``first_copy`` is the smallest doc_id with the
    same words; and the maximal repeats (doc_id, th, spans array<struct<start, stop>>, in words, overlapping and in no order) of the first copies, whose windows a
    smaller doc_id has too. ``th`` is the hash of the row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("th"))
    outline = table(docs.mapInArrow(trimmed(_outline(min_words)), "doc_id long, th long, n_words long, sha string, anchors array<long>"), "outline")
    known = outline.where("doc_id is not null and n_words >= %d" % min_words)
    # A copy is removed whole, so one row of each class has suffixes to look at.
    classes = table(known.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("th", "anchors"), "doc_id").alias("of")).select("sha", "doc_id", "of.*"), "classes")
    each = classes.select("doc_id", "th", F.explode("anchors").alias("v"))
    live = each.groupBy("v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("v")
    own = each.join(live, "v").groupBy("doc_id", "th").agg(F.collect_list("v").alias("live"))
    texts = docs.where("doc_id is not null").join(own, ["doc_id", "th"])
    suffixes = table(texts.mapInArrow(trimmed(_suffixes(min_words)), _SUFFIX), "suffixes")
    key = ["grp", "a", "b"]
    blocks = table(suffixes.groupBy(*key).agg(F.min("doc_id").alias("first_doc"), F.first("left").alias("left"), F.first("words", ignorenulls=True).alias("words")), "blocks")
    whole = ["grp", "a", "b", "first_doc", "low", "high"]
    level = blocks.select("grp", F.lit(0).alias("low"), F.lit(min_words - min(ANCHOR_WORDS, min_words)).alias("high"), F.lit(0).cast("long").alias("key"), "a", "b", "first_doc", "left", "words")
    found, leaves, made = [], [], []
    while True:
        large = table(level.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS).select(*_GROUP), "large")
        tree = level.join(large, _GROUP, "left_anti").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        found.append(table(tree.mapInArrow(trimmed(_subtrees(min_words)), _RUN), "runs"))
        made += [large, found[-1]]
        if large.isEmpty():
            break
        rest = level.join(large, _GROUP)
        leaves.append(table(rest.where("low = high").mapInArrow(trimmed(_whole_windows(min_words)), "grp long, a long, b long, first_doc long, low int, high int, w binary"), "leaves"))
        level = table(rest.where("low < high").mapInArrow(trimmed(_longer(min_words)), _LEVEL), "level")
        made += [leaves[-1], level]
    for leaf in leaves:
        first = leaf.groupBy("w").agg(F.min("first_doc").alias("least"), F.max("first_doc").alias("most")).where("least < most").select("w", "least")
        found.append(leaf.join(first, "w").where("least < first_doc").select(*whole))
    runs = table(reduce(DataFrame.unionAll, found), "runs")
    release(*made)
    places = suffixes.drop("words")
    begin = F.col("at") - F.col("left")
    again = places.join(blocks.select(*key, "first_doc"), key).where("first_doc < doc_id").select("doc_id", "th", begin.alias("start"), (begin + F.col("n") + (min_words - 1)).alias("stop"))
    first = places.join(runs, key).where("first_doc = doc_id").select("doc_id", "th", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + min_words).alias("stop"))
    marked = outline.select("doc_id", "th", "n_words", "sha")
    copies = classes.select("sha", F.col("doc_id").alias("first_copy"))
    enough = F.coalesce(F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words), F.lit(False))
    marked = marked.where(enough).join(copies, "sha").select("doc_id", "th", "n_words", "sha", "first_copy").union(marked.where(~enough).withColumn("first_copy", F.col("doc_id")))
    found = again.union(first).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    found = table(found, "spans")
    release(suffixes, blocks, runs)
    return marked, found


def _kept(text: bytes, spans_: pa.Scalar) -> tuple[int, bytes]:
    """The number of words in the spans, and the other words."""
    words = text.split()
    d = np.zeros(len(words) + 1, np.int32)
    np.add.at(d, np.asarray(spans_.values.field("start")), 1)
    np.add.at(d, np.asarray(spans_.values.field("stop")), -1)
    gone = np.cumsum(d)[:-1] > 0
    return int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist()) if not x])


def _digest(batches):
    for b in batches:
        out = [_kept(t.as_py().encode(), x) for t, x in zip(b.column("text"), b.column("spans"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([n for n, _ in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, x in out], pa.string())], names=["doc_id", "th", "n_removed", "kept_sha256"])


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``."""
    marked, found = repeats(docs, min_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("th"))
    cut = texts.join(found, ["doc_id", "th"]).mapInArrow(trimmed(_digest), "doc_id long, th long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "th"])
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.coalesce(F.col("first_copy") < F.col("doc_id"), F.lit(False))
    return marked.join(cut, ["doc_id", "th"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _shorten(text: str, spans_: str, copy: str, names: list[str]):
    def run(batches):
        for b in batches:
            texts, found = b.column(text), b.column(spans_)
            gone = b.column(copy).to_pylist()
            out = ["" if gone[i] else _kept(texts[i].as_py().encode(), found[i])[1].decode() if found[i].is_valid else texts[i].as_py() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b.column(c) for c in names], names=names)

    return run


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``. Texts that lose words become their kept words joined by
    one space; other texts stay as they are, and so do all other columns. Rows stay, empty if nothing is left."""
    marked, found = repeats(docs, min_words)
    doc, th, spans_, copy, key = unused(docs, "of_doc", "of_text", "of_spans", "is_copy", "text_key")
    copies = marked.where("first_copy < doc_id").select("doc_id", "th", F.lit(True).alias("copy")).distinct()
    change = found.join(copies, ["doc_id", "th"], "full").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("spans").alias(spans_), F.coalesce("copy", F.lit(False)).alias(copy))
    out = docs.withColumn(key, row_key()).join(change, (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(key) == F.col(th)), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], spans_, F.coalesce(F.col(copy), F.lit(False)).alias(copy)).mapInArrow(trimmed(_shorten("text", spans_, copy, docs.columns)), docs.schema)
