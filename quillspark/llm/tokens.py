"""Token ids of whole texts, their binary file format, and packing into sequences.

``Encoder`` gives the ids of the tokenizers library. The pre-tokenizer of the vocabulary never looks across white space, nor back over the end
of a run of letters, so a text's ids are those of its pieces in turn: words, cut where two neighbouring ASCII characters differ in kind. The
distinct pieces of a chunk of texts are found in Arrow, the new ones among them are encoded many at a time, and the ids of all
pieces are gathered by their numbers. Pieces met before come from a cache of bounded size that ends with the task.

Defined cases: a null text counts as empty (just the end id); rows that share a doc_id are documents of their own, in
the order of their texts' hashes; a null doc_id comes first; a very long text is one chunk of its own and takes memory in proportion to its
length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, release, row_key, spans, table, trim

#: Chunks of texts of about so many bytes share one search for distinct pieces.
TEXT_BYTES = 4 << 20
#: Pieces of other characters than Latin letters in one generation of the cache, of which there are two; longer ones than so many bytes are not kept.
CACHE_PIECES, CACHE_PIECE_BYTES = 60_000, 64
#: The dictionary is trained on a sample of so many documents, those of the smallest hashes, with at most so many characters of each, from a place
#: that the hash gives. Any document may be in it, and all are compressed.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 2000, 16_000, 65_536, 3
SEGMENT_BYTES, SEGMENT_DOCS = 1 << 20, 4096
#: What ``Encoder`` relies on: the normalizers and the pre-tokenizer's pattern (fixed values of the vocabulary).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Kinds of bytes: 0 letters, 1 digits, 2 other ASCII, 3 beyond ASCII.
KIND = np.full(256, 2, np.uint8)
KIND[65:91] = KIND[97:123] = 0
KIND[48:58], KIND[128:] = 1, 3
#: By the second byte of a character that begins with C3: letters, those of them in upper case.
LATIN, LATIN_UPPER = np.zeros(256, bool), np.zeros(256, bool)
LATIN[0x80:0xC0] = LATIN_UPPER[0x80:0x9F] = True
LATIN[[0x97, 0xB7]] = LATIN_UPPER[0x97] = False


class Merges:
    """Byte-pair merges of many words at once: in each round every word does its best merge, and only the pairs beside it are looked up again."""

    LENGTHS, TOGETHER, NONE = (4, 8, 12, 16, 24, 32, 63), 32768, np.uint32(0xFFFFFFFF)

    def __init__(self, vocab: dict[str, int], merges: list):
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocab[chars[b] + "</w>"] for b in range(256)], np.uint32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        key = np.array([vocab[x] << 16 | vocab[y] for x, y in pairs], np.uint32)
        if max(vocab.values()) >= 1 << 16 or len(np.unique(key)) != len(key):
            raise ValueError("ids beyond 65535, or a pair that merges twice")
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.uint32)
        # Open addressing; a free slot ends a search.
        self.bits = int(4 * len(key) + 16).bit_length()
        self.keys, self.rank = np.full(1 << self.bits, self.NONE, np.uint32), np.full(1 << self.bits, self.NONE, np.uint32)
        at, todo = self._slot(key), np.arange(len(key), dtype=np.uint32)
        while len(todo):
            free = self.keys[at[todo]] == self.NONE
            some, which = np.unique(at[todo[free]], return_index=True)
            won = todo[free][which]
            self.keys[some], self.rank[some] = key[won], won
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.uint32(16) | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.rank[at], self.NONE)
        more = np.flatnonzero((found != key) & (found != self.NONE))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[more]]
            out[more[found == key[more]]] = self.rank[at[more[found == key[more]]]]
            more = more[(found != key[more]) & (found != self.NONE)]
        return out

    def _round_up(self, data: np.ndarray, start: np.ndarray, n: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``wide`` bytes, word by word, and how many each has."""
        cols = np.arange(len(n))
        place = np.arange(wide, dtype=np.int64)[:, None]
        inside = place < n
        letters = data[np.where(inside, start + place, 0)]
        ids = self.first[letters]
        ids[n - 1, cols] = self.last[letters[n - 1, cols]]
        # best[i, w]: rank of the pair that begins at place i, with i in the low bits; before and after: the neighbours that are left.
        best = np.full((wide, len(n)), self.NONE, np.uint32)
        i, w = np.nonzero(place + 1 < n)
        rank = self._ranks(ids[i, w], ids[i + 1, w])
        best[i, w] = np.where(rank == self.NONE, self.NONE, rank << np.uint32(6) | i.astype(np.uint32))
        after = np.broadcast_to(place + 1, best.shape).astype(np.int8)
        before = np.broadcast_to(place - 1, best.shape).astype(np.int8)

        def renew(i, w):
            j = after[i, w].astype(np.int64)
            has = j < n[w]
            best[i[~has], w[~has]] = self.NONE
            i, j, w = i[has], j[has], w[has]
            rank = self._ranks(ids[i, w], ids[j, w])
            best[i, w] = np.where(rank == self.NONE, self.NONE, rank << np.uint32(6) | i.astype(np.uint32))

        while True:
            top = best.min(0)
            w = np.flatnonzero(top != self.NONE)
            if not len(w):
                break
            i = (top[w] & np.uint32(63)).astype(np.int64)
            j = after[i, w].astype(np.int64)
            ids[i, w] = self.merged[top[w] >> np.uint32(6)]
            inside[j, w] = False
            best[j, w] = self.NONE
            k = after[j, w].astype(np.int64)
            after[i, w] = k
            far = k < n[w]
            before[k[far], w[far]] = i[far]
            renew(i, w)
            h = before[i, w].astype(np.int64)
            renew(h[h >= 0], w[h >= 0])
        return ids.T[inside.T], inside.sum(0)

    def ids(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, the places where each one's begin, and how many each has. Words have 1 to ``LENGTHS[-1]`` bytes."""
        at, count, out, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [np.zeros(0, np.uint32)], 0
        for low, wide in zip((0, *self.LENGTHS), self.LENGTHS):
            every = np.flatnonzero((n > low) & (n <= wide))
            for k in range(0, len(every), self.TOGETHER):
                some = every[k : k + self.TOGETHER]
                ids, m = self._round_up(data, start[some], n[some], wide)
                at[some], count[some] = total + np.cumsum(m) - m, m
                out.append(ids)
                total += len(ids)
        return np.concatenate(out), at, count


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Pieces of lower-case Latin letters, which the normalizers leave as they are, are merged here; all others are left to the library."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = made["model"]
        if (made.get("normalizer") or {}).get("normalizers") != NORMALIZERS or steps[0].get("pattern") != {"Regex": PATTERN} or any(not x["content"].startswith("<|") for x in made["added_tokens"]):
            raise ValueError(f"{vocabulary}: the encoder knows another normalizer and pre-tokenizer")
        if model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{vocabulary}: the encoder knows another kind of merges")
        self.merges = Merges(model["vocab"], model["merges"])
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _others(self, pieces: list[bytes]) -> list[bytes]:
        known, before = self.known, self.before
        new = [w for w in pieces if w not in known and w not in before]
        fresh = dict(zip(new, [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]))
        found = [known.get(w) or before.get(w) or fresh.get(w, b"") for w in pieces]
        known.update((w, x) for w, x in zip(pieces, found) if len(w) <= CACHE_PIECE_BYTES)
        if len(known) > CACHE_PIECES:  # pieces in use move on to the next generation when they are met again
            self.before, self.known = known, {}
        return found

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces one after the other, their lengths, and for each text the number of pieces before it."""
        s, e, count = spans(data, off)
        if not len(s):
            return data[:0], s, count
        low, kind = data.copy(), KIND[data]
        upper = (data >= 65) & (data <= 90)
        upper[1:] |= (data[:-1] == 0xC3) & LATIN_UPPER[data[1:]]
        low[upper] += 32
        cut = np.zeros(len(data) + 1, bool)
        a, b = kind[:-1], kind[1:]
        # Digits stand alone; an apostrophe and the letters behind it may be a contraction.
        cut[1:-1] = (a < 3) & (b < 3) & ((a != b) | (a == 1)) & ~((data[:-1] == 39) & (b == 0))
        if (angle := np.flatnonzero(data == 60)).size:  # special tokens are matched as they stand, so words with "<" stay whole
            for k in np.unique(np.searchsorted(s, angle, side="right") - 1).tolist():
                cut[s[k] + 1 : e[k]] = False
                low[s[k] : e[k]] = data[s[k] : e[k]]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[s] = 1
        inside[e] -= 1
        word = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        cut[s] = True
        at = np.flatnonzero(cut[:-1] & word)
        place = np.cumsum(word)
        first = place[at] - 1  # where each piece begins among the bytes of words
        return low[word], np.diff(np.append(first, place[-1])), np.searchsorted(at, off)

    def _distinct(self, told: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, the places where each one's begin, and how many each has."""
        off = np.frombuffer(told.buffers()[1], np.int64)[told.offset : told.offset + len(told) + 1]
        data = np.frombuffer(told.buffers()[2], np.uint8)[: off[-1]]
        plain = (data >= 97) & (data <= 122)
        pair = np.flatnonzero((data[:-1] == 0xC3) & LATIN[data[1:]])
        plain[pair] = plain[pair + 1] = True
        bad = np.concatenate([[0], np.cumsum(~plain)])
        n = np.diff(off)
        ours = (bad[off[1:]] == bad[off[:-1]]) & (n <= self.merges.LENGTHS[-1])
        start, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        ids, start[ours], count[ours] = self.merges.ids(data, off[:-1][ours], n[ours])
        rest = np.flatnonzero(~ours)
        if len(rest):
            found = self._others(told.take(pa.array(rest)).to_pylist())
            count[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            start[rest] = len(ids) + np.cumsum(count[rest]) - count[rest]
            ids = np.concatenate([ids, np.frombuffer(b"".join(found), "<u4")])
        return ids, start, count

    def texts(self, col: pa.Array):
        """Chunks of (first row, ids of each text)."""
        for lo, _, data, off in chunks(col, TEXT_BYTES):
            letters, sizes, count = self._pieces(data, off)
            if not len(sizes):
                yield lo, [b""] * (len(off) - 1)
                continue
            ends = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=ends[1:])
            told = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
            ids, start, length = self._distinct(told.dictionary)
            of = told.indices.to_numpy()
            n = length[of]
            to = np.zeros(len(of) + 1, np.int64)
            np.cumsum(n, out=to[1:])
            ids = ids[np.repeat(start[of] - to[:-1], n) + np.arange(to[-1])].astype("<u4").tobytes()
            cuts = (4 * to[count]).tolist()
            yield lo, [ids[x:y] for x, y in zip(cuts, cuts[1:])]


class encoder:
    """An encoder for the length of a task: workers that Spark reuses keep neither model nor cache."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def __enter__(self) -> Encoder:
        self.made = Encoder(self.vocabulary)
        return self.made

    def __exit__(self, *_) -> None:
        self.made = None
        trim()


# --- the file format ---------------------------------------------------------------------------------------------


def _train(vocabulary: str, end_id: int):
    def run(batches):
        import zstandard

        end, samples = end_id.to_bytes(4, "little"), []
        with encoder(vocabulary) as enc:
            for b in batches:
                for _, ids in enc.texts(b.column("text")):
                    samples += [_narrow(x + end)[1] for x in ids]
        if not samples:
            return
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples for statistics: their own bytes serve as the dictionary
            raw = b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["dictionary"])

    return run


def _narrow(ids: bytes) -> tuple[int, bytes]:
    """Two bytes an id where all fit, else four."""
    x = np.frombuffer(ids, "<u4")
    return (2, x.astype("<u2").tobytes()) if len(x) == 0 or x.max() < 65536 else (4, ids)


_SEGMENT = "part int, seg int, first_doc long, last_doc long, n_tokens long, dictionary_sha256 string, doc_ids array<long>, lengths array<long>, widths array<int>, offsets array<long>, payload binary"


def _segments(vocabulary: str, end_id: int, dictionary: bytes, sha: str):
    """Documents come in order; a segment holds frames of neighbouring documents and the index to them."""

    def run(batches):
        import zstandard

        end = end_id.to_bytes(4, "little")
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        part, seg = TaskContext.get().partitionId(), 0
        docs, lengths, widths, offsets, frames = [], [], [], [0], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([next((d for d in docs if d is not None), None)], pa.int64()), pa.array([docs[-1]], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([sha]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([widths], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary())],
                names=[x.split()[0] for x in _SEGMENT.split(", ")],
            )

        with encoder(vocabulary) as enc:
            for b in batches:
                ids_of = b.column("doc_id").to_pylist()
                for lo, texts in enc.texts(b.column("text")):
                    for k, ids in enumerate(texts):
                        width, raw = _narrow(ids + end)
                        frames.append(press.compress(raw))
                        docs.append(ids_of[lo + k])
                        lengths.append(len(raw) // width)
                        widths.append(width)
                        offsets.append(offsets[-1] + len(frames[-1]))
                        if offsets[-1] >= SEGMENT_BYTES or len(docs) >= SEGMENT_DOCS:
                            yield flush()
                            seg += 1
                            docs, lengths, widths, offsets, frames = [], [], [], [0], []
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Writes the ids of (doc_id, text) in ascending doc_id order under ``path``.

    ``path``/dictionary holds the shared zstandard dictionary and its sha256. ``path``/segments holds the segments: each document
    is a zstandard frame of its own in ``payload``, from ``offsets[i]`` to ``offsets[i + 1]``, of ``lengths[i]`` ids of
    ``widths[i]`` bytes each; (part, seg) is their order. Both are Parquet, so that any store that Spark writes to serves,
    and a task that is run again leaves one copy."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.xxhash64("doc_id", "text")
    place = F.pmod(key, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    sample = docs.where("text <> ''").select("doc_id", F.substr("text", place, F.lit(SAMPLE_CHARS)).alias("text"), key.alias("key")).orderBy("key", "doc_id").limit(SAMPLE_DOCS)
    found = sample.mapInArrow(_train(vocabulary, end_id), "dictionary binary").first()
    dictionary = bytes(found[0]) if found else b"\0" * 8
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dictionary_sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_segments(vocabulary, end_id, dictionary, sha), _SEGMENT).write.parquet(f"{path}/segments")


class Reader:
    """Reads what ``write_ids`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
        row = spark.read.parquet(f"{path}/dictionary").first()
        self.sha, self.dictionary = row["dictionary_sha256"], bytes(row["dictionary"])
        if hashlib.sha256(self.dictionary).hexdigest() != self.sha:
            raise ValueError("the dictionary does not have its hash")

    def documents(self, only: list[int] | None = None) -> DataFrame:
        """part, seg, doc_id, start (in the segment), n_tokens, ids binary (unsigned 32-bit). ``only``: of these doc_ids (not null), whose frames
        alone are decompressed; segments whose doc_ids lie outside their range are not read."""
        segments = self.segments
        if only is not None:
            # The range reaches the scan, which passes over files and row groups outside it.
            segments = segments.where((F.col("first_doc") <= max(only, default=0)) & (F.col("last_doc") >= min(only, default=0)))
            segments = segments.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in only])))
        return segments.mapInArrow(_frames(self.dictionary, self.sha, only, False), "part int, seg int, doc_id long, start long, n_tokens long, ids binary")

    def index(self) -> DataFrame:
        """doc_id, start (over all documents), n_tokens, ids_crc32. Segments are ordered in two steps: those of a part by a window, and
        the parts, of which there are as many as tasks wrote, by sums on the driver."""
        base, at = {}, 0
        for part, n in sorted(self.segments.groupBy("part").agg(F.sum("n_tokens")).collect()):
            base[part], at = at, at + n
        own = self.segments.mapInArrow(_frames(self.dictionary, self.sha, None, True), "part int, seg int, doc_id long, start long, n_tokens long, ids_crc32 long")
        from pyspark.sql import Window

        before = self.segments.select("part", "seg", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        parts = own.sparkSession.createDataFrame(sorted(base.items()), "part int, base long")
        out = own.join(before, ["part", "seg"]).join(parts, "part")
        return out.select("doc_id", (F.col("base") + F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _frames(dictionary: bytes, sha: str, only, digest: bool):
    def run(batches):
        import zstandard

        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        wanted = None if only is None else set(only)
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a segment was written with another dictionary")
                payload, at, out = memoryview(row["payload"]), 0, []
                for i, (doc, n) in enumerate(zip(row["doc_ids"], row["lengths"])):
                    if wanted is None or doc in wanted:
                        raw = plain.decompress(payload[row["offsets"][i] : row["offsets"][i + 1]])
                        ids = raw if row["widths"][i] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                        if len(ids) != 4 * n:
                            raise ValueError(f"document {doc}: {len(ids) // 4} ids, the index has {n}")
                        out.append((row["part"], row["seg"], doc, at, n, zlib.crc32(ids) if digest else ids))
                    at += n
                if out:
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["part", "seg", "doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


# --- packing -----------------------------------------------------------------------------------------------------


def _pieces(vocabulary: str, end_id: int, capacity: int):
    """Pieces of each document, and each one's number among those of its length in this task."""

    def run(batches):
        end, seen = end_id.to_bytes(4, "little"), Counter()
        part = TaskContext.get().partitionId()
        with encoder(vocabulary) as enc:
            for b in batches:
                doc = b.column("doc_id")
                for lo, texts in enc.texts(b.column("text")):
                    row, piece, start, length, crc, number = [], [], [], [], [], []
                    for k, ids in enumerate(texts):
                        ids = memoryview(ids + end)
                        n = len(ids) // 4
                        for p, s in enumerate(range(0, n, capacity)):
                            size = min(capacity, n - s)
                            row.append(lo + k)
                            piece.append(p)
                            start.append(s)
                            length.append(size)
                            crc.append(zlib.crc32(ids[4 * s : 4 * (s + size)]))
                            number.append(seen[size])
                            seen[size] += 1
                    yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(number, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each, for ``counts`` pieces of each length.

    The lengths that are left are bits of a number. Its bits and those of its mirror image index the sums: ``a`` and ``gap - a`` are both
    left where one shifted over the other has bit ``a`` in common. Each sequence starts from the longest piece. If one, two or
    three pieces fill the gap exactly, they do; else the longest piece that fits goes in and the smaller gap is tried.
    A pattern is used as often as the counts allow, which exhausts a length (or leaves too few for its use), so the number of
    patterns follows the number of lengths, not of pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths go from 1 to the capacity")
    mask = sum(1 << n for n in left)
    mirror = sum(1 << (capacity - n) for n in left)
    out = []

    def take(n: int, by: int = 1) -> None:
        nonlocal mask, mirror
        left[n] -= by
        if not left[n]:
            mask &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))

    def give(n: int) -> None:
        nonlocal mask, mirror
        left[n] += 1
        mask |= 1 << n
        mirror |= 1 << (capacity - n)

    def pair(gap: int) -> tuple[int, ...] | None:
        both = mask & (mirror >> (capacity - gap)) & ((1 << (gap // 2 + 1)) - 1)
        while both:
            a = both.bit_length() - 1
            if 2 * a != gap or left[a] >= 2:
                return a, gap - a
            both &= ~(1 << a)
        return None

    def exact(gap: int) -> tuple[int, ...] | None:
        if mask >> gap & 1:
            return (gap,)
        if two := pair(gap):
            return two
        rest = mask & ((1 << gap) - 1)
        while rest:
            a = rest.bit_length() - 1
            if 3 * a < gap:
                return None
            rest &= ~(1 << a)
            take(a)
            two = pair(gap - a)
            give(a)
            if two:
                return (a, *two)
        return None

    while mask:
        chosen, gap = [], capacity
        while gap and mask & ((2 << gap) - 1):
            if chosen and (found := exact(gap)):
                for n in found:
                    take(n)
                chosen += found
                gap = 0
            else:
                n = (mask & ((2 << gap) - 1)).bit_length() - 1
                take(n)
                chosen.append(n)
                gap -= n
        times = Counter(chosen)
        more = min(left[n] // t for n, t in times.items())
        for n, t in times.items():
            if more:
                take(n, more * t)
        out.append((tuple(chosen), more + 1))
    return out


def _assign(keys: np.ndarray, first: np.ndarray, sequence: np.ndarray, offset: np.ndarray):
    def run(batches):
        for b in batches:
            number = np.asarray(b.column("number")) + np.asarray(b.column("before"))
            at = np.searchsorted(keys, (np.asarray(b.column("length")) << 48) | number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + number - first[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Packs the documents' ids into sequences of at most ``capacity``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The plan needs only how many pieces there are of each length, at most ``capacity`` numbers. Pieces are numbered within
    their length (in their task, plus the counts of the tasks before), and a pattern's place takes a range of numbers."""
    from pyspark.sql import Window

    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = table(docs.mapInArrow(_pieces(vocabulary, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    patterns = plan(dict(counts.groupBy("length").agg(F.sum("n")).collect()), capacity)
    rows, used, sequence = [], Counter(), 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            rows.append(((n << 48) | used[n], used[n], sequence, at))
            used[n] += times
            at += n
        sequence += times
    keys, first, seq, offset = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4).T
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return pieces.join(before, ["part", "length"]).mapInArrow(_assign(keys, first, seq, offset), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
