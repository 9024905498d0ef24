"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text becomes a leading space and its bytes, with spaces shown as the marker U+2581, as the library does it. Among all ways to
write it as pieces, Viterbi finds the one with the greatest sum of log scores; characters that no piece begins with fall back
to byte pieces, at ``UNKNOWN`` below the lowest score. No piece has a marker after another character, so a text's
segmentation is that of its runs of markers with what follows; sums are taken run by run. The distinct runs of a chunk of texts are found in Arrow, and all of
them walk the trie together, byte by byte; longer runs than ``LONGEST`` bytes do so one by one. Nothing is kept from chunk to chunk.

The vocabulary is a merge list whose scores are negative ranks; ``-log(1 + rank)`` (Zipf's law) makes them log scores.

Defined cases: a null or empty text has no pieces; a marker character in a text reads as a space, and so decodes
to one (``exact`` is false then); rows are encoded each for itself; a very long text is one chunk of its own and takes memory in proportion to its length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lists

MARK = "▁".encode()
UNKNOWN = 10.0
#: Bytes of texts in a chunk, runs that walk the trie together, and the longest that do.
TEXT_BYTES, TOGETHER, LONGEST = 4 << 20, 16_384, 48
RUNS = re.compile(rb" *[^ ]+| +")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], list[float], list[int]]:
    """Pieces as bytes (empty for control pieces), log scores, and the ids of the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, by_byte = [], [], [0] * 256
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(text[3:5], 16)] = i
        pieces.append(bytes([int(text[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else text.encode())
        scores.append(-math.inf if sp.is_byte(i) or not pieces[-1] else -math.log(1 - sp.get_score(i)))
    return pieces, scores, by_byte


class DoubleArray:
    """A trie in two arrays: the child of state ``s`` by byte ``c`` is ``t = base[s] + c + 1`` if ``check[t] == s``; ``value[s]`` is the piece that
    ends there, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = len(children) * 2 + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], value[0] = 0, ends[0]
        todo, low, high = [(0, 0)], 1, 1
        for node, at in todo:
            kids = sorted(children[node])
            if not kids:
                continue
            # An only child takes the first free place; siblings look from a border on that moves up past crowded places.
            start = low if len(kids) == 1 else high
            while check[start] >= 0 or start <= kids[0]:
                start += 1
            if len(kids) == 1:
                low = start if start > 256 else low
            b, tries = start - kids[0] - 1, 0
            while True:
                if b + 258 > len(check):
                    grow = len(check)
                    base, check, value = base + [0] * grow, check + [-1] * grow, value + [-1] * grow
                if all(check[b + c + 1] < 0 for c in kids):
                    break
                b, tries = b + 1, tries + 1
                if tries > 200 and len(kids) > 1:
                    high = b
            base[at] = b
            for c in kids:
                t = b + c + 1
                check[t], value[t] = at, ends[children[node][c]]
                todo.append((children[node][c], t))
        end = max(i for i, c in enumerate(check) if c >= 0) + 258
        self.base, self.check, self.value = base[:end], check[:end] + [-1] * (end - len(check)), value[:end]
        self.base += [0] * (end - len(self.base))
        self.value += [-1] * (end - len(self.value))


class Unigram:
    def __init__(self, pieces: list[bytes], scores: list[float], by_byte: list[int]):
        if any(MARK in p.replace(MARK, b" ").lstrip(b" ").replace(b" ", MARK) for p in pieces if p):
            raise ValueError("a piece has a marker after another character")
        self.pieces, self.scores, self.by_byte = pieces, scores, by_byte
        self.trie = DoubleArray({p: i for i, p in enumerate(pieces) if p and scores[i] > -math.inf})
        self.fallback = min(s for s in scores if s > -math.inf) - UNKNOWN
        self.in_bytes = np.zeros(len(pieces), bool)
        self.in_bytes[by_byte] = True
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.score = np.array(scores)
        self.bytes = np.array(by_byte, np.uint32)
        shown = [p.replace(MARK, b" ") for p in pieces]
        self.letters = np.frombuffer(b"".join(shown), np.uint8)
        self.size = np.array([len(p) for p in shown], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def viterbi(self, run: bytes) -> list[int]:
        """Best pieces of one run, markers written out. Of equal sums, the one whose last piece is longest."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(run)
        best, come, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = run[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, s, single = best[i], 0, False
            for j in range(i, n):
                t = base[s] + run[j] + 1
                if check[t] != s:
                    break
                s = t
                if (v := value[s]) >= 0:
                    single = single or j + 1 - i == width
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], come[j + 1], by[j + 1] = here + scores[v], i, v
            if not single and here + self.fallback > best[min(n, i + width)]:
                k = min(n, i + width)
                best[k], come[k], by[k] = here + self.fallback, i, -1
            i += width
        out, j = [], n
        while j:
            i = come[j]
            out.append([by[j]] if by[j] >= 0 else [self.by_byte[c] for c in run[i:j]])
            j = i
        return [v for x in reversed(out) for v in x]

    def _walk(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``viterbi`` for many runs: the ids of all, one run after the other, and how many each has."""
        wide, cols = int(n.max()), np.arange(len(n))
        place = np.arange(wide)[:, None]
        letters = data[np.where(place < n, start + place, 0)]
        best = np.full((wide + 1, len(n)), -np.inf)
        come = np.zeros((wide + 1, len(n)), np.int8)
        by = np.full((wide + 1, len(n)), -1, np.int32)
        best[0] = 0.0
        width = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)[letters]  # 0: inside a character
        for i in range(wide):
            w = np.flatnonzero((i < n) & (width[i] > 0))
            if not len(w):
                continue
            here, state, single = best[i, w], np.zeros(len(w), np.int64), np.zeros(len(w), bool)
            end = np.minimum(n[w], i + width[i, w])
            alive, at = np.arange(len(w)), w
            for j in range(i, wide):
                inside = j < n[at]
                alive, at = alive[inside], at[inside]
                to = self.base[state[alive]] + letters[j, at].astype(np.int64) + 1
                ok = self.check[to] == state[alive]
                alive, at, to = alive[ok], at[ok], to[ok]
                if not len(alive):
                    break
                state[alive] = to
                v = self.value[to]
                is_piece = v >= 0
                k, c, v = alive[is_piece], at[is_piece], v[is_piece]
                single[k[j + 1 == i + width[i, c]]] = True
                sums = here[k] + self.score[v]
                more = sums > best[j + 1, c]
                c, v = c[more], v[more]
                best[j + 1, c], come[j + 1, c], by[j + 1, c] = sums[more], i, v
            lone = np.flatnonzero(~single)
            sums, c, k = here[lone] + self.fallback, w[lone], end[lone]
            more = sums > best[k, c]
            k, c = k[more], c[more]
            best[k, c], come[k, c], by[k, c] = sums[more], i, -1
        # Back from the ends: by place in the run, the piece that ends there, or the bytes of a character without a piece.
        ids, used = np.zeros((wide, len(n)), np.uint32), np.zeros((wide, len(n)), bool)
        j, w = n.copy(), cols
        while len(w):
            piece, i = by[j, w], come[j, w].astype(np.int64)
            known = piece >= 0
            ids[i[known], w[known]], used[i[known], w[known]] = piece[known], True
            for m in range(4):
                some = ~known & (i + m < j)
                ids[i[some] + m, w[some]], used[i[some] + m, w[some]] = self.bytes[letters[i[some] + m, w[some]]], True
            more = i > 0
            j, w = i[more], w[more]
        return ids.T[used.T], used.sum(0)

    def runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all runs, the places where each one's begin, and how many each has."""
        marked = [w.replace(b" ", MARK) for w in runs]
        n = np.fromiter(map(len, marked), np.int64, len(marked))
        start, data = np.cumsum(n) - n, np.frombuffer(b"".join(marked), np.uint8)
        at, count, out, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [np.zeros(0, np.uint32)], 0
        order = np.argsort(n, kind="stable")
        short = order[: int(np.searchsorted(n[order], LONGEST, side="right"))]
        for k in range(0, len(short), TOGETHER):  # runs of like length together
            some = short[k : k + TOGETHER]
            ids, m = self._walk(data, start[some], n[some])
            at[some], count[some] = total + np.cumsum(m) - m, m
            out.append(ids)
            total += len(ids)
        for k in order[len(short) :].tolist():
            ids = np.array(self.viterbi(marked[k]), np.uint32)
            at[k], count[k] = total, len(ids)
            out.append(ids)
            total += len(ids)
        return np.concatenate(out), at, count

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a chunk of texts, their offsets, and whether they decode to the text."""
        raw = data.tobytes()
        texts = [raw[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        plain = np.array([MARK not in t for t in texts], bool)
        spaced = [b" " + t.replace(MARK, b" ") if t else b"" for t in texts]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))])
        buf = np.frombuffer(b"".join(spaced), np.uint8)
        if not len(buf):
            return np.zeros(0, np.uint32), ends, plain
        space = buf == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[ends[:-1][ends[:-1] < len(buf)]] = True
        cuts = np.append(np.flatnonzero(first), len(buf))
        told = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(buf)]).dictionary_encode()
        ids, start, length = self.runs(told.dictionary.to_pylist())
        of = told.indices.to_numpy()
        n = length[of]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat(start[of] - to[:-1], n) + np.arange(to[-1])]
        cut = to[np.searchsorted(cuts, ends)]
        size = self.size[ids]
        back = np.concatenate([[0], np.cumsum(size)])
        exact = np.diff(back[cut]) == np.diff(ends)
        if back[-1] == len(buf):
            same = self.letters[np.repeat(self.begin[ids] - back[:-1], size) + np.arange(back[-1])] == buf
            wrong = np.concatenate([[0], np.cumsum(~same)])
            exact &= wrong[ends[1:]] == wrong[ends[:-1]]
        else:
            exact &= np.array([self.decode(ids[x:y].astype("<u4").tobytes()) == t for x, y, t in zip(cut[:-1], cut[1:], texts)], bool)
        return ids.astype("<u4"), cut, exact & plain

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        text = b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).replace(MARK, b" ")
        return text[1:] if text[:1] == b" " else text


@functools.lru_cache(1)
def model(path: str) -> Unigram:
    """One for each Python worker, kept from task to task: it takes long to build, and its size is fixed."""
    return Unigram(*vocabulary(path))


def _encode(path: str, with_ids: bool):
    def run(batches):
        m = model(path)
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text"), TEXT_BYTES):
                ids, cut, exact = m.texts(data, off)
                raw, at = ids.tobytes(), (4 * cut).tolist()
                fallback = np.concatenate([[0], np.cumsum(m.in_bytes[ids])])
                out = [b.column("doc_id")[lo:hi], pa.array(np.diff(cut)), pa.array(np.diff(fallback[cut])), pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], pa.int64()), pa.array(exact)]
                names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "exact"]
                if with_ids:
                    out.append(lists(ids.astype(np.int32), cut, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, exact (the ids decode to the text), and the ids unless only their digest is wanted."""
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, exact boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path or default_vocabulary(), with_ids), schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""
    path = path or default_vocabulary()

    def run(batches):
        m = model(path)
        for b in batches:
            text = [m.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
