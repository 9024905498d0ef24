import math
import random
import re
import zlib

import numpy as np

from quillspark.llm import pieces, queries

ODD = ["", " ", "  a  b ", "héllo wörld\nnew\tline", "日本語 😀 \x00", "a▁b", "x" * 3000, "▁", "ࠀ﷐ \U0010ffff", "word " * 2000]


def brute(m, text):
    """Dynamic programming over all pieces of each run of spaces and what follows, without trie or chunks. Sums begin anew with each run, as sums
    over a whole text would round differently where two ways are equally good."""
    of = m.__dict__.setdefault("of", {p: i for i, p in enumerate(m.pieces) if p and m.scores[i] > -math.inf})
    longest = max(map(len, of))
    return [v for run in re.findall(rb" *[^ ]+| +", b" " + text.encode()) for v in best_way(m, of, longest, run.replace(b" ", pieces.MARK))] if text else []


def best_way(m, of, longest, run):
    starts = [i for i, c in enumerate(run) if c & 0xC0 != 0x80] + [len(run)]
    best, come = {0: 0.0}, {}
    for i, after in zip(starts, starts[1:]):
        for j in range(i + 1, min(len(run), i + longest) + 1):
            if (v := of.get(run[i:j])) is not None and best[i] + m.scores[v] > best.get(j, -math.inf):
                best[j], come[j] = best[i] + m.scores[v], (i, [v])
        if run[i:after] not in of and best[i] + m.fallback > best.get(after, -math.inf):
            best[after], come[after] = best[i] + m.fallback, (i, [m.by_byte[c] for c in run[i:after]])
    out, j = [], len(run)
    while j:
        i, ids = come[j]
        out.append(ids)
        j = i
    return [v for x in reversed(out) for v in x]


def test_viterbi_equals_brute_force():
    m = pieces.model(pieces.default_vocabulary())
    r = random.Random(9)
    texts = [*ODD[:6], *("".join(r.choice(" abcdehilnorstuéß\n1京") for _ in range(60)) for _ in range(60))]
    for t in texts:
        assert np.frombuffer(m.encode(t.encode()), "<u4").tolist() == brute(m, t), t


def test_trie_holds_exactly_its_keys():
    r = random.Random(1)
    keys = {bytes(r.randrange(256) for _ in range(r.randint(1, 4))): i for i in range(2000)}
    trie = pieces.DoubleArray(keys)
    for k in [*keys, *(bytes(r.randrange(256) for _ in range(3)) for _ in range(2000))]:
        s = 0
        for c in k:
            t = trie.base[s] + c + 1
            if trie.check[t] != s:
                s = -1
                break
            s = t
        assert (trie.value[s] if s > 0 else -1) == keys.get(k, -1)


def test_query_and_round_trip(spark, sf_dir):
    out = queries.op2_sentencepiece(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(out) == len(texts) and all(r.exact for r in out)
    m = pieces.model(pieces.default_vocabulary())
    bytes_ = set(m.by_byte)
    for r in out:  # every document, whole
        ids = brute(m, texts[r.doc_id])
        assert (r.n_pieces, r.n_byte_pieces, r.ids_crc32) == (len(ids), sum(i in bytes_ for i in ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_chunks_slabs_and_long_runs(monkeypatch):
    m = pieces.model(pieces.default_vocabulary())
    r = random.Random(12)
    texts = [*ODD, *("".join(r.choice(" abcdehilnorstuéß\n1京😀") for _ in range(r.randint(0, 120))) for _ in range(80))]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    for together, longest in ((16_384, 48), (7, 9), (1, 1)):
        monkeypatch.setattr(pieces, "TOGETHER", together)
        monkeypatch.setattr(pieces, "LONGEST", longest)
        ids, cut, exact = m.texts(np.frombuffer(b"".join(raw), np.uint8), off)
        for i, t in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == brute(m, t.replace("▁", " "))
            assert exact[i] == ("▁" not in t)


def test_odd_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 2), (3, "twice", 1), (3, "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode(df)
    back = pieces.decode(got)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((d, (t or "").replace("▁", " ")) for d, t, _ in rows), key=str)
    assert sum(not r.exact for r in got.collect()) == 2
    assert pieces.encode(df.limit(0)).collect() == []
