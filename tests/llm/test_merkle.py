import hashlib
import zlib

import pytest

from quillspark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, tampered=False):
    fields = [None if v is None else str(v) for v in row[:5]]
    if tampered and fields[4] is not None:
        fields[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in fields[4])
    return h("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def tree(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, place, digest):
    seen = ""
    for nodes in levels[:-1]:
        low = place // 16 * 16
        run = nodes[low : low + 16]
        seen += "".join(run[: place - low] + run[place - low + 1 :])
        digest = h("".join(run[: place - low] + [digest] + run[place - low + 1 :]))
        place //= 16
    return digest, seen


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for of in sources.values():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            sub, low = climb(trees[s], i, leaf(r, hit))
            root, high = climb(top, k, sub)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(low + high), root, root == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows)
    assert got(queries.op13_merkle_manifest(spark, sf_dir)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17, 1], [256, 257, 1, 15], [700] + [1] * 40])
def test_shapes_of_trees(spark, sizes):
    rows = [(1000 * s + i, f"s{s}", "en", i, f"Text {s} {i}", "", "") for s, n in enumerate(sizes) for i in range(n)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_edge_cases(spark):
    rows = [(i, None, None, None, None, "x", None) for i in range(20)] + [(None, "é", "en", 3, "Abc", "", ""), (None, "é", "en", 3, "Abc", "", ""), (None, None, "en", 3, "", "", "")]
    rows += [(7, "", "", 0, "", "", ""), (7, "", "", 0, "Long WORD " * 20_000, "", ""), (7, "", "", 0, "ÀÉ É A", "", "")] + [(5, "z", "de", -4, "Same Row", "", "")] * 40 + [(-9, "=", "fr", 1, "=\n", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(merkle.manifest(df)) == brute(rows)
    assert merkle.manifest(df.limit(0)).collect() == []
    one = spark.createDataFrame(rows[:1], SCHEMA)
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")


def test_a_parent_waits_for_all_its_children():
    with pytest.raises(ValueError, match="has not heard"):
        merkle._receive((("=a", 0), [(0, 3, b"a" * 32), (2, 3, b"b" * 32)]))
