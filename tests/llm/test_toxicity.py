import random
import zlib

import numpy as np

from quillspark.llm import queries, toxicity
from quillspark.llm.toxicity import Lexicon, Texts

LABELS = "doc_id long, quality int, toxic int, text string"
DOCS = "doc_id long, text string, lang string, toxic string, score string"


def distance(a, b):
    """Edit distance with neighbours that trade places."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_automata_equal_edit_distances():
    rng = random.Random(5)
    terms = ["abcab", "abcabcabc", "bca", "cabba*", "abbcabcab*", "aé漢ab", "abcabcab"]
    words = sorted({"".join(rng.choices("abcé漢", k=rng.randint(1, 13))) for _ in range(3000)} | {t.rstrip("*") for t in terms} | {"bacab", "abacb", "abcabcabcd", ""} - {""})
    got = dict(zip(zip(*(x.tolist() for x in Lexicon(terms).matches(words)[:2])), Lexicon(terms).matches(words)[2].tolist()))
    want = {}
    for i, w in enumerate(words):
        for k, t in enumerate(terms):
            stem = t.rstrip("*")
            d = min(distance(stem, w[:j]) for j in range(len(w) + 1)) if t.endswith("*") else distance(stem, w)
            if d <= toxicity.errors(stem):
                want[i, k] = d
    assert got == want and {0, 1, 2} <= set(want.values())


def chunk(*texts):
    data = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_words_and_classes():
    t = chunk("You IDIOT!", "", "an id​iot, id!ot; idoit", 'he wrote "what an idiot" there', "“idiot” or «idiot»", 'say "no" idiot "yes"', 'open " idiot')
    assert t.words[t.of[1]] == "idiot"
    text, term, kind = toxicity.best_hits(t, Lexicon(["idiot"]))
    assert dict(zip(text.tolist(), kind.tolist())) == {0: 0, 2: 0, 3: 3, 4: 3, 5: 0, 6: 0}
    assert not len(toxicity.best_hits(chunk("", "  "), Lexicon(["idiot"]))[0]) and not len(toxicity.best_hits(t, Lexicon([]))[0])


def corpus(n=1200):
    """Texts of invented words; toxic ones have a term or a word with a stem, near copies share their rare words."""
    rng = random.Random(1)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(150)]
    rare = ["".join(rng.choices("klmnopqrst", k=9)) for _ in range(3000)]
    bad = ["worthless", "scoundrel", "trashy"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(common, k=60) + rng.sample(rare, 5)
        toxic = int(i % 8 == 0)
        if toxic:
            words.insert(rng.randint(0, 50), rng.choice([*bad, "zwack" + rng.choice(common)]))
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, toxic))
    for i in range(n, n + 12):  # copies of one toxic text
        docs.append((i, docs[0][1] + f" copy{i}"))
        labels.append((i, 1))
    return docs, labels


def test_learned_terms_and_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, None, "x", "y") for i, t in docs], DOCS)
    model = toxicity.fit(d, spark.createDataFrame([(i, 1, y, None) for i, y in labels], LABELS))
    assert sorted(model.terms) == ["scoundrel", "trashy", "worthless", "zwack*"]
    rows = toxicity.report(d, spark.createDataFrame([(i, 1, y, None) for i, y in labels], LABELS)).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.held_out) and sum(r.held_out for r in rows) > 200

    new = [(1, "a worthles thing"), (2, "what a scuondrel"), (3, "he said “worthless” then"), (4, 'the "worthless" term'), (5, "nothing of the kind"), (6, "Wortlhess zwackab"), (7, None), (8, ""), (9, 'you "worthless" thing')]
    by = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert [by[k].score >= 0.3 for k in range(1, 10)] == [True, True, False, False, False, True, False, False, True]
    assert by[3].n_quoted == 1 and by[1].terms == "worthless" and by[5].score == by[7].score == by[8].score
    # Labels of held-out rows change nothing.
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, None) for i, y in labels]
    assert toxicity.fit(d, spark.createDataFrame(flipped, LABELS)) == model


def test_query_scores_all_rows(spark, sf_dir):
    rows = queries.op12_toxicity(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_edge_cases(spark):
    docs, labels = corpus(400)
    odd = [(None, "worthless"), (None, None), (5001, ""), (5002, "worthless " * 30_000), (5003, "x" * 300_000), (5004, "trashy"), (5004, "trashy"), (5005, "漢字 🙂 \x00"), (0, docs[0][1])]
    d = spark.createDataFrame([(i, t, None, "x", "y") for i, t in docs + odd], DOCS)
    some = [(i, 1, y, None) for i, y in labels]
    marks = spark.createDataFrame(some + [some[1], (None, 1, 1, None), (2, 1, None, None), (8, 1, 0, None), (8, 1, 1, None), (99_999, 1, 1, None)], LABELS)
    rows = toxicity.report(d, marks).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert not any(r.held_out for r in by[None]) and len(by[5004]) == 2 and by[5004][0] == by[5004][1]
    assert sorted(r.predicted for r in by[None]) == [0, 1] and by[5002][0].predicted == 1 and by[5001][0].score == by[5003][0].score == by[5005][0].score < 0.3
    assert toxicity.report(d.limit(0), marks).collect() == []
    assert {r.score for r in toxicity.report(d, marks.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.report(d, marks.where("toxic = 0")).collect()} == {0.0}
