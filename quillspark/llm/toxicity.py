"""Toxicity scores from a learned lexicon, whose misspelled terms Levenshtein automata find, and from the words around each hit.

Fitting takes a bounded sample of labelled texts (``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean ones, distinct, by the smallest hashes) of rows whose labels may be seen.
Candidates are words and stems (beginnings of words) that more groups of near copies among the toxic texts have than chance explains, at a rate ``FALSE`` of false
discoveries. The lexicon covers their words one after the other, each time by the term with most words in groups that no term covers yet, less ``CLEAN_WEIGHT`` for each clean text.

A text's words run through the trie of the lexicon: the automaton of a word is kept as the band of its edit distances (with neighbours that trade places), for
many words at once, and a branch of the trie is left when its band exceeds what the terms below it allow (``errors``). A stem fits a word
that begins with it. Each hit has a context score from the ``WINDOW`` words around it: quotation marks that enclose it on its line and words of reporting raise the score,
addressing a person lowers it; from 1 on a hit counts as quoted. A hit's class is its distance and whether it is quoted; its weight is the
log likelihood ratio of term and class in the sample, where a class that was never seen gives the probability ``PRIOR``. A text's score adds
the best class of each of its terms to the log odds of all labelled texts; texts without such hits get the rate of toxic ones among those.

Defined cases: a null or empty text has no hits; rows with null doc_id are not held out and have no label; labels with null doc_id or toxic are left out, and of several
of a doc_id or text the highest counts; without toxic or clean labels there are no terms, and without toxic ones scores are 0; rows that share a doc_id are scored each for
itself; equal texts have equal scores; a very long text is one chunk of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grams, U, buffers, chunks, mix, release, spans, symbols, table, word_ids

#: Distinct labelled texts of the sample that the model is fitted on.
FIT_TOXIC, FIT_CLEAN = 4000, 12_000
#: Words and stems of toxic texts that are counted in clean ones (the most frequent), candidates for the cover, and terms of the lexicon.
COUNTED, CANDIDATES, TERMS = 20_000, 2000, 256
STEMS = range(4, 9)
MIN_TEXTS, MIN_RATIO, CLEAN_WEIGHT, FALSE, SKETCHES = 2, 10.0, 5, 0.01, 4
#: Most errors that any term allows.
MOST = 2
#: What a hit of a class says that the sample never showed: plain with 0, 1, 2 errors, then quoted.
PRIOR = (0.9, 0.5, 0.4, 0.1, 0.06, 0.05)
WINDOW, QUOTED = 8, 1.0
#: Words of reporting and of address in the languages of the corpus (fixed values), and what one of them near a hit adds to its context score.
REPORTING = "said says called calls word words term quote quoted wrote slur insult sagte nannte wort zitat schrieb dit mot terme citation dijo palabra cita llamó".split()
ADDRESS = "you your you're du dich dein ihr tu toi te vous votre tú usted eres tus".split()
REPORTED, ADDRESSED = 0.5, -0.5
#: Bytes of words after normalising: letters, digits, signs that stand for letters, and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *b"@$*!"]] = True
WORD[0x80:] = True


def errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else MOST


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case without invisible characters; quotation marks become ``"``, other marks beyond ASCII spaces."""
    col = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    col = pc.utf8_lower(col)
    if (data >= 0xC2).any():
        col = pc.replace_substring_regex(col, r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
        col = pc.replace_substring_regex(col, r"[«»“”„‟‹›]", '"')
        col = pc.replace_substring_regex(col, r"[\x{80}-\x{A9}\x{AC}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]", " ")
    return buffers(col)


class Texts:
    """The words of a chunk of texts and the distinct ones among them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = normal(data, off)
        s, e, _ = spans(self.data, self.off, WORD)
        letter = WORD & ~np.isin(np.arange(256), list(b"@$*!"))
        # Signs at the ends of words are marks.
        before = np.concatenate([[0], np.cumsum(letter[self.data])])
        some = before[e] > before[s]
        s, e = s[some], e[some]
        places = np.flatnonzero(letter[self.data])
        self.s, self.e = places[before[s]], places[before[e] - 1] + 1
        self.count = np.searchsorted(self.s, self.off)
        ids = word_ids(self.data, self.s, self.e)
        self.word, first, self.of = np.unique(ids, return_index=True, return_inverse=True)
        raw = self.data.tobytes()
        self.words = [raw[a:b].decode() for a, b in zip(self.s[first].tolist(), self.e[first].tolist())]
        self.text = np.repeat(np.arange(len(self.off) - 1), np.diff(self.count))


class Lexicon:
    """Terms in a trie that is intersected with the automata of many words at once. A term ends with ``*`` if it is a stem."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.below: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for t, term in enumerate(terms):
            at, d = 0, errors(term.rstrip("*"))
            self.most[0] = max(self.most[0], d)
            for c in term.rstrip("*"):
                if c not in self.below[at]:
                    self.below[at][c] = len(self.below)
                    self.below.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.below[at][c]
                self.most[at] = max(self.most[at], d)
            self.ends[at].append(t)
        self.width = max((len(t) for t in terms), default=0) + 2 * MOST + 2

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words, terms and distances, the smallest of each word and term."""
        none = np.zeros(0, np.int64)
        if not words or not self.terms:
            return none, none, none
        codes = np.zeros((len(words), self.width), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        cut = [w[: self.width] for w in words]
        held = np.minimum(size, self.width)
        flat = np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(words)), held)
        codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)] = flat
        out: list[tuple] = []
        begin = np.full((len(words), 2 * MOST + 1), 9, np.int8)
        begin[:, MOST:] = np.arange(MOST + 1)
        self._walk(0, 0, "", np.arange(len(words)), begin, begin, codes, size, out)
        if not out:
            return none, none, none
        return tuple(np.concatenate([x[k] for x in out]) for k in range(3))

    def _walk(self, node: int, depth: int, last: str, rows, band, older, codes, size, out) -> None:
        """``band`` holds, for the words of ``rows``, the distances of the node's letters to their beginnings, from ``depth - MOST`` letters on."""
        ends = depth - MOST + np.arange(2 * MOST + 1)
        for t in self.ends[node]:
            if self.terms[t].endswith("*"):
                d = np.where(ends <= size[rows, None], band, 9).min(1)
            else:
                b = size[rows] - depth + MOST
                d = np.where((b >= 0) & (b <= 2 * MOST), band[np.arange(len(rows)), np.clip(b, 0, 2 * MOST)], 9)
            fits = np.flatnonzero(d <= errors(self.terms[t].rstrip("*")))
            if len(fits):
                out.append((rows[fits], np.full(len(fits), t), d[fits].astype(np.int64)))
        for c, child in self.below[node].items():
            new, code = np.full_like(band, 9), ord(c)
            for b in range(2 * MOST + 1):
                j = depth + 1 + b - MOST
                if j < 0:
                    continue
                if j == 0:
                    new[:, b] = depth + 1
                    continue
                best = band[:, b] + (codes[rows, j - 1] != code)
                if b < 2 * MOST:
                    best = np.minimum(best, band[:, b + 1] + 1)
                if b:
                    best = np.minimum(best, new[:, b - 1] + 1)
                if last and j > 1:
                    swapped = (codes[rows, j - 2] == code) & (codes[rows, j - 1] == ord(last))
                    best = np.where(swapped, np.minimum(best, older[:, b] + 1), best)
                new[:, b] = np.minimum(best, 9)
            alive = np.flatnonzero(new.min(1) <= self.most[child])
            if len(alive):
                self._walk(child, depth + 1, c, rows[alive], new[alive], band[alive], codes, size, out)


def context(texts: Texts, at: np.ndarray) -> np.ndarray:
    """The context score of the words ``at`` these places."""
    marks = np.flatnonzero(texts.data == ord('"'))
    breaks = np.union1d(np.flatnonzero(texts.data == 10), texts.off[:-1])
    s, e = texts.s[at], texts.e[at]
    line = breaks[np.searchsorted(breaks, s, side="right") - 1]
    low, high = np.maximum(at - WINDOW, texts.count[texts.text[at]]), np.minimum(at + WINDOW, texts.count[texts.text[at] + 1] - 1)
    before = np.searchsorted(marks, s)
    inside = (before - np.searchsorted(marks, line)) % 2 == 1
    ends = np.append(marks, len(texts.data) + 1)[before]
    starts = np.concatenate([[-1], marks])[before]
    stop = np.append(breaks, len(texts.data))[np.searchsorted(breaks, s, side="right")]
    out = ((inside & (ends < np.minimum(stop, texts.e[high] + 2)) & (ends >= e)) & (starts >= texts.s[low] - 2)).astype(float)
    weight = dict.fromkeys(REPORTING, REPORTED) | dict.fromkeys(ADDRESS, ADDRESSED)
    known = np.array([weight.get(w, 0.0) for w in texts.words])
    sums = np.concatenate([[0.0], np.cumsum(known[texts.of])])
    return out + sums[high + 1] - sums[low]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    #: Weight of each term and class, the log odds of labelled texts, and the score of texts without hits that weigh.
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    odds: float = 0.0
    without: float = 0.0

    def weight(self, term: int, kind: int) -> float:
        # What was never seen weighs so that, with the odds, it gives the prior.
        return self.weights.get((term, kind), math.log(PRIOR[kind] / (1 - PRIOR[kind])) - self.odds)


def best_hits(texts: Texts, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, class) with the best class of each text and term."""
    word, term, distance = lexicon.matches(texts.words)
    none = np.zeros(0, np.int64)
    if not len(word):
        return none, none, none
    # Places of the words that fit, each with all its terms.
    order = np.argsort(word, kind="stable")
    word, term, distance = word[order], term[order], distance[order]
    first, last = np.searchsorted(word, texts.of), np.searchsorted(word, texts.of, side="right")
    at = np.flatnonzero(last > first)
    quoted = context(texts, at) >= QUOTED
    n = (last - first)[at]
    pick = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    text, term, kind = np.repeat(texts.text[at], n), term[pick], distance[pick] + (MOST + 1) * np.repeat(quoted, n)
    order = np.lexsort((kind, term, text))
    text, term, kind = text[order], term[order], kind[order]
    new = np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))
    return text[new], term[new], kind[new]


def seen(doc_id: str = "doc_id"):
    """Whether labels of a row may be learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """th, toxic and text of the distinct texts that the model is fitted on, and how many toxic and clean ones have labels in all."""
    known = labels.where("doc_id is not null and toxic is not null").where(seen()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") >= 1).alias("toxic"))
    key = F.xxhash64("text")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("th")).distinct()
    marked = table(texts.join(known, "doc_id").groupBy("th").agg(F.max("toxic").alias("toxic")), "labelled")
    n = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("th", F.lit(1)), "th").limit(m) for t, m in ((True, FIT_TOXIC), (False, FIT_CLEAN))]
    chosen = table(chosen[0].unionAll(chosen[1]), "chosen")
    # At most FIT_TOXIC + FIT_CLEAN pairs of numbers are broadcast.
    found = docs.where("text is not null").select("text", key.alias("th")).join(F.broadcast(chosen), "th").dropDuplicates(["th"])
    out = table(found, "sample")
    release(marked, chosen)
    return out, n.get(True, 0), n.get(False, 0)


def features(texts: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words and stems, and the pairs of text and feature, each once."""
    pairs = [np.unique(texts.text * len(texts.words) + texts.of)] if texts.words else [np.zeros(0, np.int64)]
    text, feature, names = pairs[0] // max(1, len(texts.words)), pairs[0] % max(1, len(texts.words)), list(texts.words)
    all_text, all_feature = [text], [feature]
    for size in STEMS:
        stems: dict[str, int] = {}
        of = np.array([stems.setdefault(w[:size] + "*", len(stems)) if len(w) >= size else -1 for w in texts.words], np.int64)
        has = of[feature] >= 0
        both = np.unique(text[has] * max(1, len(stems)) + of[feature[has]])
        all_text.append(both // max(1, len(stems)))
        all_feature.append(both % max(1, len(stems)) + len(names))
        names += list(stems)
    return names, np.concatenate(all_text), np.concatenate(all_feature)


def counted(texts: DataFrame, among: list[str] | None = None) -> DataFrame:
    """feature and n: in how many texts each word or stem is found (of those ``among``)."""
    wanted = None if among is None else pa.array(among, pa.string())

    def run(batches):
        for b in batches:
            for _, _, data, off in chunks(b.column("text")):
                names, _, feature = features(Texts(data, off))
                out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(feature, minlength=len(names)))], names=["feature", "n"])
                yield out if wanted is None else out.filter(pc.is_in(out.column(0), wanted))

    return texts.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def groups(texts: DataFrame) -> dict[int, int]:
    """The group of near copies of each text (th) of the sample: texts that share one of ``SKETCHES`` smallest hashes of three words are of one group."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                t = Texts(data, off)
                sym = symbols(t.data, t.s, t.e)
                low: list[list[int]] = []
                for x, y in zip(t.count[:-1].tolist(), t.count[1:].tolist()):
                    h = Grams(sym[x:y]).every(min(3, max(1, y - x)))
                    low.append([int(mix(h ^ U(k * 0x9E3779B9 + 1)).min() >> U(1)) for k in range(SKETCHES)] if len(h) else [])
                yield pa.RecordBatch.from_arrays([b.column("th")[lo:hi], pa.array(low, pa.list_(pa.int64()))], names=["th", "low"])

    of: dict = {}

    def root(x):
        while of.setdefault(x, x) != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    rows = texts.select("th", "text").mapInArrow(run, "th long, low array<long>").collect()
    for r in rows:
        for k, h in enumerate(r.low):
            of[root((k, h))] = root(r.th)
    return {r.th: root(r.th) for r in rows}


def chance(n: int, of: int, share: float) -> float:
    """P(Bin(of, share) >= n)."""
    logs = [math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(share) + (of - k) * math.log1p(-share) for k in range(n, of + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def cover(candidates: dict[str, int], words: set[tuple[int, str]]) -> list[str]:
    """Terms that cover the pairs of group and word: ``candidates`` with their clean texts, each time the one with most pairs left, less those."""
    pairs: dict[str, set] = {c: set() for c in candidates}
    for pair in words:
        for c in terms_of(pair[1]):
            if c in pairs:
                pairs[c].add(pair)
    whole = {c: len(x) for c, x in pairs.items()}
    out: list[str] = []
    while pairs and len(out) < TERMS:
        rank = {c: (len(x) - CLEAN_WEIGHT * candidates[c], whole[c], len(c.rstrip("*")), not c.endswith("*"), c) for c, x in pairs.items()}
        best = max(rank, key=rank.__getitem__)
        if rank[best][0] < MIN_TEXTS:
            break
        out.append(best)
        gone = pairs.pop(best)
        pairs = {c: left for c, x in pairs.items() if (left := x - gone)}
    return out


def terms_of(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:size] + "*" for size in STEMS if len(word) >= size)]


def lexicon(texts: DataFrame, toxic: int, clean: int) -> list[str]:
    """The terms of the sample ``texts``, which has so many toxic and clean ones."""
    if not toxic or not clean:
        return []
    bad, good = texts.where("toxic"), texts.where("not toxic")
    often = [r.feature for r in counted(bad).where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "feature").limit(COUNTED).collect()]
    other = {r.feature: r.n for r in counted(good, sorted(often)).collect()}
    # Features that are rare in clean texts, and the groups of toxic texts that have them.
    rare = {f for f in often if other.get(f, 0) <= clean / (MIN_RATIO * MIN_TEXTS)}

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                t = Texts(data, off)
                has = np.array([any(f in rare for f in terms_of(w)) for w in t.words], bool)[t.of] if t.words else np.zeros(0, bool)
                found: list[set[str]] = [set() for _ in range(hi - lo)]
                for d, w in zip(t.text[has].tolist(), t.of[has].tolist()):
                    found[d].add(t.words[w])
                yield pa.RecordBatch.from_arrays([b.column("th")[lo:hi], pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=["th", "found"])

    group = groups(bad)
    words = {(group[r.th], w) for r in bad.select("th", "text").mapInArrow(run, "th long, found array<string>").collect() for w in r.found}
    having: dict[str, set[int]] = {}
    for g, w in words:
        for f in terms_of(w):
            if f in rare:
                having.setdefault(f, set()).add(g)
    n = len(set(group.values()))
    share = n / (n + clean)
    # Features that the same groups have are one test.
    tests = len({(frozenset(of), other.get(f, 0)) for f, of in having.items() if len(of) >= MIN_TEXTS})
    test = {}
    for f, of in having.items():
        k, c = len(of), other.get(f, 0)
        if k >= MIN_TEXTS and (k + 0.5) / (n + 1) >= MIN_RATIO * (c + 0.5) / (clean + 1):
            test[f] = chance(k, k + c, share)
    # Benjamini and Hochberg: the most terms of which a share FALSE at most is there by chance.
    order = sorted(test, key=lambda f: (test[f], f))
    found, last = set(), 0
    for i, f in enumerate(order, 1):
        found.add((frozenset(having[f]), other.get(f, 0)))
        if test[f] <= len(found) * FALSE / tests:
            last = i
    return cover({f: other.get(f, 0) for f in order[:last][:CANDIDATES]}, words)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts, toxic, clean = sample(docs, labels)
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    model = Model(lexicon(texts, bad, good), odds=math.log((toxic + 1) / (clean + 1)))
    terms = Lexicon(model.terms)

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                text, term, kind = best_hits(Texts(data, off), terms)
                mark = b.column("toxic")[lo:hi].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(mark[text]), pa.array(term), pa.array(kind)], names=["toxic", "term", "kind"])

    hits: dict[tuple[int, int], list[int]] = {}
    for r in texts.select("toxic", "text").mapInArrow(run, "toxic boolean, term long, kind long").groupBy("toxic", "term", "kind").count().collect():
        hits.setdefault((r.term, r.kind), [0, 0])[not r.toxic] += r["count"]
    for (term, kind), (t, c) in hits.items():
        p = PRIOR[kind]
        model.weights[term, kind] = math.log((t + p) / (bad + 1)) - math.log((c + 1 - p) / (good + 1))
    # The rate of toxic texts among those without hits that weigh.
    left = {r.toxic: r["count"] for r in texts.select("toxic", "text").mapInArrow(_scored(model, ["toxic"]), "toxic boolean, score double, n_hits long, n_quoted long, terms string").where("score is null").groupBy("toxic").count().collect()}
    t, c = toxic * left.get(True, 0) / max(1, bad), clean * left.get(False, 0) / max(1, good)
    model.without = t / (t + c + 1)
    release(texts)
    return model


def _scored(model: Model, keep: list[str]):
    terms = Lexicon(model.terms)

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                text, term, kind = best_hits(Texts(data, off), terms)
                weight = np.array([model.weight(t, k) for t, k in zip(term.tolist(), kind.tolist())], float)
                some = weight > 0
                n = hi - lo
                total = np.bincount(text[some], weight[some], n) + model.odds
                names: list[list[str]] = [[] for _ in range(n)]
                for d, t in zip(text[some].tolist(), term[some].tolist()):
                    names[d].append(model.terms[t])
                has = np.bincount(text[some], minlength=n) > 0
                score = pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))), mask=~has)
                quoted = np.bincount(text[kind > MOST], minlength=n)
                told = [pa.array(np.bincount(text[some], minlength=n)), pa.array(quoted), pa.array([",".join(sorted(x)) for x in names])]
                yield pa.RecordBatch.from_arrays([*(b.column(k)[lo:hi] for k in keep), score, *told], names=[*keep, "score", "n_hits", "n_quoted", "terms"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_hits (terms that weigh), n_quoted (terms that are found quoted only) and terms of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model, ["doc_id"]), "doc_id long, score double, n_hits long, n_quoted long, terms string")
    return rows.withColumn("score", F.coalesce("score", F.lit(model.without)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model of the labels that may be seen."""
    return score(docs, fit(docs, labels)).select("doc_id", (~seen()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits", "n_quoted", "terms")
