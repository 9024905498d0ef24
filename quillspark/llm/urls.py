"""URL filters: rules first, then naive Bayes over the words of host and path.

Host names are segmented by unigram Viterbi: word counts of the pages' visible text give the words their log
probabilities, and letters that no word covers cost more the longer the run. Segmented host words and path tokens
feed a multinomial naive Bayes model, trained on the urls that rules decide, of which all are counted.

No count is cut, and none comes to the driver but the sums. Each distinct word of the urls is joined with the counts of its own substrings, which are all
that its segmentation can use, and segmented once: numbers of words and hashes of substrings meet, never texts, and what they find serves as a dictionary, where texts decide. Each distinct url is joined with the segmentations of its words, counted for the model if a rule
decides it, joined with the weights of its tokens, and scored once. Weights are added as whole multiples of 2**-36, so sums have no order.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of its (no) words; rules
of equal length: the one with the longer host, then the smaller string; if the rules decide no url, the verdict
is allow; rows that share a page_id are judged each for itself; a very long url is one row's memory, and its words' substrings are 16 bytes each, made size by size; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, U, mix, release, table

#: Substrings of up to so many letters are known by a hash; longer counted words by that of their first letters.
SHORT = 64
#: Letters of words that are looked at together, tasks that share the keys of few letters, and the share of rows (one in so many) that makes a key frequent.
LETTERS, SALT, HOT = 1 << 18, 64, 1000
#: Weights are multiples of one part in this.
UNIT = 1 << 36
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.when(has, F.regexp_extract(rest, r"^([^/?#]*)", 1)).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), [-ord(c) for c in r[0]])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits concatenated names into the words of the greatest likelihood."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` is the sum of all counts, if ``counts`` has only some of them."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.score = {w: math.log(c / total) for w, c in counts.items()}
        self.sizes = sorted({len(w) for w in counts})
        self.unknown = math.log(1 / total)
        self.split = lru_cache(65536)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(name) + 1):
            options = []
            for n in self.sizes:
                if n > j:
                    break
                if (s := self.score.get(name[j - n : j])) is not None:
                    options.append((best[j - n][0] + s, j - n))
            options.append((best[j - 1][0] + self.unknown - math.log(10), j - 1))
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        out, j = [], len(name)
        while j:
            i = best[j][1]
            out.append(name[i:j])
            j = i
        return tuple(reversed(out))


def names(text: str) -> list[str]:
    """The runs of letters and the runs of digits."""
    out, word = [], ""
    for c in text.lower() + "/":
        if c.isalnum() and (not word or word[-1].isdigit() == c.isdigit()):
            word += c
            continue
        if word:
            out.append(word)
        word = c if c.isalnum() else ""
    return out


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Words of host and path; numbers count by their number of digits."""
    out: list[str] = []
    for side, text in (("h", host), ("p", path)):
        for word in names(text):
            out += [f"{side}:#{len(word)}"] if word.isdigit() else [f"{side}:{w}" for w in segmenter.split(word)]
    return out


def _names(batches):
    """The names of host and path in order, with their side; numbers by their number of digits."""
    for b in batches:
        out = []
        for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
            out.append([f"{side}#{len(w)}" if w.isdigit() else f"{side}:{w}" for side, text in (("h", host), ("p", path)) for w in names(text)])
        yield b.append_column("names", pa.array(out, pa.list_(pa.string())))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums over the letters of the words one after the other, the inverse powers that make them hashes, and the words' offsets."""
    off = np.cumsum([0, *map(len, words)])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U)
    power, inverse = WORDS.upto(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, U)
    np.cumsum(mix(letters) * power[: len(letters)], out=sums[1:])
    return sums, inverse, off


def _keys(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """Hashes of the ``n`` letters from each place on."""
    return mix((sums[at + n] - sums[at]) * inverse[at]).view(np.int64)


def _substrings(sizes: list[int]):
    """The distinct keys of the substrings of each word: of each size up to ``SHORT`` that counted words have, and beyond of the first ``SHORT`` letters."""

    def some(number: list[int], words: list[str]):
        sums, inverse, off = _letters(words)
        of, left = np.repeat(np.arange(len(words)), np.diff(off)), np.repeat(off[1:], np.diff(off)) - np.arange(off[-1])
        for size in sizes:
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            h, i = _keys(sums, inverse, at, min(size, SHORT)), of[at]
            order = np.lexsort((h, i))
            h, i = h[order], i[order]
            new = np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(number)[i[new]]), pa.array(np.full(new.sum(), size, np.int32)), pa.array(h[new])], names=["i", "size", "h"])

    def run(batches):
        for b in batches:
            number, words, held = [], [], 0
            for i, word in zip(b.column("i").to_pylist(), b.column("word").to_pylist()):
                if words and held + len(word) > LETTERS:
                    yield from some(number, words)
                    number, words, held = [], [], 0
                number.append(i)
                words.append(word)
                held += len(word)
            if words:
                yield from some(number, words)

    return run


def _hashed(batches):
    """The key of each counted word."""
    for b in batches:
        words = b.column("w").to_pylist()
        size = np.fromiter(map(len, words), np.int64, len(words))
        sums, inverse, off = _letters([w[:SHORT] for w in words])
        h = _keys(sums, inverse, off[:-1], np.minimum(size, SHORT)) if words else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("w"), b.column("n"), pa.array(np.minimum(size, SHORT + 1).astype(np.int32)), pa.array(h)], names=["w", "n", "size", "h"])


def _cut(total: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a word and its dictionary at a time
                word, known = b.column("word")[i].as_py(), b.column("known")[i].as_py()
                pieces = Segmenter({x["w"]: x["n"] for x in known or []}, total)._split(word)
                yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([pieces], pa.list_(pa.string()))], names=["word", "pieces"])

    return run


def counted(pages: DataFrame) -> DataFrame:
    """w and n: all words of all pages' visible text."""
    visible = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    return pages.select(F.explode(F.regexp_extract_all(visible, F.lit(r"\p{L}+"), 0)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def segmented(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(word, pieces) of distinct words, by the counts of all words of the pages."""
    counts = table(counted(pages), "words")
    size = F.least(F.length("w"), F.lit(SHORT + 1))
    sizes = counts.groupBy(size.alias("size")).agg(F.sum("n").alias("n")).collect()  # SHORT + 1 rows at most
    numbered = table(words.select("word").withColumn("i", F.monotonically_increasing_id()), "numbered")
    # Few letters are in nearly all words: their counts are dealt to ``SALT`` tasks.
    few = F.col("size") <= 3
    parts_ = numbered.mapInArrow(_substrings(sorted(r["size"] for r in sizes)), "i long, size int, h long").withColumn("salt", F.when(few, F.pmod("i", F.lit(SALT))).otherwise(0).cast("int"))
    dealt = F.explode(F.when(few, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))
    keyed = counts.mapInArrow(_hashed, "w string, n long, size int, h long").withColumn("salt", dealt)
    known = parts_.join(keyed, ["size", "h", "salt"]).groupBy("i").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    out = table(numbered.join(known, "i", "left").select("word", "known").mapInArrow(_cut(sum(r["n"] for r in sizes)), "word string, pieces array<string>"), "segments")
    release(counts, numbered)
    return out


def frequent(keys: DataFrame, key: str) -> DataFrame:
    """The keys (with their number ``n``) that make up one in ``HOT`` of all rows or more: no more than ``HOT`` keys of at most ``SHORT`` letters."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    return keys.where((F.col("n") * HOT >= total) & (F.length(key) <= SHORT)).select(key)


def joined(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right``, null where there is none. The rows of frequent keys stay where they are: what ``right`` has of these is broadcast."""
    hot = F.broadcast(hot)
    return left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left").unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block), words of the host."""
    host, path = parts(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = by_rule(F.col("host"), F.col("path"), rules)
    each = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("said", said)
    # Each distinct url gets a number, which the written table fixes, so that its tokens need not carry it.
    named = each.mapInArrow(_names, "host string, path string, n long, said string, names array<string>")
    each = table(named.withColumn("u", F.monotonically_increasing_id()), "urls")
    name = F.col("name")
    found = each.select("u", F.posexplode("names").alias("at", "name")).select("u", "at", F.left(name, F.lit(1)).alias("side"), F.substr(name, F.lit(2), F.lit(1)).alias("kind"), F.substr(name, F.lit(3)).alias("word"))
    words = table(found.where("kind = ':'").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "names")
    pieces = segmented(pages, words)
    one = joined(found.where("kind = ':'"), pieces, "word", frequent(words, "word")).select("u", "at", "side", "pieces").union(found.where("kind = '#'").select("u", "at", "side", F.array(F.concat(F.lit("#"), "word")).alias("pieces")))
    token_lists = one.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("at", F.transform("pieces", lambda x: F.concat("side", F.lit(":"), x)).alias("t")))).alias("x"))
    cut = each.select("u", "host", "path", "n", "said").join(token_lists.select("u", F.flatten("x.t").alias("tokens")), "u", "left")
    cut = table(cut.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "tokens")

    taught = cut.where("said is not null")
    sums = {r["said"]: (r["urls"], r["tokens"]) for r in taught.groupBy("said").agg(F.sum("n").alias("urls"), F.sum(F.col("n") * F.size("tokens")).alias("tokens")).collect()}
    (nb, tb), (na, ta) = sums.get("block", (0, 0)), sums.get("allow", (0, 0))
    seen = taught.select("said", "n", F.explode("tokens").alias("token")).groupBy("token").agg(*[F.sum(F.when(F.col("said") == k, F.col("n")).otherwise(0)).alias(k) for k in ("block", "allow")])
    seen = table(seen, "model")
    size = seen.count() + 1
    odds = lambda b, a: F.log((b + 1) / F.lit(float(tb + size))) - F.log((a + 1) / F.lit(float(ta + size)))
    whole = lambda x: F.round(x * UNIT).cast("long")
    weights = seen.select("token", whole(odds(F.col("block"), F.col("allow"))).alias("weight"))
    other = whole(odds(F.lit(0), F.lit(0)))
    each_token = cut.select("u", F.explode("tokens").alias("token"))
    often = frequent(each_token.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    scores = joined(each_token, weights, "token", table(often, "often")).groupBy("u").agg(F.sum(F.coalesce("weight", other)).alias("sum"))
    prior = math.log((nb + 1) / (na + 1))
    score = F.lit(prior) + F.coalesce("sum", F.lit(0)) / UNIT if nb + na else F.lit(0.0)
    host_words = F.array_join(F.transform(F.filter("tokens", lambda t: F.startswith(t, F.lit("h:"))), lambda t: F.substr(t, F.lit(3))), " ")
    judged = table(cut.join(scores, "u", "left").select("host", "path", score.cast("double").alias("score"), host_words.alias("words")), "scores")
    release(each, words, pieces, cut, seen)
    verdict = F.coalesce(F.col("said"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    out = urls.withColumns({"rule": rule, "said": said}).join(judged, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "words")
