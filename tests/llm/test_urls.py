import itertools
import math
import random
import re
from collections import Counter

from quillspark.llm import queries, urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path, rules=urls.RULES):
    fit = [(len(t), t, s) for t, s in rules for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


class Plain:
    """Counts, segmentation by trying all last words of each prefix, and tokens, without the module's."""

    def __init__(self, rows):
        self.n = Counter()
        for r in rows:
            text = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>", " ", (r.html or "").lower())
            self.n.update(re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", text)))
        self.total = sum(self.n.values()) + 1
        self.seen = {}

    def split(self, word):
        if word not in self.seen:
            best = [(0.0, [])]
            for j in range(1, len(word) + 1):
                options = [(best[i][0] + math.log(self.n[word[i:j]] / self.total), -i, [*best[i][1], word[i:j]]) for i in range(j) if word[i:j] in self.n]
                options.append((best[j - 1][0] + math.log(1 / self.total) - math.log(10), 1 - j, [*best[j - 1][1], word[j - 1]]))
                best.append(max(options, key=lambda x: (x[0], -x[1]))[::2])
            self.seen[word] = best[-1][1]
        return self.seen[word]

    def tokens(self, host, path):
        out = []
        for side, text in (("h", host), ("p", path)):
            for word in re.findall(r"[^\W\d_]+|\d+", text.lower()):
                out += [f"{side}:#{len(word)}"] if word.isdigit() else [f"{side}:{w}" for w in self.split(word)]
        return out


def check(rows, out):
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in out], key=str) == sorted([(i, *parts(u), rule(*parts(u))[0]) for i, u in rows], key=str)
    for r in out:
        assert r.verdict == (rule(r.host, r.path)[1] or ("block" if r.score > 0 else "allow"))


def test_query_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()]
    out = queries.op7_url_filter(spark, sf_dir).collect()
    check(rows, out)
    # The model scores by counts over all pages that rules decide; words, tokens and segmentation are made anew here.
    segmenter = Plain(pages.select("html").collect())
    taught = {"block": {}, "allow": {}}
    n = {"block": 0, "allow": 0}
    for r in out:
        if r.rule:
            n[r.verdict] += 1
            for t in segmenter.tokens(r.host, r.path):
                taught[r.verdict][t] = taught[r.verdict].get(t, 0) + 1
    size = len(set(taught["block"]) | set(taught["allow"])) + 1
    for r in out:
        score = math.log((n["block"] + 1) / (n["allow"] + 1))
        for t in segmenter.tokens(r.host, r.path):
            score += math.log((taught["block"].get(t, 0) + 1) / (sum(taught["block"].values()) + size)) - math.log((taught["allow"].get(t, 0) + 1) / (sum(taught["allow"].values()) + size))
        assert abs(score - r.score) < 1e-9


def test_edge_cases(spark):
    rows = list(enumerate([None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/7x?q#f", "x://example.net/de/8", "x://de.net/de/9", "x://net/", "x://b.net/de/", "x://com?a/en/", "x://com/en/#", "x://o.org/es", "x://o.org/es/y\nz", "a://b://c/d", "x://notcom/en/", "x://" + "th" * 20000 + ".net/de/"]))
    df = spark.createDataFrame([(i, u, "<p>the net</p>" if i % 2 else None, "z") for i, u in rows], "page_id long, url string, html string, host string")
    check(rows, urls.judge(df).collect())
    assert urls.judge(df.limit(0)).collect() == []
    unruled = df.where("page_id < 4")
    assert {r.verdict for r in urls.judge(unruled).collect()} == {"allow"}


def test_segmenter_equals_brute_force():
    s = urls.Segmenter({"a": 5, "ab": 9, "abc": 2, "c": 4, "bc": 7, "cab": 3})
    cost = lambda w: s.score.get(w, s.unknown - math.log(10) if len(w) == 1 else -math.inf)
    for n in range(1, 7):
        for name in map("".join, itertools.product("abc", repeat=n)):
            best = max(sum(cost(name[i:j]) for i, j in itertools.pairwise([0, *cuts, n])) for k in range(n) for cuts in itertools.combinations(range(1, n), k))
            assert abs(sum(map(cost, s.split(name))) - best) < 1e-9 and "".join(s.split(name)) == name


def word_counts(pages):
    return {r["w"]: r["n"] for r in urls.counted(pages).collect()}


def test_very_long_words(spark):
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(300)]
    big = "".join(rng.choices(alphabet, k=70))
    long = ["".join(rng.choices(vocabulary, k=6000)), big * 3, big + "x" * 2000, "e" * 300_000, "".join(rng.choices(alphabet, k=1_000_000))]
    html = " ".join([*vocabulary, big, big, big + "x" * 500, big + "y" * 500, big[:64], big[:65]])
    rows = [(i, f"x://{w}.net/{'de' if i % 2 else 'fr'}/{w}", html if i == 0 else None) for i, w in enumerate(long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.word: tuple(r.pieces) for r in urls.segmented(pages, spark.createDataFrame([(w,) for w in long], "word string")).collect()}
    segmenter = urls.Segmenter(word_counts(pages))
    assert all(out[w] == segmenter._split(w) for w in long)
    assert out[long[1]] == (big,) * 3 and big + "x" * 500 in out[long[2]]
    check([r[:2] for r in rows], urls.judge(pages).collect())


def test_frequent_words_meet_the_same_weights(spark, monkeypatch):
    rows = [(i, f"x://www.site{letters(i % 40)}.{'net' if i % 3 else 'org'}/{'de' if i % 2 else 'es'}/{letters(i)}", "the site net de") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, urls.judge(pages).collect()))
    monkeypatch.setattr(urls, "HOT", 0)  # no word is frequent
    monkeypatch.setattr(urls, "SALT", 1)
    assert sorted(map(tuple, urls.judge(pages).collect())) == got


def letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_no_count_is_cut(spark):
    # 60,000 words, of which the last is the rarest, and one of more than 20 letters.
    often, long = [letters(i) for i in range(60_000)], "zyxwvutsrqponmlkjihgfedcba"
    rare = often[-1]
    pages = spark.createDataFrame([(1, f"x://{rare}{long}.net/de/", " ".join([*often, *often[:-1], long]))], "page_id long, url string, html string")
    counts = word_counts(pages)
    assert len(counts) == 60_001 and counts[rare] == counts[long] == 1
    [cut] = urls.segmented(pages, spark.createDataFrame([(f"{rare}{long}",)], "word string")).collect()
    assert cut.pieces == [rare, long] == list(urls.Segmenter(counts).split(f"{rare}{long}"))
    [row] = urls.judge(pages).collect()
    assert row.words.split()[:2] == [rare, long]


def test_all_tokens_are_weighed(spark):
    ids = [letters(i) for i in range(60_000)]
    pages = spark.createDataFrame([(1, "x://net/de/" + "/".join(ids), " ".join(ids)), (2, f"x://other.org/{ids[-1]}", None)], "page_id long, url string, html string")
    score = {r.page_id: r.score for r in urls.judge(pages).collect()}
    segmenter = urls.Segmenter(word_counts(pages))
    taught = Counter(urls.tokens("net", "/de/" + "/".join(ids), segmenter))
    size, want = len(taught) + 1, math.log(1 / 2)
    for t in urls.tokens("other.org", f"/{ids[-1]}", segmenter):
        want += math.log(1 / size) - math.log((taught[t] + 1) / (sum(taught.values()) + size))
    assert size > 50_001 and abs(score[2] - want) < 1e-9
