import random
import re

from quillspark.llm import licenses, queries


def words(t):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(t):
    w, at, labels = words(t), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def parsed(template):
    """Words, numbers of free words, and lists for regions that may be missing."""
    out = [[]]
    for p in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if p == "[[":
            out.append([])
        elif p == "]]":
            region = out.pop()
            out[-1].append(region)
        else:
            out[-1].append(int(p[2:-2]) if p.startswith("{{") else p)
    return out[0]


def ends(parts, w, at):
    for p in parts:
        if isinstance(p, list):
            at = at | ends(p, w, at)
        elif isinstance(p, int):
            at = {i + j for i in at for j in range(p + 1) if i + j <= len(w)}
        else:
            at = {i + 1 for i in at if i < len(w) and w[i] == p}
        if not at:
            break
    return at


def whole(t):
    """Labels and score by trying every template at every word."""
    w, labels, covered = words(t), set(), set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                labels.add(label)
                covered.update(range(i, i + len(p)))
    for label, template, _ in licenses.TEMPLATES:
        parts, i = parsed(template), 0
        while i < len(w):
            end = max(ends(parts, w, {i}), default=i)
            if end > i:
                labels.add(label)
                covered.update(range(i, end))
            i = max(end, i + 1)
    return ",".join(sorted(labels)), len(covered) / len(w) if covered else 0.0


def check(rows, out, by_id=True):
    if by_id:
        want = {d: whole(t) for d, t in rows}
        assert {r.doc_id: (r.labels, round(r.score, 9)) for r in out} == {d: (labels, round(score, 9)) for d, (labels, score) in want.items()}
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out], key=str)
    assert got == sorted([(d, *base(t)) for d, t in rows], key=str)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op9_license_scan(spark, sf_dir).collect())


def test_edge_cases(spark):
    r = random.Random(2)
    bits = ["nc", "mit", "under", "the", "salicense", "xmit", "apache", "Copyright", "cc", "by", "CC-BY", "all", "rights", "Reserved.", "general", "public", "license", "é", "gnu", "cc by cc by", " ", "xcc", "bye"]
    rows = [(None, None), (1, ""), (2, "cc"), (3, "by the way"), (4, "ccé by"), (5, "cc\nby" * 3000)]
    rows += [(10 + i, r.choice([" ", "-", "\n", "_"]).join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(300)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, labels string").coalesce(1)
    check(rows, licenses.scan(df).collect())
    assert licenses.scan(df.limit(0)).collect() == []


def test_templates(spark):
    texts = {
        1: ("Released under the MIT License.", "mit"),
        2: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        3: ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        4: ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        5: ("Copyright (c) 2020 Some One, All Rights Reserved", "copyright,reserved"),
        6: ("Copyright one two three four five six seven eight nine ten all rights reserved", "reserved"),
        7: ("under the mitt license", ""),
        8: ("Permission is granted, free of charge", ""),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {k: v for k, (_, v) in texts.items()}


def test_openings_are_no_licences(spark):
    plain = lambda t, who: re.sub(r"\[\[|\]\]", "", t).replace("{{12}}", who)
    mit, bsd = plain(licenses.MIT, ""), plain(licenses.BSD, "the copyright holders")
    two = re.sub(r"(?s)3 neither.*?written\s+permission", "", bsd)
    assert two != bsd
    texts = [(mit, "mit,mit-opening"), (bsd, "bsd,bsd-opening"), (two, "bsd,bsd-opening")]
    for t, opening in ((mit, "mit-opening"), (bsd, "bsd-opening"), (two, "bsd-opening")):
        w = t.split()
        texts += [(" ".join(w[:-1]), opening), (" ".join([*w[:40], "never", *w[40:]]), opening)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {k: v for k, (_, v) in enumerate(texts)}


def expand(template):
    """Every wording of a small template."""
    parts = re.findall(r"\[\[[^\[\]]*\]\]|\{\{\d+\}\}|\S+", template)
    out = [[]]
    for p in parts:
        if p.startswith("[["):
            out = [o + x for o in out for x in ([], p[2:-2].split())]
        elif p.startswith("{{"):
            out = [o + ["*"] * k for o in out for k in range(int(p[2:-2]) + 1)]
        else:
            out = [[*o, p] for o in out]
    return out


def test_automaton_equals_expansion():
    r = random.Random(4)
    for template in ("a [[b c]] {{2}} d", "[[a]] [[b]] c", "a {{1}} {{1}} [[b]] a", "{{2}} a"):
        wordings = expand(template)
        automaton = licenses.Automaton(template)
        for _ in range(300):
            w = [r.choice("abcd") for _ in range(r.randint(0, 8))]
            want = max((len(x) for x in wordings if len(x) <= len(w) and all(p in ("*", q) for p, q in zip(x, w))), default=0)
            assert automaton.longest([x.encode() for x in w], 0) == want
