"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules look at one text. The method adds rules of cutoffs on rates of the text (``SIGNALS``) for each stratum (language),
which labelled documents choose and certify. A hash of the doc_id deals the labelled documents that pass the base rules into two halves.

The one half chooses: of each signal, the cutoff that rejects most bad documents, less ``GOOD_WEIGHT`` for each good one, the mildest if equal; signals
without gain are left out. The others of a stratum, by gain, make a chain of rules: the first, the first two together, and so on.

The other half, the holdout, certifies: of its n good documents in the stratum, k are rejected by a rule; the rule is certified if the exact
binomial (Clopper-Pearson) upper bound of its false rejections is at most ``risk``, that is if P(Bin(n, risk) <= k) <= ``alpha`` / strata. The first rule of a chain
that fails ends it, so a chain counts as one test and takes the whole risk; across strata the level is divided by their number (Bonferroni).
The longest certified rule counts. With probability 1 - alpha, no stratum then loses more than ``risk`` of its good documents to it.
With risk and alpha of 0.05 and four strata, 86 good documents in the holdout, about 170 in all, are the fewest that can certify. Counts use all labelled rows.

Defined cases: a null text has no words; a null lang is the stratum ''; labels with null doc_id or quality are left out, and of
several labels of a doc_id the highest quality counts; rows that share a doc_id are judged each for itself; without
labels nothing is certified and the base rules decide. A very long text is one row's memory in one task. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, table, unused

SPACE = r"[\x20\x09-\x0D]+"
RISK, ALPHA, GOOD_WEIGHT = 0.05, 0.05, 5
#: Strata whose rules and cutoffs, some hundred bytes each, are broadcast; beyond, parts that each stratum's rows are dealt to.
BROADCAST, SALT = 10_000, 32
#: Signals in steps of a hundredth per word, line or character; high values are bad. Cutoffs run from STEPS down to 1.
STEPS = 100
SIGNALS = {
    "symbols": "least(100, 100 * n_symbols div greatest(n_words, 1))",
    "dup_lines": "100 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "100 * n_repeat_words div greatest(n_words, 1)",
    "capitals": "100 * n_upper div greatest(word_chars, 1)",
    "long_words": "least(100, 5 * word_chars div greatest(n_words, 1))",
}


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once, however often the body's loops look at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in runs of three that are found twice or more in the text: the runs are sorted with their places, and
    neighbours that are equal give the places whose union of three words each is counted."""
    n = F.size(words)
    runs = F.when(n < 3, F.array().cast("array<struct<g:string,p:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p")))
    )
    places = lambda z: F.sort_array(F.filter(F.transform(z, lambda x, i: F.when((x["g"] == F.get(z, i - 1)["g"]) | (x["g"] == F.get(z, i + 1)["g"]), x["p"])), lambda p: p.isNotNull()))
    covered = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda s, x: s + x)
    return let(F.sort_array(runs), lambda z: let(places(z), covered))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, th, stratum, n_words, the counts of the base rules, n_lines, n_upper, base_failed."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key().alias("th"),
        F.coalesce("lang", F.lit("")).alias("stratum"),
        F.array_remove(F.split(text, SPACE), "").alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    out = split.select(
        "doc_id",
        "th",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _lgamma(x: Column) -> Column:
    """Stirling's series from x + 8 on, which is exact to a double's last digits."""
    y = x + 8
    low = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) - low


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p, else 1 (such k are never certified). Terms from k downward shrink
    at least geometrically, and those beyond twelve standard deviations are below a double's precision."""
    top = F.exp(_lgamma(n + 1.0) - _lgamma(k + 1.0) - _lgamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(12 * F.sqrt(n)) + 50).cast("int"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, i: F.struct((a["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"]).alias("s"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * F.aggregate(steps, start, step, lambda a: a["s"])))


def per_stratum(df: DataFrame, few: DataFrame, strata: int) -> DataFrame:
    """``df`` with the columns of ``few``, which has a row for each of at most ``strata`` strata, or nulls. A stratum may have most of the rows: ``few`` is broadcast, or, if
    there are more than ``BROADCAST`` strata, dealt to ``SALT`` parts of each stratum."""
    if strata <= BROADCAST:
        return df.join(F.broadcast(few), "stratum", "left")
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).join(salted, ["stratum", "salt"], "left").drop("salt")


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """stratum and a map from signal to the cutoff that counts: documents with that value or more are rejected."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    names = F.array(*map(F.lit, SIGNALS))
    values = F.array(*[F.expr(v).cast("int") for v in SIGNALS.values()])
    seen = measured.where("not base_failed").join(best, "doc_id").select("stratum", (F.col("quality") >= 1).alias("good"), values.alias("values"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("held"))

    # The half that chooses.
    long = seen.where("not held").select("stratum", "good", F.explode(F.map_from_arrays(names, "values")).alias("signal", "value"))
    counts = long.groupBy("stratum", "signal", "value").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = counts.select("stratum", "signal").distinct().select("stratum", "signal", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("value"))
    from_high = Window.partitionBy("stratum", "signal").orderBy(F.desc("value"))
    beyond = grid.join(counts, ["stratum", "signal", "value"], "left").select("stratum", "signal", "value", F.sum(F.coalesce(F.col("bad") - GOOD_WEIGHT * F.col("good"), F.lit(0))).over(from_high).alias("gain"))
    chosen = beyond.where("gain > 0").groupBy("stratum", "signal").agg(F.max(F.struct("gain", "value")).alias("x"))
    # At most one rule for each signal.
    rules = chosen.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct((-F.col("x.gain")).alias("loss"), "signal", F.col("x.value").alias("cutoff")))).alias("rules"))

    # The half that certifies.
    strata = max(1, seen.select("stratum").distinct().count())
    # Equal documents are counted up before they meet the rules of their stratum.
    held = per_stratum(seen.where("held and good").groupBy("stratum", "values").agg(F.count(F.lit(1)).alias("m")), rules, strata).where("rules is not null")
    rejects = F.array_position(F.transform("rules", lambda x: F.element_at("values", F.array_position(names, x["signal"]).cast("int")) >= x["cutoff"]), True)
    first = held.groupBy("stratum", "rules", rejects.alias("first")).agg(F.sum("m").alias("n"))
    by = first.groupBy("stratum", "rules").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("at"))
    tried = by.select("stratum", "rules", "n", "at", F.posexplode("rules").alias("j", "rule"))
    rejected = F.aggregate(F.sequence(F.lit(1), F.col("j") + 1), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.col("at")[i.cast("long")], F.lit(0).cast("long")))
    sure = binomial_cdf(F.col("k"), F.col("n"), risk) <= alpha / strata
    tried = tried.withColumn("k", rejected).withColumn("sure", sure)
    passed = tried.withColumn("ok", F.min("sure").over(Window.partitionBy("stratum").orderBy("j"))).where("ok")
    return passed.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule.signal", "rule.cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The measures of every row of ``docs`` (text, lang), ``kept``, and ``rejected_by`` (signals)."""
    measured = table(measure(docs), "measures")
    cutoffs = table(thresholds(measured, labels, risk, alpha), "cutoffs")
    by = F.filter(F.array(*[F.when(F.expr(v) >= F.col("cutoffs")[k], F.lit(k)) for k, v in SIGNALS.items()]), lambda x: x.isNotNull())
    out = per_stratum(measured, cutoffs, cutoffs.count()).withColumn("rejected_by", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(by))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    doc, th, of, key, stratum = unused(docs, "of_doc", "of_text", "of_stratum", "text_key", "stratum")
    gone = judge(docs, labels).where("not kept").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("stratum").alias(of)).distinct()
    d = docs.withColumns({key: row_key(), stratum: F.coalesce("lang", F.lit(""))})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)) & (F.col(stratum) == F.col(of))
    return d.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
