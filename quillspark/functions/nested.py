"""Records of unknown layout: containers, fields under several names, and the four layouts of question-answer pairs.

JSON objects are read as ordered maps from key to raw JSON text, since the order of keys decides slots and the first match.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from .scalars import canon_type
from .text import strip

_MAP = "map<string,string>"


def kind(raw: Column) -> Column:
    """Of raw JSON values in a map<string,string>: 'object', 'array' or 'scalar'."""
    head = F.left(F.ltrim(raw), F.lit(1))
    return F.when(head == "{", "object").when(head == "[", "array").otherwise("scalar")


def objects(raw: Column) -> Column:
    """Elements of a JSON array that begins with an object, else null."""
    return F.when(raw.rlike(r"^\s*\[\s*\{"), F.from_json(raw, "array<string>"))


def present(record: Column, keys: list[str]) -> Column:
    """The first of ``keys`` with a scalar that is not blank, stripped."""

    def scalar(k):
        v = F.try_element_at(record, k)
        return strip(F.when(~v.rlike(r"^\s*[\[{]"), v))

    return F.get(F.filter(F.transform(F.array(*map(F.lit, keys)), scalar), lambda v: v != ""), F.lit(0))


def containers(raw: DataFrame) -> DataFrame:
    """Records (pos, record as raw JSON, container) of rows of (json): the list itself, the first known key that holds
    a list of objects, or the first key that does."""
    m = F.from_json("json", _MAP)
    entries = F.map_entries(m)
    auto = F.get(F.filter(entries, lambda e: e["value"].rlike(r"^\s*\[\s*\{")), F.lit(0))
    known = F.coalesce(*[F.when(objects(F.try_element_at(F.col("m"), F.lit(k))).isNotNull(), F.lit(k)) for k in vocab.RECORD_KEYS])
    top = raw.withColumn("m", F.when(F.ltrim("json").startswith("{"), m)).withColumn("auto", F.when(F.col("m").isNotNull(), auto))
    named = top.select(
        F.when(F.col("m").isNull(), F.lit("top-level list")).when(known.isNotNull(), known).otherwise(F.concat(F.col("auto.key"), F.lit(" (auto-detected)"))).alias("container"),
        F.when(F.col("m").isNull(), F.from_json("json", "array<string>")).when(known.isNotNull(), F.from_json(F.try_element_at("m", known), "array<string>")).otherwise(F.from_json("auto.value", "array<string>")).alias("x"),
    )
    return named.select("container", F.posexplode("x").alias("pos", "record"))


_QA = "array<struct<qa_id:string,qa_type:string,question:string,gold:string>>"


def _bound(value: Column, body) -> Column:
    """``body`` over ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(fields: Column, slot: Column, image: Column, raw_type: Column) -> Column:
    return F.struct(
        F.coalesce(present(fields, vocab.QA_ID_KEYS), F.concat(image, F.lit("_q"), slot.cast("string"))).alias("qa_id"),
        _bound(raw_type, canon_type).alias("qa_type"),
        F.coalesce(present(fields, vocab.QUESTION_KEYS), F.lit("")).alias("question"),
        F.coalesce(present(fields, vocab.ANSWER_KEYS), F.lit("")).alias("gold"),
    )


def _known(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["qa_type"].isNotNull())


def _first_nonempty(lists: Column) -> Column:
    return F.get(F.filter(lists, lambda p: F.size(p) > 0), F.lit(0))


def question_answers(records: DataFrame) -> DataFrame:
    """Adds ``layout`` and ``qas`` to rows of (image_id, record as raw JSON): the first layout that gives a pair decides.

    Slots count all entries, also of unknown types, which are dropped afterwards."""
    r = records.withColumn("_m", F.from_json("record", _MAP))
    m, image = F.col("_m"), F.col("image_id")

    def under(pattern, pairs):
        """The pairs under the first key whose value looks like ``pattern`` and gives any."""
        keys = F.filter(F.array(*map(F.lit, vocab.QA_KEYS)), lambda k: F.coalesce(F.try_element_at(m, k).rlike(pattern), F.lit(False)))
        return _first_nonempty(F.transform(keys, lambda k: _known(pairs(F.try_element_at(m, k)))))

    def of_list(v):
        return F.transform(F.from_json(v, "array<string>"), lambda x, i: _bound(F.from_json(x, _MAP), lambda f: _pair(f, i + 1, image, present(f, vocab.TYPE_KEYS))))

    def of_dict(v):
        entries = F.map_entries(F.from_json(v, _MAP))
        each = F.transform(entries, lambda e, i: F.when(e["value"].rlike(r"^\s*\{"), _bound(F.from_json(e["value"], _MAP), lambda f: _pair(f, i + 1, image, e["key"]))))
        return F.filter(each, lambda p: p.isNotNull())

    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(vocab.TYPE_ALIASES.get(n, n)).alias("type")) for n in [*vocab.GROUPS, *vocab.TYPE_ALIASES]])
    has = lambda k: F.array_contains(F.map_keys(m), k)
    field = lambda k: F.coalesce(F.try_element_at(m, k), F.lit(""))
    of = lambda side, n: F.concat(F.lit(f"{side}_"), n["name"])
    there = F.filter(names, lambda n: has(of("q", n)) | has(of("a", n)))
    own = lambda n: F.nullif(F.try_element_at(m, F.concat(n["type"], F.lit("_qa_id"))), F.lit(""))
    flat = F.transform(there, lambda n, i: F.struct(F.coalesce(own(n), F.concat(image, F.lit("_q"), (i + 1).cast("string"))).alias("qa_id"), n["type"].alias("qa_type"), field(of("q", n)).alias("question"), field(of("a", n)).alias("gold")))
    single = _known(F.array(_pair(m, F.lit(1), image, present(m, vocab.TYPE_KEYS))))
    options = [("list", under(r"^\s*\[\s*\{", of_list)), ("dict", under(r"^\s*\{", of_dict)), ("flat", _first_nonempty(F.array(flat))), ("single", _first_nonempty(F.array(single)))]
    # A layout is looked at only if none before it gave a pair.
    tried = r
    for i, (name, pairs) in enumerate(options):
        before = [F.col(f"_{n}").isNull() for n, _ in options[:i]]
        still = functools.reduce(lambda a, b: a & b, before, F.lit(True))
        tried = tried.withColumn(f"_{name}", F.when(still, pairs.cast(_QA)))
    layout = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in options], F.lit("none"))
    qas = F.coalesce(*[F.col(f"_{n}") for n, _ in options], F.array().cast(_QA))
    return tried.select(*[F.col(f"`{c}`") for c in records.columns], layout.alias("layout"), qas.alias("qas"))


def schema_of(records: DataFrame) -> DataFrame:
    """How often each key of the records (raw JSON) occurs, and the kinds of its values."""
    e = records.select(F.explode(F.map_entries(F.from_json("record", _MAP))).alias("e"))
    return e.groupBy(F.col("e.key").alias("key"), kind(F.col("e.value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("e.value").alias("example"))
