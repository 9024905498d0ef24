import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars, text

ACHAR = "আলমারি"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(2)
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_scoring_cleaner_examples(spark):
    cases = [
        (ACHAR + "।", ACHAR),
        ("  " + ACHAR + "   আছে  ।", ACHAR + " আছে"),
        ("Fridge.", "fridge"),
        ("3টি", "৩টি"),
        ("ক\u200cখ", "কখ"),
        ("র্\u200dয", "র্\u200dয"),
        (ACHAR + "\u200b", ACHAR),
        (None, ""),
        ("a . .", "a"),
        ("১॥|”", "১"),
    ]
    assert column(spark, [a for a, _ in cases], text.clean_for_scoring) == [b for _, b in cases]


def test_matches(spark):
    rows = [("এটি একটি " + ACHAR + "।", ACHAR), (ACHAR + "।", ACHAR), ("", ACHAR), (ACHAR, ""), (None, ACHAR)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, r string")
    p, r = text.clean_for_scoring(F.col("p")), text.clean_for_scoring(F.col("r"))
    got = [(x.s, x.l) for x in df.select("i", text.strict_match(p, r).alias("s"), text.relaxed_match(p, r).alias("l")).orderBy("i").collect()]
    assert got == [(False, True), (True, True), (False, False), (False, False), (False, False)]
    assert all(loose for strict, loose in got if strict)


def py_score(t):
    t = unicodedata.normalize("NFC", t)
    t = re.sub("(?<!্)[\u200c\u200d]", "", t)
    t = re.sub(r"\s+", " ", t.replace("\u200b", " ").replace("\ufeff", " ")).strip()
    return t.rstrip(text.TERMINAL + " \t").lower().translate(str.maketrans("0123456789", text.BANGLA_DIGITS))


def py_store(t):
    for c in "\u200b\ufeff\u00a0":
        t = t.replace(c, "")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", re.sub("(?<!্)[\u200c\u200d]", "", t))).strip()


@pytest.mark.parametrize("f,g", [(text.clean_for_scoring, py_score), (text.clean_for_storage, py_store), (text.strip, str.strip), (text.word_count, lambda t: len(t.split()))])
def test_against_python_on_random_text(spark, f, g):
    r = random.Random(8)
    spaces = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000)]
    alphabet = spaces + list("\u200b\ufeff\u200c\u200d়্যয়কা।॥.!?,;:…|\"'’”éAZb09৬é")
    values = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    assert column(spark, values, f) == [g(v) for v in values]


def test_audit_counts(spark):
    df = spark.createDataFrame([("a\u200b\u200bb\ufeff",), ("ক\u200c্\u200d\u200c",), ("é\u00a0 x ",), ("",), (None,), ("plain",)], "t string")
    out = text.storage_audit(df, "t").first().asDict()
    assert out == {"fields_seen": 4, "stripped_invisible": 3, "fields_with_inert_joiner": 1, "inert_joiners_removed": 2, "functional_joiners_kept": 1, "nfc_changed": 1, "whitespace_changed": 1, "fields_changed": 3}


def test_scalars(spark):
    df = spark.createDataFrame([("x/h12_0007.PNG", None, "Flat 7b", "12.9", "-3.9", "nan", "a\\b/c.tar.gz", "..", " Obj-Hazard")], "u string, m string, f string, a string, b string, c string, p string, q string, t string")
    s = scalars
    got = df.select(
        s.image_id(F.col("m"), F.col("u")).alias("id"), s.house_from_folder(F.col("f")).alias("h"), s.house_from_folder(F.lit("none")).alias("h0"), s.house_from_folder(F.lit("House 123")).alias("h3"), s.as_int(F.col("a")).alias("a"), s.as_int(F.col("b")).alias("b"), s.as_int(F.lit("x")).alias("x"),
        s.stem(F.col("p")).alias("stem"), s.canon_type(F.col("t")).alias("type"), s.canon_type(F.lit("nope")).alias("none"), s.first_present(F.lit(None).cast("string"), F.lit("  "), F.lit(" k ")).alias("first"), s.house_from_prefix(F.lit("H01_0002")).alias("prefix"),
        s.model_tag(F.lit("google/gemma-3-4b-it")).alias("known"), s.model_tag(F.lit("/m/Some Model:7B/")).alias("tag"), s.problem_kind(F.lit("qa_count=2(expected 5)")).alias("kind"),
    ).first()
    assert tuple(got) == ("H12_0007", "H07", None, "H123", 12, -3, None, "c.tar", "obj_property", None, "k", "H01", "gemma3-4b", "some-model-7b", "qa_count")
