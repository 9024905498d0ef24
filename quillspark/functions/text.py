"""Text cleaning and matching as Column functions.

Only Unicode composition needs Python (Spark has no NFC function); it runs in Arrow batches and leaves plain text
untouched. White space is the explicit set of 29 code points that Python's ``\\s`` means, in every engine.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character sets.
WS = "\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
HASANT, ZWNJ, ZWJ, ZWSP, BOM, NBSP, DAARI = "্", "\u200c", "\u200d", "\u200b", "\ufeff", "\u00a0", "।"
TERMINAL = "।॥.!?,;:…|\"'‘’“”"
BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"


@functools.lru_cache(None)
def _nfc_udf():
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))

    return F.pandas_udf(nfc, T.StringType())


def to_nfc(c: Column) -> Column:
    """Characters below U+0300 never change, so texts without any other are not sent to Python."""
    return F.coalesce(_nfc_udf()(F.when(c.rlike("[^\\x{00}-\\x{2ff}]"), c)), c)


@functools.lru_cache(None)
def _nfc_each_udf():
    def each(x: pa.Array) -> pa.Array:
        texts = x.values.dictionary_encode()
        composed = [s if s is None or s.isascii() else unicodedata.normalize("NFC", s) for s in texts.dictionary.to_pylist()]
        return pa.ListArray.from_arrays(x.offsets, pa.array(composed, pa.string()).take(texts.indices))

    return F.arrow_udf(each, T.ArrayType(T.StringType()))


def nfc(c: Column) -> Column:
    """NFC, with null as the empty string."""
    return F.coalesce(to_nfc(c), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def strip_inert_joiners(c: Column) -> Column:
    """Zero-width joiners go unless they follow a hasant."""
    return F.regexp_replace(c, "(?<!\\x{09cd})[\\x{200c}\\x{200d}]", "")


def collapse_whitespace(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "[\\x{200b}\\x{feff}]", " "))


def strip_terminal_punct(c: Column) -> Column:
    return F.rtrim(c, F.lit(TERMINAL + " \t"))


def lowercase_latin(c: Column) -> Column:
    return F.lower(c)


def ascii_digits_to_bangla(c: Column) -> Column:
    return F.translate(c, "0123456789", BANGLA_DIGITS)


def clean_for_scoring(c: Column) -> Column:
    """The cleaner of answers before they are compared; null becomes the empty string."""
    c = strip_inert_joiners(nfc(c.cast("string")))
    return ascii_digits_to_bangla(lowercase_latin(strip_terminal_punct(collapse_whitespace(c))))


def join_parts(parts: Column) -> Column:
    """Non-blank parts of a text area, joined by a space."""
    return F.coalesce(F.array_join(F.filter(parts, lambda x: strip(x) != ""), " "), F.lit(""))


def clean_for_storage(c: Column) -> Column:
    """The cleaner of stored text: invisible characters are deleted, where scoring makes them spaces."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x{200b}\\x{feff}\\x{a0}]", "")
    return squeeze(to_nfc(strip_inert_joiners(c)))


def clean_each_for_storage(texts: Column) -> Column:
    """``clean_for_storage`` of each text of an array that is not null; the array goes to Python at once, and each different text is composed once."""
    visible = F.transform(texts, lambda t: strip_inert_joiners(F.regexp_replace(F.coalesce(t, F.lit("")), "[\\x{200b}\\x{feff}\\x{a0}]", "")))
    return F.transform(_nfc_each_udf()(visible), squeeze)


def storage_audit(df: DataFrame, raw: str) -> DataFrame:
    """What ``clean_for_storage`` does to the texts of a column, as counters in one row; an empty field counts nothing. Each step is a projection of its
    own, so that no text is cleaned twice."""
    seen = df.where(F.col(raw) != "").select(F.col(raw).alias("raw"), F.regexp_replace(raw, "[\\x{200b}\\x{feff}\\x{a0}]", "").alias("visible"))
    joined = seen.select("*", strip_inert_joiners(F.col("visible")).alias("joined"))
    composed = joined.select("*", to_nfc(F.col("joined")).alias("composed"))
    done = composed.select("*", squeeze(F.col("composed")).alias("done"))
    inert = F.length("visible") - F.length("joined")
    counters = {
        "fields_seen": F.lit(1),
        "stripped_invisible": sum((F.contains("raw", F.lit(c)).cast("int") for c in (ZWSP, BOM, NBSP)), F.lit(0)),
        "fields_with_inert_joiner": (inert > 0).cast("int"),
        "inert_joiners_removed": inert,
        "functional_joiners_kept": F.regexp_count("visible", F.lit("(?<=\\x{09cd})[\\x{200c}\\x{200d}]")),
        "nfc_changed": (F.col("composed") != F.col("joined")).cast("int"),
        "whitespace_changed": (F.col("done") != F.col("composed")).cast("int"),
        "fields_changed": (F.col("done") != F.col("raw")).cast("int"),
    }
    return done.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(k) for k, v in counters.items()])


def strict_match(prediction: Column, reference: Column) -> Column:
    """Of two cleaned texts: equal, and not empty."""
    return (reference != "") & (prediction == reference)


def relaxed_match(prediction: Column, reference: Column) -> Column:
    """Of two cleaned texts: the reference is in the prediction, and not empty."""
    return (reference != "") & F.contains(prediction, reference)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WS}]+")), F.lit(0))


def flat(c: Column) -> Column:
    """For finding answers copied from their question."""
    return F.rtrim(strip(to_nfc(F.regexp_replace(c, f"[{WS}]+", " "))), F.lit("।?."))


def has_bangla(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[\\x{0980}-\\x{09ff}]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def has_ascii_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def digit_kind(c: Column) -> Column:
    """'ASCII' before 'Bangla'; null without any digit."""
    return F.when(c.rlike("[0-9]"), "ASCII").when(c.rlike(f"[{BANGLA_DIGITS}]"), "Bangla")


def lacks_daari(c: Column) -> Column:
    """A non-blank answer that does not end in a daari."""
    return (strip(c) != "") & ~F.endswith(strip(c), F.lit(DAARI))


def copied(answer: Column, question: Column) -> Column:
    return (strip(answer) != "") & (flat(answer) == flat(question))


def blank(question: Column, answer: Column) -> Column:
    return (strip(question) == "") | (strip(answer) == "")


def not_nfc(question: Column, answer: Column) -> Column:
    both = F.concat(question, answer)
    return to_nfc(both) != both


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
