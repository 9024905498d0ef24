"""Identifiers, types and small derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import WS, strip


def _first(pattern: str, c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def image_id(file_upload: Column, image: Column) -> Column:
    """The first id in the upload's name, else in the image's; upper case."""
    return F.upper(F.coalesce(_first("(?i)(H[0-9]+_[0-9]+)", file_upload), _first("(?i)(H[0-9]+_[0-9]+)", image)))


def house_id(image_id: Column) -> Column:
    return F.coalesce(F.upper(_first("(?i)(H[0-9]+)", image_id)), F.lit(""))


def house_from_folder(name: Column) -> Column:
    n = F.try_to_number(_first("([0-9]+)", name), F.lit("9" * 18)).cast("long")
    return F.when(n.isNotNull(), F.format_string("H%02d", n))


def house_from_prefix(image_id: Column) -> Column:
    return F.split_part(F.coalesce(image_id, F.lit("")), F.lit("_"), F.lit(1))


def first_present(*candidates: Column) -> Column:
    """The first that is not blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in candidates])


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def canon_type(raw: Column) -> Column:
    """One of the known types: as it stands, else with case, hyphens and spaces evened out; null if unknown."""
    known = {t: t for t in vocab.GROUPS} | vocab.TYPE_ALIASES
    exact = strip(raw)
    return F.coalesce(_lookup(known, exact), _lookup(known, F.translate(F.lower(exact), "- ", "__")))


def group_of(qa_type: Column) -> Column:
    return _lookup(vocab.GROUPS, qa_type)


def basename(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), "[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")), "(?<=.)\\.[^.]*$", "")


def image_file(house: Column, image: Column) -> Column:
    return F.concat(house, F.lit("/"), image, F.lit(".jpg"))


def flat_image_file(path: Column, extension: str = ".jpg") -> Column:
    return F.concat(stem(path), F.lit(extension))


def slot_id(image: Column, kind: str, slot: Column) -> Column:
    return F.concat(image, F.lit(f"_{kind}"), slot.cast("string"))


def sequence_id(house: Column, n: Column) -> Column:
    return F.format_string("%s_%04d", house, n)


def orientation(w: Column, h: Column) -> Column:
    """At ingest: portrait unless wider than high."""
    return F.when(h >= w, "portrait").otherwise("landscape")


def orientation3(w: Column, h: Column) -> Column:
    """In statistics: with squares; unknown sides count as 0."""
    w, h = F.coalesce(w, F.lit(0)), F.coalesce(h, F.lit(0))
    return F.when(h > w, "portrait").when(w > h, "landscape").otherwise("square")


def as_int(c: Column) -> Column:
    """Truncated toward zero; null where no number is."""
    return c.cast("string").try_cast("double").try_cast("int")


def size_label(w: Column, h: Column) -> Column:
    return F.concat_ws("x", *[F.coalesce(x.cast("string"), F.lit("None")) for x in (w, h)])


def half_up(x: Column, digits: int) -> Column:
    """Rounds non-negative values by one floating-point step that all engines share."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def token_budget(group: Column, qa_type: Column, a: int = vocab.GROUP_A_TOKENS, b: int = vocab.GROUP_B_TOKENS) -> Column:
    long_types = [t for t, g in vocab.GROUPS.items() if g == "B"]
    return F.when((F.coalesce(group, F.lit("")) == "B") | F.coalesce(qa_type, F.lit("")).isin(long_types), b).otherwise(a)


def model_tag(path: Column) -> Column:
    base = F.lower(basename(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")))
    return F.coalesce(_lookup(vocab.MODEL_TAGS, path), F.regexp_replace(base, "[^\\p{L}\\p{N}\\-_.]", "-"))


def prompt(instruction: str, question: Column) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n"), question)


def truncate(c: Column, width: int = 60) -> Column:
    one = F.regexp_replace(c.cast("string"), "\n", " ")
    return F.when(F.length(one) > width, F.concat(F.left(one, F.lit(width)), F.lit(" ..."))).otherwise(one)


def problem_kind(problem: Column) -> Column:
    return F.regexp_extract(problem, "^[^:=(]*", 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), 0)
