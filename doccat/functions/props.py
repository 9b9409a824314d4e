"""Column expressions over extracted property bags, ``map<string, array<string>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.config import OCR_TEXT_THRESHOLD


def values(props: Column, key: str) -> Column:
    return F.try_element_at(props, F.lit(key))


def scalar(props: Column, key: str) -> Column:
    """The value under ``key`` if there is exactly one and it is not empty."""
    found = values(props, key)
    return F.when(F.size(found) == 1, F.nullif(F.get(found, 0), F.lit("")))


def first(props: Column, key: str) -> Column:
    """The first value under ``key`` that is not empty text."""
    return F.nullif(F.get(values(props, key), 0), F.lit(""))


def first_of(props: Column, keys: tuple[str, ...]) -> Column:
    """The first non-empty value under the first key that has one.

    A lookup per key inside a lambda keeps the generated code small enough to be compiled.
    """
    found = F.transform(F.array(*(F.lit(k) for k in keys)), lambda k: F.get(F.try_element_at(props, k), 0))
    return F.get(F.filter(found, lambda v: v.isNotNull() & (v != "")), 0)


def has_meta(props: Column, key: str, needle: str) -> Column:
    """Substring test on a single-valued property; null where there is none."""
    return F.coalesce(scalar(props, key), scalar(props, key.replace(":", "_", 1))).contains(needle)


def needs_ocr(props: Column) -> Column:
    """A PDF that no page of which has more than 100 characters of text."""
    counts = F.coalesce(
        *(
            F.when(~F.coalesce(found == F.array(F.lit("")), F.lit(False)), found)
            for found in (values(props, "pdf:charsPerPage"), values(props, "pdf_charsPerPage"))
        )
    )
    numbers = F.transform(counts, lambda x: F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("bigint"))
    return (
        F.coalesce(has_meta(props, "Content-Type", "pdf"), F.lit(False))
        & ~F.coalesce(has_meta(props, "xmp:CreatorTool", "ocrmypdf"), F.lit(False))
        & ~F.coalesce(F.array_max(numbers) > OCR_TEXT_THRESHOLD, F.lit(False))
    )


def normalize_keys(props: Column) -> Column:
    """Punctuation in keys (but ``-`` and ``.``) becomes ``_``; the first value that is not null stays."""
    entries = F.transform(
        F.map_entries(props),
        lambda e: F.struct(F.regexp_replace(e["key"], r"[^\w\-.]", "_").alias("key"), e["value"].alias("value")),
    )
    keys = F.array_distinct(entries["key"])
    pick = lambda k: F.get(F.filter(entries, lambda e: (e["key"] == k) & e["value"].isNotNull()), 0)["value"]
    return F.map_from_arrays(keys, F.transform(keys, pick))


def merge_props(extracted: Column, supplied: Column) -> Column:
    """Union of two bags; the supplied value wins."""
    extracted, supplied = _or_empty(extracted), _or_empty(supplied)
    kept = F.map_filter(extracted, lambda k, v: ~F.map_contains_key(supplied, k))
    return F.map_concat(kept, supplied)


def put_all(props: Column, new: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """Set single-valued properties and ``lists``, dropping what was under their keys; null values are left out."""
    lists = lists or {}
    keys = F.array(*(F.lit(k) for k in [*new, *lists]))
    kept = F.map_filter(_or_empty(props), lambda k, v: ~F.array_contains(keys, k))
    added = F.map_from_arrays(keys, F.array(*(F.array(v) for v in new.values()), *lists.values()))
    return F.map_concat(kept, F.map_filter(added, lambda k, v: F.get(v, 0).isNotNull()))


def drop(props: Column, *keys: str) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(*keys))


def _or_empty(props: Column) -> Column:
    return F.coalesce(props, F.create_map().cast("map<string,array<string>>"))
