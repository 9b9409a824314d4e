"""Column expressions that derive catalogue fields from a path and a property bag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.config import (
    BOILERPLATE_TITLES,
    CREATION_DATE_KEYS,
    ERROR_CODES,
    KEPT_CODES,
    LEADING_DATE_PATTERN,
    REPLACED_CODES,
    Settings,
)
from doccat.functions.paths import basename, extension, parent_name, stem
from doccat.functions.props import first, first_of
from doccat.functions.text import trim_space


def checksum(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def boilerplate_title(title: Column) -> Column:
    """Missing, empty, or one of the titles programs put in by themselves."""
    return F.coalesce(title == "", F.lit(True)) | F.lower(trim_space(title)).isin(*BOILERPLATE_TITLES)


def resolve_title(title: Column, path: Column) -> Column:
    return F.when(boilerplate_title(title), stem(path)).otherwise(title)


def person_match(path: Column, settings: Settings = Settings()) -> Column:
    """The leftmost ``Last_First_dd.mm.yyyy`` anywhere in the path, else null."""
    return F.nullif(F.regexp_extract(path, settings.concern_pattern, 0), F.lit(""))


def concern(path: Column, given: Column | None = None, settings: Settings = Settings()) -> Column:
    """Given concern, else the person in the path, else the folder name."""
    derived = F.coalesce(person_match(path, settings), parent_name(path))
    return derived if given is None else F.coalesce(F.nullif(given, F.lit("")), derived)


def person_field(match: Column, position: int, settings: Settings = Settings()) -> Column:
    """One capture of the concern pattern; a capture holding dd.mm.yyyy becomes yyyyMMdd."""
    part = F.nullif(F.regexp_extract(match, settings.concern_pattern, position), F.lit(""))
    as_date = F.date_format(F.try_to_timestamp(part, F.lit("dd.MM.yyyy")), "yyyyMMdd")
    return F.when(part.rlike(r"\d\d\.\d\d\.\d\d\d\d"), as_date).otherwise(part)


def has_leading_date(path: Column) -> Column:
    return basename(path).rlike(LEADING_DATE_PATTERN)


def leading_date(path: Column) -> Column:
    """yyyy-MM-dd from the front of the file name; null if it is no real date."""
    text = F.regexp_replace(basename(path), LEADING_DATE_PATTERN, "$1-$2-$3")
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def document_date(props: Column, path: Column) -> Column:
    """Given date, else the one in front of the file name, else the first creation date property."""
    found = first_of(props, CREATION_DATE_KEYS)
    return F.coalesce(first(props, "date"), F.when(has_leading_date(path), leading_date(path)).otherwise(found))


def version_name(path: Column, on: Column) -> Column:
    """Archive name ``concern_base_Y-M-D.ext``, month and day without leading zeros."""
    day = F.concat_ws("-", F.year(on), F.month(on), F.dayofmonth(on))
    return F.concat(F.concat_ws("_", parent_name(path), stem(path), day), extension(path))


def ocr_outcome(code: Column) -> Column:
    return (
        F.when(code.isin(*REPLACED_CODES), "replaced")
        .when(code.isin(*KEPT_CODES), "kept")
        .otherwise("error")
    )


def ocr_known(code: Column) -> Column:
    return code.isin(*REPLACED_CODES, *KEPT_CODES, *ERROR_CODES)
