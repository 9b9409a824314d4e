"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.config import IMAGE_SUFFIXES, Settings


def strip_scheme(path: Column) -> Column:
    """Drop ``file://``; Spark writes local paths as ``file:/x``, so that goes too."""
    return F.regexp_replace(path, r"\Afile:(//|(?=/))", "")


def below_root(path: Column, settings: Settings = Settings()) -> Column:
    """The path without scheme and document root; keeps the leading slash."""
    return _cut_root(strip_scheme(path), settings, "/") if settings.base else strip_scheme(path)


def file_id(path: Column, settings: Settings = Settings()) -> Column:
    return F.md5(below_root(path, settings).cast("binary"))


def location(path: Column, settings: Settings = Settings()) -> Column:
    """Path relative to the root, without leading slash; foreign paths stay whole."""
    return _cut_root(path, settings, "")


def _cut_root(path: Column, settings: Settings, put: str) -> Column:
    return F.regexp_replace(path, rf"\A\Q{settings.base}\E/", put)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    parent = F.regexp_replace(path, r"/[^/]*\z", "")
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(parent == "", F.lit("/")).otherwise(parent)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("."))


def extension(path: Column) -> Column:
    """Last dot and what follows; a leading dot is part of the name."""
    return F.regexp_extract(basename(path), r"(?s).(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?s)(.)\.[^.]*\z", "$1")


def visible(path: Column) -> Column:
    """No component of the path starts with a dot."""
    return ~path.rlike(r"(^|/)\.")


def visible_name(path: Column) -> Column:
    """The file's own name does not start with a dot."""
    return ~basename(path).startswith(".")


def needs_conversion(path: Column) -> Column:
    """Image files by the end of their name; a dot is not asked for."""
    lowered = F.lower(path)
    found = lowered.endswith(IMAGE_SUFFIXES[0])
    for suffix in IMAGE_SUFFIXES[1:]:
        found = found | lowered.endswith(suffix)
    return found


def matches_any(name: Column, patterns: str) -> Column:
    """True if any of the ``|``-separated regexes is found in the name."""
    found = F.lit(False)
    for pattern in patterns.split("|"):
        found = found | name.rlike(pattern)
    return found
