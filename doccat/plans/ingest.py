"""From files on storage to catalogue and index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.config import Settings
from doccat.functions import paths as P
from doccat.functions.metadata import checksum
from doccat.operators.metadata import import_documents
from doccat.operators.sync import known_rows, live


def with_ids(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return files.withColumn("id", P.file_id(F.col("path"), settings))


def with_checksums(files: DataFrame) -> DataFrame:
    return files.withColumn("checksum", checksum(F.col("content")))


def pending(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that are new to the catalogue or differ from it, with all their columns.

    One left join on id decides both; unchanged files go no further.
    """
    known = known_rows(live(catalog), files).select("id", F.col("checksum").alias("_known"), F.lit(True).alias("_seen"))
    joined = files.join(known, "id", "left")
    changed = F.col("_known").isNotNull() & (F.col("checksum").isNull() | (F.col("checksum") != F.col("_known")))
    return joined.where(F.col("_seen").isNull() | changed).drop("_known", "_seen")


def import_pending(files: DataFrame, catalog: DataFrame, extractor: Callable[[Column], Column] | None = None,
                   as_of: Column | None = None, origin: str | None = None,
                   settings: Settings = Settings()) -> DataFrame:
    """Import what ``pending`` lets through; rows of ``path, content, extracted, supplied``."""
    todo = pending(with_checksums(with_ids(files, settings)), catalog).drop("id", "checksum")
    return import_documents(todo, extractor, as_of, origin, settings)
