"""Keeping the catalogue in step with the files: differences, upserts, removals, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions import metadata as M


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by ``order``.

    An aggregate, not a window: a hot key is reduced before the shuffle.
    """
    columns = df.columns
    picked = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(picked).select(*(F.col(f"_row.{c}").alias(c) for c in columns))


def live(catalog: DataFrame) -> DataFrame:
    """Without tombstones."""
    return catalog.where(F.col("deleted").isNull()) if "deleted" in catalog.columns else catalog


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(live(catalog).select("id"), "id", "left_anti")


def changed_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files known under another checksum; unreadable ones count as changed."""
    known = live(catalog).where(F.col("checksum").isNotNull()).select("id", F.col("checksum").alias("_known"))
    return (
        files.join(known, "id")
        .where(F.col("checksum").isNull() | (F.col("checksum") != F.col("_known")))
        .drop("_known")
    )


def deleted_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return live(catalog).join(files.select("id"), "id", "left_anti")


def sync_plan(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """``id, action`` for every file and every catalogue entry: add, update, keep or remove."""
    f = files.select("id", F.col("checksum").alias("file_checksum"), F.lit(True).alias("on_disk"))
    c = live(catalog).select("id", F.col("checksum").alias("known_checksum"), F.lit(True).alias("known"))
    on_disk, known = F.col("on_disk").isNotNull(), F.col("known").isNotNull()
    differs = F.col("file_checksum").isNull() | (F.col("file_checksum") != F.col("known_checksum"))
    action = (
        F.when(on_disk & ~known, "add")
        .when(~on_disk, "remove")
        .when(F.col("known_checksum").isNotNull() & differs, "update")
        .otherwise("keep")
    )
    return f.join(c, "id", "full_outer").select("id", action.alias("action"))


def settled_files(files: DataFrame, seconds: float = 1.0, as_of: Column | None = None) -> DataFrame:
    """Files not written to within the last ``seconds``."""
    return files.where(settled(seconds, as_of))


def settled(seconds: float = 1.0, as_of: Column | None = None) -> Column:
    moment = F.current_timestamp() if as_of is None else as_of
    return F.col("modification_time") <= moment - F.make_dt_interval(secs=F.lit(seconds))


def upsert_documents(catalog: DataFrame, docs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """The catalogue with ``docs`` added; a known ``id`` is overwritten as a whole.

    ``docs`` without id get one from their content. Several rows of one id in
    ``docs`` are reduced to the last by ``order``, ties and rows without an order to
    that of the greatest content digest, so that a rerun keeps the same one.
    The catalogue itself is only filtered, so a small batch does not shuffle it.
    """
    has_id = "id" in docs.columns
    docs = docs.withColumn("_digest", F.md5(F.to_json(F.struct(*(c for c in docs.columns if c != "id")))))
    docs = docs.withColumn("id", F.coalesce("id", "_digest") if has_id else F.col("_digest"))
    docs = latest(docs, "id", *order, "_digest").drop("_digest")
    return catalog.join(docs.select("id"), "id", "left_anti").unionByName(docs, allowMissingColumns=True)


def remove_documents(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("id"), "id", "left_anti")


def duplicate_ids(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_content(catalog: DataFrame) -> DataFrame:
    """Checksums held by several documents: how many, and the id to keep."""
    return (
        catalog.where(F.col("checksum").isNotNull())
        .groupBy("checksum")
        .agg(F.count("*").alias("copies"), F.min("id").alias("keep_id"))
        .where("copies > 1")
    )


def archive_versions(files: DataFrame, on_date: Column | None = None) -> DataFrame:
    """Rows for the ``versions`` table: the archive name of each replaced file."""
    day = F.current_date() if on_date is None else on_date
    return files.withColumns(
        {"archived_on": F.date_format(day, "yyyy-MM-dd"), "version_name": M.version_name(F.col("path"), day)}
    )


def apply_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a feed of ``id, op, ts, seq`` plus document columns: add, change, unlink.

    The last event of an id by ``(ts, seq)`` counts. A removed id stays as a
    tombstone with its time, so that an older event in a later batch is ignored.
    """
    return settle(catalog, latest_changes(changes))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last event of each id as a catalogue row, removals as tombstones."""
    last = latest(changes, "id", "ts", "seq")
    return last.withColumns(
        {
            "deleted": F.when(F.col("op") == "unlink", F.lit("true")),
            "last_ts": F.col("ts").cast("timestamp"),
            "last_seq": F.col("seq"),
        }
    ).drop("op", "ts", "seq")


def settle(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalogue after ``incoming`` rows that are not older than what it holds."""
    fresh = fresher(catalog, incoming)
    return catalog.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def fresher(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows not overtaken by a later event the catalogue has already seen."""
    seen = known_rows(catalog.where(F.col("last_ts").isNotNull()), incoming).select(
        "id", F.col("last_ts").cast("timestamp").alias("_ts"), F.col("last_seq").alias("_seq")
    )
    ts, known = F.col("last_ts").cast("timestamp"), F.col("_ts")
    later = (ts > known) | ((ts == known) & (F.col("last_seq") >= F.col("_seq")))
    return incoming.join(seen, "id", "left").where(known.isNull() | later).drop("_ts", "_seq")


def known_rows(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """Catalogue rows of the incoming ids.

    Put before an outer join with the catalogue: Spark may broadcast a small
    batch to this filter, but never the outer side of the join itself, so a
    small batch does not shuffle the catalogue.
    """
    return catalog.join(incoming.select("id"), "id", "left_semi")
