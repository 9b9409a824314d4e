"""Tables, text batches and running totals that the operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text that a task works on at a time; temporary arrays take some thirty times that.
SLICE_BYTES = 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, besides their own places."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [given, root]))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the one in ``spark.checkpoint.dir``; a session without that
    setting uses a folder beside its tables, never a machine's temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and what else is asked for; any further columns go, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def row_key() -> Column:
    """Tells rows with one ``doc_id`` and different texts apart; wholly repeated rows share it."""
    return F.xxhash64("text")


def task_count(df: DataFrame, column: str, bytes_each: int) -> int:
    """How many parts of about ``bytes_each`` the column's values make."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // bytes_each))


# --- Arrow batches ----------------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offsets of each (one more than values); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def arrow_rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one run of bytes and its offsets."""
    if offsets[-1] < 2**31:
        made = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())]
        )
    else:
        made = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())]
        )
    return made


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element the row it lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; empty rows are 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


# --- running totals ---------------------------------------------------------------

def running_totals(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its group that come earlier in ``order``.

    Rows are dealt out by ranges of group and order, so a group of any size is
    spread over many tasks. Each task sums what it holds; the parts' sums, a row
    per task and group, are added up on their own. ``order`` should be unique
    within a group, or ties fall as they come.
    """
    keys = [F.col(c).asc_nulls_first() for c in groups + order]
    # with few rows Spark may join ranges; the number of the task is stored with the rows, so it stays right
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = dealt.withColumns({"part": F.lit(0), "within": F.lit(0).cast("long")}).schema

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            amounts = pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            changed = np.zeros(rows, bool)
            current = []
            for g in groups:
                column = batch.column(g)
                codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
                current.append((column[0].as_py(), column[rows - 1].as_py()))
            running = np.cumsum(amounts) - amounts
            heads = np.flatnonzero(changed)
            base = np.zeros(rows, np.int64)
            if last is not None and [c[0] for c in current] == last:
                base[: heads[0] if len(heads) else rows] = total
            if len(heads):
                lengths = np.diff(np.append(heads, rows))
                base[heads[0] :] = np.repeat(-running[heads], lengths)
            within = base + running
            total = int(within[-1] + amounts[-1])
            last = [c[1] for c in current]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(rows, part), pa.int32()), pa.array(within, pa.int64())],
                names=[*batch.schema.names, "part", "within"],
            )

    parts = stored(dealt.mapInArrow(sums, schema), name)
    each = parts.groupBy(*groups, "part").agg(F.sum(value).alias("held"))
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(
        *(F.col(g).alias(f"{g}__") for g in groups), F.col("part").alias("part__"),
        F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset__"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"{g}__")) for g in groups] + [F.col("part") == F.col("part__")]
    joined = parts.join(offsets, same)
    return joined.select(*df.columns, (F.col("within") + F.col("offset__")).alias("before"))
