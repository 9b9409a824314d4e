"""Many small records in one row: packed columns that go through a shuffle as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import SLICE_BYTES, slices, utf8
from doccat.llm.hashing import mix

#: Text gathered before its records are sorted and sent, and text per bucket of the shuffle.
GATHER_BYTES = 16 * 1024 * 1024
BUCKET_BYTES = 16 * 1024 * 1024
NULL_ID = -(2**63)


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that equal high bytes shrink to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id (null as ``NULL_ID``) and key of each row."""
    doc_id = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    return doc_id, batch.column("key").to_numpy(zero_copy_only=False)


def id_array(doc_id: np.ndarray) -> pa.Array:
    return pa.array(doc_id, pa.int64(), mask=doc_id == NULL_ID)


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER_BYTES, piece: int = SLICE_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Texts in slices of about ``piece`` bytes, in lists of about ``most`` bytes."""
    held, size = [], 0
    for batch in slices(batches, most=piece):
        held.append(batch)
        size += len(utf8(batch.column("text"))[0])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_cuts(bucket: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` buckets begins in sorted bucket numbers, and the end."""
    return np.searchsorted(bucket, np.arange(n + 1))


def copies(known: DataFrame) -> DataFrame:
    """``copy_key, copy_id, copy_rows`` of each text that several rows of ``doc_id, key`` have; ``copy_id`` is the smallest id."""
    same = known.groupBy(F.col("key").alias("copy_key")).agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copy_rows"))
    return same.where("copy_rows > 1")


ANSWERS = "target int, ids binary, keys binary, counts binary, values binary"


def answers(doc_id: np.ndarray, key: np.ndarray, value: np.ndarray, n: int) -> pa.RecordBatch:
    """What a bucket has found about documents, one row for each of ``n`` targets, so that rows don't multiply by document."""
    target = (mix(key.astype(np.uint64) ^ doc_id.astype(np.uint64)) >> np.uint64(20)) % np.uint64(n)
    order = np.lexsort((value, doc_id, key, target))
    doc_id, key, value, target = doc_id[order], key[order], value[order], target[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (key[1:] != key[:-1]) | (target[1:] != target[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(order)))
    used, first = np.unique(target[heads], return_index=True)
    rows = list(zip(first, np.append(first[1:], len(heads)), strict=True))
    at = np.append(heads, len(order))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used.astype(np.int32)),
            *(pa.array([f(a, b) for a, b in rows], pa.binary()) for f in (
                lambda a, b: doc_id[heads[a:b]].tobytes(), lambda a, b: key[heads[a:b]].tobytes(), lambda a, b: pack(count[a:b].astype(np.uint32)),
                lambda a, b: pack(value[at[a] : at[b]].astype(np.uint32)),
            )),
        ],
        names=[f.split()[0] for f in ANSWERS.split(", ")],
    )


def by_document(found: DataFrame, name: str) -> DataFrame:
    """``doc_id, key`` and all their values, ascending, in an array called ``name``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["target"]):
            ids, keys, values = [], [], []
            for r in group.to_pylist():
                count = unpack(r["counts"], np.uint32)
                ids.append(np.repeat(np.frombuffer(r["ids"], np.int64), count))
                keys.append(np.repeat(np.frombuffer(r["keys"], np.int64), count))
                values.append(unpack(r["values"], np.uint32))
            doc_id, key, value = np.concatenate(ids), np.concatenate(keys), np.concatenate(values)
            order = np.lexsort((value, doc_id, key))
            doc_id, key, value = doc_id[order], key[order], value[order]
            new = np.ones(len(order), bool)
            new[1:] = (doc_id[1:] != doc_id[:-1]) | (key[1:] != key[:-1])
            heads = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), pa.array(value, pa.int32()))
            yield pa.RecordBatch.from_arrays([id_array(doc_id[heads]), pa.array(key[heads]), lists], names=["doc_id", "key", name])

    return found.repartition("target").sortWithinPartitions("target").mapInArrow(compute, f"doc_id long, key long, {name} array<int>")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each as one table; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(len(rows)):
            if rows[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, rows[i]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
