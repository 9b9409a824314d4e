"""Substring dedup on bytes: prefix-free parsing into phrases, and the order of their suffixes.

A window is 50 bytes. The window's trigger is the smallest rolling hash of its
24-byte strings, so equal windows have the same trigger wherever they stand. A
phrase is a run of windows of one trigger; neighbouring phrases overlap by 49
bytes, so every window lies in one phrase as a whole, and no phrase is the
beginning of another with the same trigger place. The dictionary holds the
distinct phrases with the first document of each; the parse is each document as
a row of phrases. What follows a phrase's suffix within 50 bytes is in the
phrase itself, so the sorted suffixes of the dictionary are the corpus order
as far as windows need it.

1. Dictionary and parse: a phrase that a document with a smaller id has too goes
   as a whole. That settles all copies without looking at single windows.
2. Only phrases of triggers that have several distinct phrases can share
   windows with others. Their first occurrences send their bytes, the suffixes
   are sorted, and each run of equal windows gives the smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.blobs import (
    ANSWERS, BUCKET_BYTES, answers, bucket_cuts, by_document, copies, gathered, groups_of, ids_of, pack, pack_sorted, unpack, unpack_sorted,
)
from doccat.llm.common import SLICE_BYTES, row_key, row_of, segment_sums, slices, stored, task_count, text_of, utf8
from doccat.llm.hashing import BYTE, STEP, mix

WINDOW, GRAM = 50, 24
SPREAD = WINDOW - GRAM + 1
#: Text parsed at a time: a dozen numbers of 8 bytes for each of its bytes.
PARSE_BYTES = SLICE_BYTES
_BACK = np.uint64(pow(int(STEP), -1, 2**64))
_tables: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse."""
    global _tables
    if n > len(_tables[0]):
        _tables = tuple(np.cumprod(np.full(n, base)) for base in (STEP, _BACK))
    return _tables[0][:n], _tables[1][:n]


class Parse:
    """The phrases of a batch of texts: ``lo`` and ``hi`` (first and last window), ``trigger``, ``row``; hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        up, self.down = scales(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:n], out=self.sums[1:])
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.trigger = self.row = empty
        if n >= WINDOW:
            grams = self.sums[GRAM:] - self.sums[:-GRAM]
            grams *= self.down[: n - GRAM + 1]
            least = mix(grams)
            least &= np.uint64(0xFFFFFFFF00000000)
            least |= np.arange(len(least), dtype=np.uint64)  # of equal hashes the first counts
            size = 1
            while 2 * size <= SPREAD:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            least = np.minimum(least[: n - WINDOW + 1], least[SPREAD - size : n - WINDOW + 1 + SPREAD - size])
            trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.arange(n - WINDOW + 1)
            row = row_of(offsets)[: len(starts)]
            valid = starts + WINDOW <= offsets[row + 1]
            starts, row, trigger = starts[valid], row[valid], trigger[valid]
            new = np.ones(len(starts), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
            heads = np.flatnonzero(new)
            self.lo, self.trigger, self.row = starts[heads], trigger[heads], row[heads]
            self.hi = starts[np.append(heads[1:], len(starts)) - 1] if len(heads) else empty
        first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.first = first
        self.number = np.arange(len(self.row)) - first[self.row] if len(self.row) else empty

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of strings of bytes."""
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(34)) % np.uint64(n)).astype(np.int32)


PARSED = "bucket int, triggers binary, contexts binary, owners binary, numbers binary, ids binary, keys binary"


def parsed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """All phrases as hashes of trigger and content with their places, a row for each bucket of triggers and 16 MB of text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, piece=PARSE_BYTES):
            parts, ids, keys, rows = [], [], [], 0
            for batch in held:
                p = Parse(*utf8(batch.column("text")))
                doc_id, key = ids_of(batch)
                known = ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                use = known[p.row] if len(p.row) else np.zeros(0, bool)
                gram = p.spans(p.trigger, p.trigger + GRAM)
                content = p.spans(p.lo, p.hi + WINDOW) ^ mix((p.trigger - p.lo + 1).astype(np.uint64))
                parts.append((gram[use], content[use] >> np.uint64(16), p.row[use] + rows, p.number[use]))
                ids.append(doc_id)
                keys.append(key)
                rows += batch.num_rows
            gram, content, owner, number = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, keys = np.concatenate(ids), np.concatenate(keys)
            low, bucket = gram.astype(np.uint32), bucket_of(gram, n_buckets)
            order = np.lexsort((low, bucket))
            low, content, owner, number = low[order], content[order], owner[order], number[order]
            cut = bucket_cuts(bucket[order], n_buckets)
            columns: list[list] = [[] for _ in range(7)]
            for b in np.flatnonzero(np.diff(cut)):
                a, z = cut[b], cut[b + 1]
                used, owners = np.unique(owner[a:z], return_inverse=True)
                values = (
                    b, pack_sorted(low[a:z]), np.ascontiguousarray(content[a:z]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                    pack(owners.astype(np.uint32)), pack(number[a:z].astype(np.uint32)), ids[used].tobytes(), keys[used].tobytes(),
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[f.split()[0] for f in PARSED.split(", ")]
            )

    return docs.mapInArrow(compute, PARSED)


def judged(phrases: DataFrame, n_buckets: int) -> DataFrame:
    """``doc_id, key, phrases``: 2 * number for phrases that an earlier document has, + 1 for those to compare by windows."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"]):
            parts = []
            for r in group.to_pylist():
                trigger = unpack_sorted(r["triggers"], np.uint32)
                content = np.zeros((len(trigger), 8), np.uint8)
                content[:, :6] = np.frombuffer(r["contexts"], np.uint8).reshape(-1, 6)
                owner = unpack(r["owners"], np.uint32)
                parts.append((
                    trigger, content.view(np.uint64)[:, 0], np.frombuffer(r["ids"], np.int64)[owner], np.frombuffer(r["keys"], np.int64)[owner],
                    unpack(r["numbers"], np.uint32),
                ))
            trigger, content, doc_id, key, number = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.lexsort((doc_id, content, trigger))
            trigger, content, doc_id, key, number = trigger[order], content[order], doc_id[order], key[order], number[order]
            new_trigger = np.append(True, trigger[1:] != trigger[:-1])
            new = new_trigger | np.append(True, content[1:] != content[:-1])
            heads = np.flatnonzero(new)
            first = np.repeat(doc_id[heads], np.diff(np.append(heads, len(new))))
            whole = doc_id > first
            # triggers whose phrases first appear in different documents
            tops = np.flatnonzero(new_trigger)
            least, most = np.minimum.reduceat(first, tops), np.maximum.reduceat(first, tops)
            mixed = np.repeat(least != most, np.diff(np.append(tops, len(new))))
            use = whole | (mixed & ~whole)
            if use.any():
                yield answers(doc_id[use], key[use], (2 * number[use].astype(np.int64) + ~whole[use]).astype(np.int64), n_buckets)

    dealt = phrases.repartition("bucket").sortWithinPartitions("bucket")
    return by_document(dealt.mapInArrow(compute, ANSWERS), "phrases")


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, zipped``: texts compressed, for they cross a shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            data, at = utf8(batch.column("text"))
            raw = memoryview(data.tobytes())
            zipped = [coder.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(zipped, pa.binary())], names=["doc_id", "key", "zipped"])

    return docs.mapInArrow(compute, "doc_id long, key long, zipped binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with their texts' bytes and offsets."""
    for batch in slices(batches, "zipped", PARSE_BYTES // 3):
        texts = [zstandard.decompress(z) if z else b"" for z in batch.column("zipped").to_pylist()]
        yield batch, *utf8(pa.array(texts, pa.binary()))


def listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays and the row of each; null is empty."""
    column = batch.column(name)
    row = np.repeat(np.arange(batch.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


BYTES = "bucket int, sizes binary, content binary, places binary, owners binary, ids binary, keys binary"


def contents(docs: DataFrame, n_buckets: int) -> DataFrame:
    """The bytes of the phrases to compare of ``doc_id, key, zipped, phrases``, by bucket of their triggers."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in opened(batches):
            row, value = listed(batch, "phrases")
            p = Parse(data, offsets)
            at = p.first[row] + (value >> 1)
            at = at[value % 2 == 1]
            bucket = bucket_of(p.spans(p.trigger[at], p.trigger[at] + GRAM), n_buckets)
            order = np.argsort(bucket, kind="stable")
            at, cut = at[order], bucket_cuts(bucket[order], n_buckets)
            ids, keys = ids_of(batch)
            columns: list[list] = [[] for _ in range(7)]
            for b in np.flatnonzero(np.diff(cut)):
                own = at[cut[b] : cut[b + 1]]
                size = p.hi[own] - p.lo[own] + WINDOW
                ends = np.cumsum(size)
                take = np.arange(ends[-1]) + np.repeat(p.lo[own] - ends + size, size)
                used, owners = np.unique(p.row[own], return_inverse=True)
                values = (
                    b, pack(size.astype(np.uint32)), zstandard.compress(data[take].tobytes(), 1), pack((p.lo[own] - offsets[p.row[own]]).astype(np.uint32)),
                    pack(owners.astype(np.uint32)), ids[used].tobytes(), keys[used].tobytes(),
                )
                for column, v in zip(columns, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[f.split()[0] for f in BYTES.split(", ")]
            )

    return docs.mapInArrow(compute, BYTES)


def earlier_windows(phrases: DataFrame, n_buckets: int) -> DataFrame:
    """``doc_id, key, starts``: windows that an earlier document has, by sorting all windows of a bucket byte by byte."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"]):
            views, ids, keys, places = [], [], [], []
            for r in group.to_pylist():
                size, owner = unpack(r["sizes"], np.uint32).astype(np.int64), unpack(r["owners"], np.uint32)
                content = np.frombuffer(zstandard.decompress(r["content"]), np.uint8)
                count = size - WINDOW + 1
                ends, starts = np.cumsum(count), np.cumsum(size) - size
                within = np.arange(ends[-1]) - np.repeat(ends - count, count)
                views.append(np.lib.stride_tricks.sliding_window_view(content, WINDOW)[np.repeat(starts, count) + within])
                places.append(np.repeat(unpack(r["places"], np.uint32).astype(np.int64), count) + within)
                ids.append(np.repeat(np.frombuffer(r["ids"], np.int64)[owner], count))
                keys.append(np.repeat(np.frombuffer(r["keys"], np.int64)[owner], count))
            text = np.concatenate(views)
            del views
            strings = text.view(f"S{WINDOW}")[:, 0]
            doc_id, key, place = np.concatenate(ids), np.concatenate(keys), np.concatenate(places)
            order = np.argsort(strings, kind="stable")
            strings = strings[order]
            heads = np.flatnonzero(np.append(True, strings[1:] != strings[:-1]))
            sizes = np.diff(np.append(heads, len(order)))
            first = np.repeat(np.minimum.reduceat(doc_id[order], heads), sizes)
            gone = order[doc_id[order] > first]
            if len(gone):
                yield answers(doc_id[gone], key[gone], place[gone], n_buckets)

    dealt = phrases.repartition("bucket").sortWithinPartitions("bucket")
    return by_document(dealt.mapInArrow(compute, ANSWERS), "starts")


RESULT = "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def result_rows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    borders = offsets[:-1][np.diff(offsets) > 0]
    head[borders] = gone[borders]
    at = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = data[~gone].tobytes()
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), batch.column("key"), pa.array(np.diff(offsets)), pa.array(segment_sums(gone.astype(np.int64), offsets)),
            pa.array(segment_sums(head.astype(np.int64), offsets)),
            pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
        ],
        names=[f.split()[0] for f in RESULT.split(", ")],
    )


def untouched(docs: DataFrame) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            yield result_rows(batch, data, offsets, np.zeros(len(data), bool))

    return docs.mapInArrow(compute, RESULT)


def cut_out(docs: DataFrame) -> DataFrame:
    """Results of ``doc_id, key, zipped, phrases, starts``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in opened(batches):
            row, value = listed(batch, "phrases")
            whole = value % 2 == 0
            p = Parse(data, offsets)
            at = p.first[row[whole]] + (value[whole] >> 1)
            row, start = listed(batch, "starts")
            begin = np.concatenate([p.lo[at], offsets[row] + start])
            end = np.concatenate([p.hi[at] + WINDOW, offsets[row] + start + WINDOW])
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            yield result_rows(batch, data, offsets, np.cumsum(change)[:-1] > 0)

    return docs.mapInArrow(compute, RESULT)


def repeats_removed(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row for each row of ``documents``, repeated rows included.

    A null text is empty; texts under 50 bytes lose nothing. A text that a row
    with a smaller doc_id has as a whole (told by its 64-bit hash) goes if it has 50
    bytes. Rows of one doc_id don't count against each other; rows with a null
    doc_id lose nothing and make no other row lose anything.
    """
    docs = text_of(documents).select("doc_id", row_key().alias("key"), "text")
    n_buckets = task_count(docs, "text", BUCKET_BYTES)
    whole = stored(untouched(docs), "whole")
    same = stored(copies(whole.where("doc_id is not null")), "copies")
    phrases = judged(parsed(docs, n_buckets), n_buckets)
    alone = phrases.join(same, (F.col("key") == F.col("copy_key")) & (F.col("doc_id") > F.col("copy_id")), "left_anti")
    phrases = stored(alone.select(F.col("doc_id").alias("id__"), F.col("key").alias("key__"), "phrases"), "phrases")
    texts = packed(docs)
    of = (F.col("doc_id") == F.col("id__")) & (F.col("key") == F.col("key__"))
    open_phrases = phrases.select("id__", "key__", F.filter("phrases", lambda x: x % 2 == 1).alias("phrases")).where(F.size("phrases") > 0)
    sent = contents(texts.join(open_phrases, of).select("doc_id", "key", "zipped", "phrases"), n_buckets)
    starts = stored(earlier_windows(sent, n_buckets), "starts").select(F.col("doc_id").alias("id2__"), F.col("key").alias("key2__"), "starts")
    gone = phrases.select("id__", "key__", F.filter("phrases", lambda x: x % 2 == 0).alias("phrases")).join(
        starts, (F.col("id__") == F.col("id2__")) & (F.col("key__") == F.col("key2__")), "left"
    ).where((F.size("phrases") > 0) | F.col("starts").isNotNull())
    partly = cut_out(texts.join(gone, of).select("doc_id", "key", "zipped", "phrases", "starts")).distinct()
    partly = partly.select(
        F.col("doc_id").alias("id__"), F.col("key").alias("key__"), F.col("n_removed").alias("removed__"), F.col("n_spans").alias("spans__"),
        F.col("kept_sha256").alias("kept__"),
    )
    out = whole.join(same, (F.col("key") == F.col("copy_key")) & (F.col("doc_id") > F.col("copy_id")), "left").join(partly, of, "left")
    all_gone, zero = F.col("copy_key").isNotNull() & (F.col("n_bytes") >= WINDOW), F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed__", zero)).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans__", zero)).alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept__", "kept_sha256")).alias("kept_sha256"),
    )
