"""Substring dedup on words: fixed blocks as anchors, probed by every rolling window, extended to exact repeats.

A repeat of 35 words holds one whole block of 18 in the grid of either document.
So every document's blocks are indexed and every rolling window of 18 words
probes them; around blocks that another place also has, the windows of 35 words are
compared by 64-bit hashes, which extends each hit to the whole repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.blobs import (
    ANSWERS, BUCKET_BYTES, answers, bucket_cuts, by_document, copies, gathered, groups_of, ids_of, pack, pack_sorted, unpack, unpack_sorted,
)
from doccat.llm.common import row_key, row_of, slices, stored, task_count, text_of, utf8
from doccat.llm.hashing import Words, windows

WINDOW = 35


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


PROBES = "bucket int, probes binary, many binary, blocks binary, owners binary, numbers binary, ids binary, keys binary"


def probes(docs: DataFrame, n_buckets: int, block: int) -> DataFrame:
    """Rolling windows (distinct, by 32 bits within a bucket) and blocks with their places, a row for each bucket and 16 MB of text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            rolling, index, owner, number, ids, keys, rows = [], [], [], [], [], [], 0
            for batch in held:
                words = Words(*utf8(batch.column("text")))
                hashes = windows(words.hashes, block)
                row = row_of(words.first)[: len(hashes)]
                place = np.arange(len(hashes)) - words.first[row]
                whole = np.arange(len(hashes)) + block <= words.first[row + 1]
                rolling.append(hashes[whole])
                grid = whole & (place % block == 0)
                index.append(hashes[grid])
                owner.append(row[grid] + rows)
                number.append(place[grid] // block)
                doc_id, key = ids_of(batch)
                ids.append(doc_id)
                keys.append(key)
                rows += batch.num_rows
            rolling, index, owner, number = (np.concatenate(x) for x in (rolling, index, owner, number))
            ids, keys = np.concatenate(ids), np.concatenate(keys)
            own, count = np.unique(rolling, return_counts=True)
            del rolling
            order = np.argsort(bucket_of(own, n_buckets), kind="stable")
            own, count = own[order], count[order]
            cut = bucket_cuts(bucket_of(own, n_buckets), n_buckets)
            order = np.argsort(bucket_of(index, n_buckets), kind="stable")
            index, owner, number = index[order], owner[order], number[order]
            cut_index = bucket_cuts(bucket_of(index, n_buckets), n_buckets)
            columns: list[list] = [[] for _ in range(8)]
            for b in range(n_buckets):
                a, z = cut[b], cut[b + 1]
                if a == z:
                    continue
                low = own[a:z].astype(np.uint32)
                order = np.argsort(low)
                i, j = cut_index[b], cut_index[b + 1]
                rows_used, owners = np.unique(owner[i:j], return_inverse=True)
                values = (
                    b, pack_sorted(low[order]), np.packbits(count[a:z][order] > 1).tobytes(), index[i:j].astype(np.uint32).tobytes(),
                    pack(owners.astype(np.uint32)), pack(number[i:j].astype(np.uint32)), ids[rows_used].tobytes(), keys[rows_used].tobytes(),
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[f.split()[0] for f in PROBES.split(", ")]
            )

    return docs.mapInArrow(compute, PROBES)


def flagged_blocks(probed: DataFrame, n_buckets: int) -> DataFrame:
    """``doc_id, key, blocks``: numbers of the blocks whose words some other place has too."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"]):
            rows = group.to_pylist()
            sizes = [unpack_sorted(r["probes"], np.uint32) for r in rows]
            weights = [np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(s)) + 1 for r, s in zip(rows, sizes, strict=True)]
            value, weight = np.concatenate(sizes), np.concatenate(weights)
            order = np.argsort(value, kind="stable")
            value, weight = value[order], weight[order]
            heads = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            total = np.add.reduceat(weight.astype(np.int64), heads)
            repeated, found = value[heads][total > 1], []
            for r in rows:
                index = np.frombuffer(r["blocks"], np.uint32)
                if not len(index) or not len(repeated):
                    continue
                at = np.minimum(np.searchsorted(repeated, index), len(repeated) - 1)
                hit = np.flatnonzero(repeated[at] == index)
                if not len(hit):
                    continue
                owner, number = unpack(r["owners"], np.uint32)[hit], unpack(r["numbers"], np.uint32)[hit]
                found.append((np.frombuffer(r["ids"], np.int64)[owner], np.frombuffer(r["keys"], np.int64)[owner], number))
            if found:
                yield answers(*(np.concatenate(x) for x in zip(*found, strict=True)), n_buckets)

    dealt = probed.repartition("bucket").sortWithinPartitions("bucket")
    return by_document(dealt.mapInArrow(compute, ANSWERS), "blocks")


PLACES = "bucket int, hashes binary, owners binary, places binary, ids binary, keys binary"


def around(docs: DataFrame, n_buckets: int, window: int, block: int) -> DataFrame:
    """Windows of ``window`` words around the flagged blocks of ``doc_id, key, text, blocks``, with their places."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*utf8(batch.column("text")))
            hashes = windows(words.hashes, window)
            listed = batch.column("blocks")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
            number = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            last = words.first[row] + number * block  # of the windows that hold the block whole
            start = (last[:, None] - np.arange(window - block + 1)[None, :])
            good = (start >= words.first[row][:, None]) & (start + window <= words.first[row + 1][:, None])
            start = np.unique(start[good])
            owner = np.searchsorted(words.first, start, side="right") - 1
            place = start - words.first[owner]
            own = hashes[start]
            bucket = bucket_of(own, n_buckets)
            order = np.lexsort((own, bucket))
            own, owner, place = own[order], owner[order], place[order]
            cut = bucket_cuts(bucket[order], n_buckets)
            ids, keys = ids_of(batch)
            columns: list[list] = [[] for _ in range(6)]
            for b in np.flatnonzero(np.diff(cut)):
                a, z = cut[b], cut[b + 1]
                used, owners = np.unique(owner[a:z], return_inverse=True)
                values = (b, own[a:z].tobytes(), pack(owners.astype(np.uint32)), pack(place[a:z].astype(np.uint32)), ids[used].tobytes(), keys[used].tobytes())
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[f.split()[0] for f in PLACES.split(", ")]
            )

    return docs.mapInArrow(compute, PLACES)


def repeated_windows(placed: DataFrame, n_buckets: int) -> DataFrame:
    """``doc_id, key, starts``: the windows whose words also start at another place."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"]):
            rows = group.select(["hashes", "owners", "places", "ids", "keys"]).to_pylist()
            parts = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            ordered = np.sort(np.concatenate(parts))
            repeated = ordered[:-1][ordered[1:] == ordered[:-1]]
            repeated = repeated[np.append(True, repeated[1:] != repeated[:-1])] if len(repeated) else repeated
            found = []
            for r, own in zip(rows, parts, strict=True):
                if not len(repeated):
                    break
                at = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
                hit = np.flatnonzero(repeated[at] == own)
                if not len(hit):
                    continue
                owner, place = unpack(r["owners"], np.uint32)[hit], unpack(r["places"], np.uint32)[hit]
                found.append((np.frombuffer(r["ids"], np.int64)[owner], np.frombuffer(r["keys"], np.int64)[owner], place))
            if found:
                yield answers(*(np.concatenate(x) for x in zip(*found, strict=True)), n_buckets)

    dealt = placed.repartition("bucket").sortWithinPartitions("bucket")
    return by_document(dealt.mapInArrow(compute, ANSWERS), "starts")


def kept_words(data: np.ndarray, offsets: np.ndarray, words: Words, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words with one blank between them."""
    sizes = np.diff(np.append(words.starts, len(data)))
    chosen = np.zeros(len(data), bool)
    if len(words.starts):
        chosen[int(words.starts[0]) :] = np.repeat(keep, sizes)
    inside = words.inside
    solid = chosen & inside
    after = np.zeros(len(data), bool)
    after[1:] = solid[:-1] & ~inside[1:]
    after[offsets[:-1][np.diff(offsets) > 0]] = False
    raw = np.where(inside, data, 0x20).astype(np.uint8)
    use = solid | after
    at = np.concatenate([[0], np.cumsum(use)])[offsets]
    out = raw[use].tobytes()
    return [out[a:b].rstrip(b" ") for a, b in zip(at[:-1], at[1:], strict=True)]


RESULT = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string"


def digested(docs: DataFrame, window: int) -> DataFrame:
    """Counts and digest of what is kept of ``doc_id, key, text`` and, if there, ``starts`` of windows to remove."""
    marked = "starts" in docs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets, hashed=True)
            keep = np.ones(len(words.starts), bool)
            if marked:
                listed = batch.column("starts")
                row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                start = words.first[row] + listed.flatten().to_numpy(zero_copy_only=False)
                change = np.zeros(len(keep) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + window, -1)
                keep = np.cumsum(change)[:-1] == 0
            removed = np.concatenate([[0], np.cumsum(~keep)])[words.first]
            texts = kept_words(data, offsets, words, keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(removed), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ],
                names=["doc_id", "key", "n_words", "n_removed", "kept_sha256"],
            )

    return docs.mapInArrow(compute, RESULT)


def repeats_removed(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row for each row of ``documents``, repeated rows included.

    A null text has no words; documents of fewer than ``window`` words lose
    nothing. Rows with one text, told by its 64-bit hash, lose all of it if it has
    ``window`` words; only the first of them, by doc_id, is compared with others.
    """
    block = (window + 1) // 2
    docs = text_of(documents).select("doc_id", row_key().alias("key"), "text")
    n_buckets = task_count(docs, "text", BUCKET_BYTES)
    whole = stored(digested(docs, window), "whole")
    same = stored(copies(whole), "copies")
    flagged = flagged_blocks(probes(docs, n_buckets, block), n_buckets)
    alone = flagged.join(same, F.col("key") == F.col("copy_key"), "left").where(F.col("copy_id").isNull() | (F.col("doc_id") == F.col("copy_id")))
    alone = alone.select(F.col("doc_id").alias("id__"), F.col("key").alias("key__"), "blocks", F.col("copy_key").isNotNull().alias("copied"))
    of = F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("key") == F.col("key__"))
    texts = stored(docs.join(alone, of).select("doc_id", "key", "text", "blocks", "copied"), "texts")
    starts = repeated_windows(around(texts, n_buckets, window, block), n_buckets).select(F.col("doc_id").alias("id__"), F.col("key").alias("key__"), "starts")
    partly = digested(texts.where("not copied").join(starts, of).select("doc_id", "key", "text", "starts"), window)
    partly = partly.distinct().select(
        F.col("doc_id").alias("id__"), F.col("key").alias("key__"), F.col("n_removed").alias("removed__"), F.col("kept_sha256").alias("kept__")
    )
    out = whole.join(same, F.col("key") == F.col("copy_key"), "left").join(partly, of, "left")
    gone = F.col("copy_key").isNotNull() & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed__", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept__", "kept_sha256")).alias("kept_sha256"),
    )
