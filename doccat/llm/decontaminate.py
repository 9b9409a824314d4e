"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import row_key, slices, stored, text_of, utf8
from doccat.llm.hashing import LOWER

WINDOW = 10
#: Item text one automaton may hold: about 80 states of 32 bytes for each byte, so 1 GB for the worst text, 60 MB as measured.
AUTOMATON_BYTES = 400_000

#: Word bytes: digits, lower-case letters and all that is not ASCII. Everything else becomes one blank.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
NORMAL = np.where(WORD[LOWER], LOWER, 0x20).astype(np.uint8)
ROW = 0x0A


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case with one blank around each word.

    Gives the bytes, each row's offsets in them, and for every byte its place in
    the original. A row begins with a mark that no window holds, so that nothing
    matches across two texts.
    """
    rows = len(offsets) - 1
    starts = offsets + 3 * np.arange(rows + 1)
    low = np.full(len(data) + 3 * rows, 0x20, np.uint8)
    place = np.arange(len(data)) + 3 * np.repeat(np.arange(rows), np.diff(offsets)) + 2
    low[place] = NORMAL[data]
    low[starts[:-1]] = ROW
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    origin = np.zeros(len(low), np.int64)
    origin[place] = np.arange(len(data))
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[starts], origin[keep]


class Automaton:
    """Windows of all items as one automaton; each leads to its number of words and the items that have it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        found: dict[str, tuple[int, set[str]]] = {}
        for item_id, text in items:
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            norm, _, _ = normalised(raw, np.array([0, len(raw)]))
            words = norm[1:].tobytes().decode("latin-1").split(" ")
            words = [w for w in words if w]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(" " + " ".join(words[i : i + size]) + " ", (size, set()))[1].add(item_id)
        self.tree = ahocorasick.Automaton()
        for key, value in found.items():
            self.tree.add_word(key, value)
        self.tree.make_automaton()
        self.empty = not found

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """One pass over a batch of texts.

        Gives the number of words of each row and, for rows with matches, the
        hit words as (first, end) pairs, their byte spans in the original text,
        and the items found.
        """
        norm, at, origin = normalised(data, offsets)
        blank = norm == 0x20
        head = np.zeros(len(norm), bool)
        head[1:] = blank[:-1] & ~blank[1:] & (norm[1:] != ROW)
        heads = np.concatenate([[0], np.cumsum(head)])  # words that begin before a byte
        n_words = heads[at[1:]] - heads[at[:-1]]
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.empty:
            for end, (size, items) in self.tree.iter(norm.tobytes().decode("latin-1")):
                row = int(np.searchsorted(at, end, side="right")) - 1
                last = int(heads[end] - heads[at[row]])
                spans, ids = hits.setdefault(row, ([], set()))
                if spans and spans[-1][1] >= last - size:
                    spans[-1] = (min(spans[-1][0], last - size), max(spans[-1][1], last))
                else:
                    spans.append((last - size, last))
                ids |= items
        starts, out = np.flatnonzero(head), {}
        for row, (spans, ids) in hits.items():
            base = int(heads[at[row]])
            merged = merge(spans)
            pieces = [(int(origin[starts[base + a]]), int(origin[word_end(blank, starts[base + b - 1])] + 1)) for a, b in merged]
            pieces = [(a - int(offsets[row]), b - int(offsets[row])) for a, b in pieces]
            out[row] = (merged, pieces, ids)
        return n_words, out


def word_end(blank: np.ndarray, start: int) -> int:
    """The last byte of the word that begins at ``start``."""
    while start + 1 < len(blank) and not blank[start + 1]:
        start += 1
    return int(start)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_parts(benchmark: DataFrame, most: int = AUTOMATON_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in parts of at most ``most`` bytes of text each (a longer item alone), for one automaton each.

    The size is summed first; a part is then fetched by its own query when it is
    asked for.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // most)) if total > most else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [tuple(r) for r in items.where(part == i).collect()]


SCANNED = "doc_id long, key long, n_words long, spans array<struct<first:int,end:int>>, pieces array<struct<start:int,end:int>>, items array<string>"


def scanned(docs: DataFrame, items: list[tuple[str, str]], window: int = WINDOW) -> DataFrame:
    """Words, hit words, hit spans in the original text and items found of every row of ``doc_id, key, text``."""
    shared = docs.sparkSession.sparkContext.broadcast((items, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Automaton(*shared.value)
        for batch in slices(batches):
            n_words, hits = tree.scan(*utf8(batch.column("text")))
            rows = range(batch.num_rows)
            pairs = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in hits[i][0]] if i in hits else [] for i in rows], pairs),
                    pa.array([[{"start": a, "end": b} for a, b in hits[i][1]] if i in hits else [] for i in rows], places),
                    pa.array([sorted(hits[i][2]) if i in hits else [] for i in rows], pa.list_(pa.string())),
                ],
                names=["doc_id", "key", "n_words", "spans", "pieces", "items"],
            )

    return docs.mapInArrow(scan, SCANNED)


def merged_spans(spans: str) -> F.Column:
    """Spans of several scans of one text as disjoint ones."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<first:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """``doc_id, key, n_words, spans, pieces, items`` of every row of ``documents``.

    Null texts have no words; items without words match nothing; a null item_id
    counts as an empty name. A benchmark past ``most`` bytes is scanned in parts,
    each in its turn; what the parts find in a text is put together and joined
    back to all rows of that text, so rows that repeat come as often as given.
    """
    docs = text_of(documents).select("doc_id", row_key().alias("key"), "text")
    parts = item_parts(benchmark, most)
    items, following = next(parts), next(parts, None)
    if following is None:
        return scanned(docs, items, window)
    rows, found = None, None
    while items is not None:
        own = scanned(docs, items, window)
        if rows is None:
            # the first part's scan tells every row's words; later ones only what they hit
            own = stored(own, "scanned")
            rows = own.select("doc_id", "key", "n_words")
            own = own.where(F.size("items") > 0)
        else:
            own = stored(own.where(F.size("items") > 0), "scanned")
        hits = own.select("doc_id", "key", "spans", "pieces", "items")
        found = hits if found is None else found.unionByName(hits)
        items, following = following, next(parts, None) if following is not None else None
    together = found.groupBy("doc_id", "key").agg(*(F.flatten(F.collect_set(c)).alias(c) for c in ("spans", "pieces", "items")))
    together = together.select(
        F.col("doc_id").alias("id__"), F.col("key").alias("key__"), merged_spans("spans").alias("spans"),
        F.array_sort(F.array_distinct("pieces")).alias("pieces"), F.array_sort(F.array_distinct("items")).alias("items"),
    )
    out = rows.join(together, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("key") == F.col("key__")), "left")
    empty = {c: F.coalesce(c, F.array().cast(own.schema[c].dataType)).alias(c) for c in ("spans", "pieces", "items")}
    return out.select("doc_id", "key", "n_words", *empty.values())


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns.

    An item's window is ``window`` words, or the whole of a shorter item.
    """
    for items in item_parts(benchmark):
        documents = documents.mapInArrow(without(documents, items, window), documents.schema)
    return documents


def without(documents: DataFrame, items: list[tuple[str, str]], window: int):
    shared = documents.sparkSession.sparkContext.broadcast((items, window))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Automaton(*shared.value)
        for batch in slices(batches):
            _, hits = tree.scan(*utf8(batch.column("text")))
            keep = np.ones(batch.num_rows, bool)
            keep[list(hits)] = False
            yield batch.filter(pa.array(keep))

    return untouched

