"""Periodic runs of words: suffix classes united by falling LCP, ordered position sets, newly adjacent positions as seeds."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import row_of, slices, text_of, utf8
from doccat.llm.hashing import Words, mix, windows

#: Words that a run has at least, and how many of its periods.
LEAST, TIMES = 24, 3
#: Bytes of output put together at a time.
PIECE_BYTES = 1024 * 1024


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """Words that a run shares with itself one period on: length - q >= max(least - q, (times - 1) * q), least where both are equal."""
    return -(-least * (times - 1) // times)


def repeated_stretches(words: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Places of all words inside a window of ``size`` words that its row holds more than once."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    own = np.flatnonzero(rows[:n] == rows[size - 1 :])
    keys = mix(windows(words, size)[own] + mix(rows[own].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, own[twice], 1)
    np.subtract.at(covered, own[twice] + size, 1)
    return np.flatnonzero(np.cumsum(covered[:-1]))


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling; only suffixes that are still alike are sorted again."""
    n = len(symbols)
    place = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = symbols[place][1:] != symbols[place][:-1]
    rank[place] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active, step = place[~(new & np.append(new[1:], True))], 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        order = np.argsort(rank[active] * (n + 1) + second + 1, kind="stable")
        active, second = active[order], second[order]
        first, at = rank[active], np.arange(len(active))
        head, new = np.ones(len(active), bool), np.ones(len(active), bool)
        head[1:] = first[1:] != first[:-1]
        new[1:] = head[1:] | (second[1:] != second[:-1])
        rank[active] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        active, step = active[~(new & np.append(new[1:], True))], 2 * step
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def common_prefixes(symbols: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in order; the last symbol occurs once, so no comparison runs over the end."""
    s, sa, place, out, held = memoryview(symbols), memoryview(suffixes), memoryview(rank), np.zeros(len(symbols), np.int64), 0
    lcp = memoryview(out)
    for i in range(len(symbols)):
        r = place[i]
        if not r:
            held = 0
            continue
        j = sa[r - 1]
        while s[i + held] == s[j + held]:
            held += 1
        lcp[r] = held
        if held:
            held -= 1
    return out


def seeds(symbols: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs that overlap themselves by ``shortest`` symbols and by two periods.

    Suffixes are united by falling LCP, the smaller class into the larger one;
    each class keeps its positions in order. Where two positions of the two
    classes become neighbours, their LCP is that of this step. If they are no
    further apart than it, the stretch from the first has their distance as its
    period, and no smaller one: that would have put a position between them.
    Only the leftmost such pair of a run is given out.
    """
    suffixes, rank = suffix_order(symbols)
    lcp = common_prefixes(symbols, suffixes, rank)
    order = np.flatnonzero(lcp >= shortest)
    order = order[np.argsort(-lcp[order], kind="stable")]
    s, parent = memoryview(symbols), memoryview(np.arange(len(symbols)))
    sets: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def meet(y: int, x: int, depth: int) -> None:
        if x - y <= depth and (y == 0 or s[y - 1] != s[x - 1]):
            found.append((y, x - y + depth, x - y))

    steps = zip(suffixes[order - 1].tolist(), suffixes[order].tolist(), lcp[order].tolist(), strict=True)
    for a, b, depth in steps:
        a, b = root(a), root(b)
        large, small = sets.pop(a, None) or [a], sets.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for t, x in enumerate(small):
            k = bisect_left(large, x)
            if k and (not t or small[t - 1] < large[k - 1]):
                meet(large[k - 1], x, depth)
            if k < len(large) and (t + 1 == len(small) or small[t + 1] > large[k]):
                meet(x, large[k], depth)
        if len(small) <= 4:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        parent[b], sets[a] = a, large
    return found


def runs_of(words: np.ndarray, rows: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(place of the first word, length, period) of all runs, one a row, by place and period.

    ``words`` are hashes, ``rows`` the text of each. A run meets itself one
    period on, so it lies in words that are covered by windows which their text
    holds twice; only these are sorted. Stretches end in a symbol of their own.
    """
    shortest = overlap(least, times)
    place = repeated_stretches(words, rows, shortest)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    ends = np.ones(len(place), bool)
    ends[:-1] = (place[1:] != place[:-1] + 1) | (rows[place[1:]] != rows[place[:-1]])
    at = np.arange(len(place)) + np.cumsum(ends) - ends
    kinds = np.unique(mix(words[place] + mix(rows[place].astype(np.uint64))), return_inverse=True)[1]
    symbols = np.empty(len(place) + int(ends.sum()), np.int64)
    symbols[at] = kinds
    symbols[at[ends] + 1] = len(place) + np.arange(int(ends.sum()))
    found = np.array(seeds(symbols, shortest), np.int64).reshape(-1, 3)
    found = found[found[:, 1] >= np.maximum(least, times * found[:, 2])]
    back = np.zeros(len(symbols), np.int64)
    back[at] = place
    found[:, 0] = back[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Bytes of words with one space before each that is not a head."""
    gap = (~heads).astype(np.int64)
    size = ends - starts + gap
    until = np.cumsum(size)
    total = int(until[-1]) if len(until) else 0
    out = data[np.maximum(0, np.arange(total) + np.repeat(starts - gap - (until - size), size))]
    out[(until - size)[~heads]] = 0x20
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, runs, collapsed``, one row for each row of ``docs``.

    ``runs`` has (start, length, period) of every stretch of at least ``least``
    words and ``times`` periods, in words from 0, by start and period.
    ``collapsed`` has the words joined by one space, of each run only the first
    period. A null or empty text has no runs and collapses to the empty text.
    Rows that repeat, and rows with a null doc_id, are judged each on its own;
    no rows give none. Texts are whole, however long: one is never cut.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets)
            rows = row_of(words.first)
            found = runs_of(words.hashes, rows, least, times)
            gone = np.zeros(len(rows) + 1, np.int32)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.subtract.at(gone, found[:, 0] + found[:, 1], 1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            owner = rows[kept]
            heads = np.ones(len(kept), bool)
            heads[1:] = owner[1:] != owner[:-1]
            starts, ends = words.starts[kept], words.ends()[kept]
            until = np.cumsum(ends - starts + ~heads)
            cuts = np.searchsorted(until, np.arange(PIECE_BYTES, int(until[-1]) if len(until) else 0, PIECE_BYTES))
            cuts = np.unique(np.concatenate([[0], cuts, [len(kept)]])).astype(np.int64)
            text = b"".join(joined(data, starts[a:z], ends[a:z], heads[a:z]).tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True))
            borders = np.concatenate([[0], until])[np.searchsorted(owner, np.arange(batch.num_rows + 1))]
            lists = np.searchsorted(rows[found[:, 0]], np.arange(batch.num_rows + 1))
            found[:, 0] -= words.first[rows[found[:, 0]]]
            each = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], ["start", "length", "period"])
            collapsed = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), each), collapsed], names=["doc_id", "runs", "collapsed"]
            )

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return text_of(docs).mapInArrow(compute, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic end in one text of ten, chosen by the crc32 of doc_id; a null doc_id changes nothing."""

    def edited(doc_id: int, text: str) -> str:
        seed = zlib.crc32(str(doc_id).encode())
        if seed % 10:
            return text
        data = np.frombuffer(text.encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]))
        n, g = len(words.starts), seed // 10
        if not n:
            return text
        first = g % n
        period = 1 + (n - first) // (3 + g % 8)
        order = np.arange(n)
        order[first:] = first + (order[first:] - first) % period
        return joined(data, words.starts[order], words.ends()[order], np.arange(n) == 0).tobytes().decode()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [t if i is None else edited(i, t) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.large_string())], names=["doc_id", "text"])

    return text_of(docs).mapInArrow(compute, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length/period (ties: smallest start, then period), digests of runs and collapsed text."""
    better = lambda best, r: (
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    )
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    top = F.aggregate("runs", F.lit(None).cast(kind), lambda best, r: F.when(better(best, r), r).otherwise(best).cast(kind))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), text.alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
