"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import row_of, segment_sums, slices, text_of, utf8
from doccat.llm.hashing import mix

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 16
SMOOTHING = 0.5

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 where it is no letter; one that lowers to several stays as it is."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out
    return _letters


def features(column: pa.Array, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hashed n-grams of each text: for every order (feature, offsets by row); and the number of letters of each row.

    Anything but letters counts as one gap, and a gap stands before and after a text.
    """
    data, offsets = utf8(column)
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    low = letters()[points]
    count = segment_sums((low > 0).astype(np.int64), at)
    # a gap before each text, none twice
    ranks = np.arange(len(at) - 1)
    padded = np.zeros(len(low) + len(ranks) + 1, np.uint32)
    padded[np.arange(len(low)) + row_of(at) + 1] = low
    starts = at + np.append(ranks, len(ranks))
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
    keep[starts[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    seq, starts = padded[keep].astype(np.uint64), kept[starts]
    found, shift = [], np.uint64(64 - bits)
    for n in orders:
        if n == 1:
            index = (mix(seq + np.uint64(n << 32)) >> shift).astype(np.int64)
            inside = seq > 0
        else:
            size = max(0, len(seq) - n + 1)
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + seq[k : k + size]
            index = (mix(h) >> shift).astype(np.int64)
            # the gap that ends a text may begin the next one, but no n-gram goes past it
            inside = np.ones(size, bool)
            gap = seq == 0
            for k in range(1, n - 1):
                inside &= ~gap[k : k + size]
        index = index[inside]
        before = np.concatenate([[0], np.cumsum(inside)])
        found.append((index, before[np.minimum(starts, len(inside))]))
    return found, count


def counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``lang, feature, n`` over all rows of ``lang, text``; ``feature`` -1 counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column("lang").dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            found, _ = features(batch.column("text"), bits)
            for i, name in enumerate(names):
                total = totals.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                rows = codes == i
                total[-1] += rows.sum()
                for index, offsets in found:
                    total[:-1] += np.bincount(index[rows[row_of(offsets)]], minlength=1 << bits)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(np.where(used == 1 << bits, -1, used), pa.int32()), pa.array(total[used])],
                names=["lang", "feature", "n"],
            )

    each = docs.select("lang", "text").mapInArrow(count, "lang string, feature int, n bigint")
    return each.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class NaiveBayes:
    """Languages in order of code point, ``weights[language, feature]`` (log probabilities) and ``priors``."""

    def __init__(self, langs: list[str], weights: np.ndarray, priors: np.ndarray):
        self.langs, self.weights, self.priors = langs, weights, priors

    @classmethod
    def fit(cls, docs: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> NaiveBayes:
        """Learn from every row of ``lang, text`` with a language; languages times features numbers reach the driver."""
        rows = counts(docs.where(F.col("lang").isNotNull()), bits).toArrow()
        langs = sorted(set(rows.column("lang").to_pylist()), key=lambda s: s.encode())
        table = np.zeros((len(langs), (1 << bits) + 1))
        if langs:
            code = pa.compute.index_in(rows.column("lang"), pa.array(langs, rows.column("lang").type)).to_numpy()
            table[code, rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
        n_docs, table = table[:, -1], table[:, :-1] + smoothing
        weights = np.log(table / table.sum(axis=1, keepdims=True)) if langs else table
        return cls(langs, weights, np.log((n_docs + 1) / (n_docs.sum() + len(langs))) if langs else n_docs)

    def score(self, column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log posteriors (up to a constant) of each row, the best language's place, and the number of letters."""
        found, n_letters = features(column, bits)
        out = np.repeat(self.priors[None, :], len(column), axis=0)
        for c in range(len(self.langs)):
            for index, offsets in found:
                out[:, c] += segment_sums(self.weights[c][index], offsets)
        return out, out.argmax(axis=1) if self.langs else np.zeros(len(column), int), n_letters


def predict(docs: DataFrame, model: NaiveBayes, *keep: str, bits: int = BITS) -> DataFrame:
    """``docs`` (``text`` and the columns in ``keep``) with ``lang_pred`` and ``score``, the best language's posterior.

    Texts that are null or hold no letter get ``und`` and 0, as do all texts if
    nothing was learned. Of equally good languages the first by code point wins.
    The matrix (languages x 2^bits numbers) is broadcast; texts of any length
    are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb = shared.value
        for batch in slices(batches):
            out, best, n_letters = nb.score(batch.column("text"), bits)
            known = (n_letters > 0) & bool(nb.langs)
            names = np.array([*nb.langs, UNKNOWN], object)[np.where(known, best, len(nb.langs))]
            if nb.langs:
                share = 1 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                share = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0))],
                names=[*keep, "lang_pred", "score"],
            )

    source = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = source.select(*keep).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return source.mapInArrow(scored, schema)


def is_held_out():
    """Documents kept out of learning: crc32 of ``doc_id`` as text leaves 2 by 4; a null id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row for each row of ``documents``, repeated rows included."""
    docs = text_of(documents, F.col("lang").cast("string").alias("lang"))
    model = NaiveBayes.fit(docs.where(~is_held_out()))
    return predict(docs.withColumn("held_out", is_held_out()), model, "doc_id", "held_out")


def identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a posterior of ``least`` or more, with all their columns.

    What goes: null texts, texts without a letter, and texts whose best language
    is no likelier than all others together.
    """
    docs = text_of(documents, F.col("lang").cast("string").alias("lang"))
    model = NaiveBayes.fit(docs.where(~is_held_out()))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb = shared.value
        for batch in slices(batches):
            if not nb.langs:
                continue
            out, _, n_letters = nb.score(batch.column("text"))
            share = 1 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1)
            yield batch.filter(pa.array((n_letters > 0) & (share >= least)))

    return documents.mapInArrow(accepted, documents.schema)
