"""Toxicity: cumulative-link ordinal regression over hashed beginnings of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import row_of, slices, stored, text_of, utf8
from doccat.llm.hashing import BYTE, LOWER, Words, mix, powers

#: Labelled documents to learn from, those of the smallest hashes of doc_id.
SAMPLE = 20_000
BITS = 20
#: Beginnings of words of 3 to 10 bytes count as features, and whole words.
SHORTEST, LONGEST = 3, 10
#: Features are chosen by how their share of documents differs between classes, in standard errors.
LEAST_Z, LEAST_DOCUMENTS, MOST_FEATURES = 5.0, 4, 2048
GRADES = 4
FLAG = 0.5

SALTS = np.random.default_rng(4).integers(0, 2**63, LONGEST, dtype=np.uint64)
GAPS = np.ones(256, bool)
GAPS[97:123] = GAPS[0x80:] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented letters of Latin-1 in UTF-8."""
    low = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    low[upper] += 0x20
    return low


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs of (feature, row), one for each beginning of every word, and the number of words of each row."""
    low = lowered(data)
    words = Words(low, offsets, GAPS)
    n_words = np.diff(words.first)
    row = row_of(words.first) if len(words.starts) else np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    found = [((words.hashes >> shift).astype(np.int32), row)]
    if not len(words.starts):
        return found, n_words
    # bytes past a word's end hash to nothing, so a beginning no longer grows there
    length = words.ends() - words.starts
    total, power = np.zeros(len(words.starts), np.uint64), powers(LONGEST)
    at = np.arange(len(words.starts))
    for k in range(LONGEST):
        at = at[length[at] > k]
        total[at] += BYTE[low[words.starts[at] + k]] * power[k]
        if k + 1 >= SHORTEST:
            found.append(((mix(total[at] ^ SALTS[k]) >> shift).astype(np.int32), row[at]))
    return found, n_words


class Ordinal:
    """P(grade <= j) = sigmoid(thresholds[j] - weights . x), with one set of weights for all thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[features] = np.arange(len(features))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse counts of the chosen features: rows, slots, counts; and the number of words."""
        found, n_words = word_features(data, offsets)
        keys = []
        for feature, row in found:
            slot = self.slot[feature]
            used = slot >= 0
            keys.append(row[used].astype(np.int64) * len(self.features) + slot[used])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        size = max(1, len(self.features))
        return key // size, (key % size).astype(np.int64), count, n_words

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold; 0 for rows without words."""
        row, slot, count, n_words = self.counts(data, offsets)
        line = np.bincount(row, weights=self.weights[slot] * np.log1p(count), minlength=len(offsets) - 1)
        line = line + self.weights[-1] * np.log1p(n_words)
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - line[:, None], -50, 50)))
        above[n_words == 0] = 0
        return above


def fit(
    row: np.ndarray, slot: np.ndarray, value: np.ndarray, width: int, grade: np.ndarray, grades: int, steps: int = 800, penalty: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean log likelihood with an L2 penalty; features are sparse."""
    n = len(grade)
    gaps = np.full(grades - 1, 0.5)
    gaps[0] = 1.0  # the first threshold itself; the others are sums of exponentials, so they stay in order
    weights = np.zeros(width)
    state = [np.zeros(width), np.zeros(width), np.zeros(grades - 1), np.zeros(grades - 1)]
    for step in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        line = np.bincount(row, value * weights[slot], n)
        cdf = np.ones((n, grades + 1))
        cdf[:, 0] = 0
        cdf[:, 1:-1] = 1 / (1 + np.exp(np.clip(line[:, None] - thresholds[None, :], -50, 50)))
        upper, lower = cdf[np.arange(n), grade + 1], cdf[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        slope = d_upper - d_lower
        g_weights = np.bincount(slot, value * slope[row], width) + penalty * weights
        g_thresholds = np.array([d_lower[grade == j + 1].sum() - d_upper[grade == j].sum() for j in range(grades - 1)])
        tail = np.cumsum(g_thresholds[::-1])[::-1]
        g_gaps = np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])
        for parameter, gradient, (m, v) in ((weights, g_weights, state[:2]), (gaps, g_gaps, state[2:])):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            parameter -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """Learn from at most ``sample`` labelled documents; None if they are not of both classes.

    Labels say toxic or not. A toxic document's grade, 1 to 3, is the third of the
    toxic sample that it falls in by the strength of a first fit with two grades.
    Features are counted and chosen by Spark; the driver
    gets the chosen ones and, of each document, how often it has them.
    """
    spark = documents.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    docs = text_of(documents)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("label_id")).select((F.col("toxic") > 0).alias("toxic"), "text")
    rows = stored(rows, "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches):
            found, _ = word_features(*utf8(batch.column("text")))
            key = np.unique(np.concatenate([r.astype(np.int64) << BITS | f for f, r in found]))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(total, (toxic[key >> BITS], key & ((1 << BITS) - 1)), 1)
        used = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[0][used]), pa.array(total[1][used])], names=["feature", "clean", "toxic"])

    counted = rows.mapInArrow(document_counts, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = sizes[False], sizes[True]
    share = (F.col("clean") + F.col("toxic") + 1) / (n0 + n1 + 2)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    best = counted.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("toxic") >= LEAST_DOCUMENTS))
    features = np.array([r.feature for r in best.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()], np.int64)
    if not len(features):
        return None
    shared = spark.sparkContext.broadcast(Ordinal(features, np.zeros(len(features) + 1), np.zeros(GRADES - 1)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, slot, count, n_words = shared.value.counts(*utf8(batch.column("text")))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"), pa.array(n_words, pa.int64()), pa.array([slot[a:b] for a, b in parts], pa.list_(pa.int64())),
                    pa.array([count[a:b] for a, b in parts], pa.list_(pa.int64())),
                ],
                names=["toxic", "n_words", "slots", "counts"],
            )

    found = rows.mapInArrow(sparse, "toxic boolean, n_words long, slots array<long>, counts array<long>").toArrow().to_pydict()
    n = len(found["toxic"])
    words = np.array(found["n_words"], float)
    row = np.append(np.repeat(np.arange(n), [len(c) for c in found["slots"]]), np.arange(n))
    slot = np.append(np.concatenate([*found["slots"], []]).astype(np.int64), np.full(n, len(features)))
    value = np.log1p(np.append(np.concatenate([*found["counts"], []]), words))
    toxic = np.array(found["toxic"], bool)
    weights, _ = fit(row, slot, value, len(features) + 1, toxic.astype(np.int64), 2)
    strength = np.bincount(row, value * weights[slot], n)
    cuts = np.quantile(strength[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, strength, side="right"), 0)
    weights, thresholds = fit(row, slot, value, len(features) + 1, grade, GRADES)
    return Ordinal(features, weights, thresholds)


def severity(documents: DataFrame, labels: DataFrame, flag: float = FLAG, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic``, one row for each row of ``documents``.

    ``severity`` is the expected grade (0 to 3), ``grade`` the likeliest one by
    cumulative probability, ``p_toxic`` that of grade 1 or more, ``toxic`` whether it
    is ``flag`` or more. Texts without words, and all texts if nothing could be
    learned, have severity 0.
    """
    model = train(documents, labels, sample)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            above = np.zeros((batch.num_rows, GRADES - 1))
            if shared.value is not None:
                above = shared.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1), pa.int32()),
                    pa.array(above[:, 0]), pa.array(above[:, 0] >= flag),
                ],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return text_of(documents).mapInArrow(score, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
