"""Mixing sources to target weights: Efraimidis-Spirakis sampling up to token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import row_key, running_totals, segment_sums, slices, stored, text_of, utf8
from doccat.llm.hashing import GAP, Words

MOST_EPOCHS = 3
CYCLE = 3
SEED = 7
SMALLEST_WEIGHT = 0.05


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, key, source, size, quality``: words of each text, and a weight from the share of letters in it.

    The weight is the fourth power of that share (ASCII letters and all that is
    not ASCII, among bytes that are no gap), 0.05 at least; empty texts weigh that.
    """
    letter = np.zeros(256, np.int64)
    letter[65:91] = letter[97:123] = letter[128:] = 1
    solid = (~GAP).astype(np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            size = np.diff(Words(data, offsets, hashed=False).first)
            share = segment_sums(letter[data], offsets) / np.maximum(1, segment_sums(solid[data], offsets))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "source")), pa.array(size, pa.int64()), pa.array(np.maximum(SMALLEST_WEIGHT, share**4))],
                names=["doc_id", "key", "source", "size", "quality"],
            )

    return docs.mapInArrow(measure, "doc_id long, key long, source string, size long, quality double")


def targets(sizes: DataFrame, most: int = MOST_EPOCHS, cycle: int = CYCLE) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    Sources by code point, null last, weigh 1 to ``cycle``, again and again, and
    share the sum of all sizes; what is above ``most`` times a source's size goes
    to the others by weight. The level at which no target is above is found by
    summing up, one small job for each round of sources that reach their limit.
    """
    ordered = sizes.select(F.col("source").isNull().cast("int").alias("last"), "source", "source_size", F.lit(1).alias("one"))
    ranked = running_totals(ordered, [], ["last", "source"], "one", "sources")
    weighed = stored(ranked.select("source", "source_size", (F.col("before") % cycle + 1).alias("weight")), "weights")
    limit, level, below = F.col("source_size") * most, None, -1.0
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("given"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row.open:
            break
        level = (total - row.given) / row.open
        if level <= below:
            break
        below = level
    share = F.col("weight") * F.lit(float(level or 0.0))
    return weighed.select("source", "source_size", F.least(limit.cast("double"), share).alias("target"))


def mixed(docs: DataFrame, most: int = MOST_EPOCHS, cycle: int = CYCLE, seed: int = SEED) -> DataFrame:
    """``doc_id, key, source, size, source_size, target, quality, rank, taken`` of every row of ``doc_id, text, source``.

    A source's target is met by whole epochs first. The rest goes to documents
    in the order of their exponential keys, -ln(u) / quality, until its budget
    of words is spent; of the last one only as many of its first words count as
    the budget has left. ``u`` is a hash of seed, doc_id and text, so reruns agree, and
    rows that repeat as a whole follow each other. A source's rows are dealt out by
    ranges of their keys and their sizes summed up from parts, however large it is.
    """
    rows = stored(sized(docs.select("doc_id", row_key().alias("key"), "source", "text")), "sized")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(by_source, most, cycle), "targets")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    keyed = rows.withColumn("rank", -F.log(u) / F.col("quality"))
    summed = running_totals(keyed, ["source"], ["rank", "doc_id", "key"], "size", "order")
    plan = plan.select(F.col("source").alias("of"), "source_size", "target")
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most).cast("long"), F.floor(budget / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before")))
    return joined.select(
        "doc_id", "key", "source", "size", "source_size", "target", "quality", "rank",
        (epochs * F.col("size") + part).alias("taken"),
    )


def mix(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row for each row of ``documents``.

    A null text has size 0; null is a source of its own; an empty table gives no rows.
    """
    docs = text_of(documents, F.col("source").cast("string").alias("source"))
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def sampled(documents: DataFrame) -> DataFrame:
    """The mixture itself, with the columns of ``documents``: a row for every time that a document is read.

    A document taken two and a half times comes as two whole rows and one whose
    text ends with the last word taken; one of which nothing is taken is left
    out. Other columns are as they were.
    """
    docs = text_of(documents, F.col("source").cast("string").alias("source"))
    plan = mixed(docs).where("taken > 0").groupBy("doc_id", "key").agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    plan = plan.select(F.col("doc_id").alias("mix_id__"), F.col("key").alias("mix_key__"), F.col("size").alias("mix_size__"), F.col("taken").alias("mix_taken__"))
    text_key = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    same = documents["doc_id"].cast("long").eqNullSafe(F.col("mix_id__")) & (text_key == F.col("mix_key__"))
    joined = documents.join(plan, same)
    whole = F.floor(F.col("mix_taken__") / F.col("mix_size__"))
    left = F.col("mix_taken__") - whole * F.col("mix_size__")
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn("mix_words__", F.explode(times))
    cut = first_part("text", F.col("mix_words__"))
    return out.withColumn("text", F.when(F.col("mix_words__") < 0, F.col("text")).otherwise(cut)).select(*documents.columns)


def first_part(text: str, words) -> F.Column:
    """The text up to the end of its first ``words`` words."""
    word, n = r"[^\x20\x09-\x0D]+", words.cast("int")
    gaps, found = F.split(F.col(text), word, -1), F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, n).alias("gap"), F.slice(found, 1, n).alias("word"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], p["word"])), "")
