"""MinHash near-duplicates: banded MinHash, odd sketches of the samples, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.blobs import groups_of
from doccat.llm.common import arrow_rows, row_key, slices, stored, text_of, utf8
from doccat.llm.components import components
from doccat.llm.hashing import LOWER, Words, mix, windows

SHINGLE = 5
#: Similarity that links, in hundredths.
PERCENT = 75
#: 32 bands of 4 samples miss a pair of similarity 0.75 with probability 5e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Estimated similarity from which a pair counts as a candidate: six standard deviations of 128 samples below 0.75.
CANDIDATE = 0.52
CELL = 2048
#: A list of this many ids and hashes takes 32 MB.
BROADCAST_ROWS = 2_000_000
CELL_BYTES = 32 * 1024 * 1024

_random = np.random.default_rng(5)
FACTORS = (_random.integers(0, 2**31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each row (with repeats) and their offsets; a row of fewer words is one shingle."""
    words = Words(LOWER[data], offsets)
    n_words = np.diff(words.first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.uint64)
    for n in range(1, size + 1):
        rows = np.flatnonzero(n_words == n if n < size else n_words >= size)
        if len(rows):
            runs = windows(words.hashes, n)
            place = np.arange(count[rows].sum()) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
            out[np.repeat(at[rows], count[rows]) + place] = mix(runs[np.repeat(words.first[rows], count[rows]) + place] + np.uint64(n))
    return out, at


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples, a row for each set; sets must not be empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint32)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(low * FACTORS[k] + SHIFTS[k], offsets[:-1])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(samples), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h ^ samples[:, k].astype(np.uint64)) + np.uint64(k)
        keys[:, b] = mix(h)
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: each (place, value) flips one of ``SKETCH_BITS`` bits."""
    bits = (mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    rows = np.arange(len(samples))
    for k in range(SAMPLES):
        parity[rows, bits[:, k]] ^= 1
    return np.packbits(parity, axis=1)


def most_difference(similarity: float) -> int:
    """Differing bits that sketches of two sets of this similarity have at most, as an estimate.

    2 * SAMPLES * (1 - J) samples differ, and each flips one bit of the XOR.
    """
    differing = 2 * SAMPLES * (1 - similarity)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS))))


FEATURES = "doc_id long, key long, n long, fp binary, bands array<long>, sketch binary"


def features(docs: DataFrame) -> DataFrame:
    """Size, fingerprint, band keys and odd sketch of the shingle set of every row of ``doc_id, key, text``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingles(*utf8(batch.column("text")))
            full = np.flatnonzero(np.diff(at))
            n = np.zeros(batch.num_rows, np.int64)
            marks = np.zeros((batch.num_rows, 2), np.uint64)
            for i in full:
                own = distinct(hashes[at[i] : at[i + 1]])
                n[i] = len(own)
                marks[i] = mix(own).sum(), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()
            bands: list = [[]] * batch.num_rows
            sketch: list = [b""] * batch.num_rows
            if len(full):
                samples = signatures(hashes, np.append(at[full], at[-1]))
                for i, b, s in zip(full, band_keys(samples).astype(np.int64), odd_sketches(samples), strict=True):
                    bands[i], sketch[i] = b, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array(n), pa.array([m.tobytes() for m in marks], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "key", "n", "fp", "bands", "sketch"],
            )

    return docs.mapInArrow(compute, FEATURES)


def forest_of_sketches(fps: list[bytes], sketches: np.ndarray, most: int) -> list[tuple[bytes, bytes]]:
    """Edges that connect what is connected by pairs of at most ``most`` differing bits."""
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop(0)
            near = np.bitwise_count(sketches[left] ^ sketches[x]).sum(axis=1) <= most
            edges += [(fps[x], fps[y]) for y in left[near]]
            frontier += left[near].tolist()
            left = left[~near]
    return edges


def candidates(reps: DataFrame, chunk: int = CELL) -> DataFrame:
    """Distinct pairs ``a, b`` that connect all sets whose sketches are near and that share a band.

    Buckets are counted first and single ones dropped. A bucket of more than
    ``chunk`` sets is dealt into parts by a hash that differs from band to band.
    Within a part only the edges of a spanning forest are given out, each from the
    smallest fingerprint that is left, so that the bands agree on most of them.
    Members of a parted bucket that this leaves outside the bucket's largest
    component are then compared with all its parts, so no pair is lost to the parting.
    """
    members = reps.select("fp", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    dealt = members.join(full, "bucket").select("fp", "bucket", F.pmod(F.xxhash64("fp", "bucket"), F.ceil(F.col("held") / chunk)).alias("chunk"))
    sketches = reps.select("fp", "sketch")
    first = near_in_cells(dealt, sketches, ["bucket", "chunk"])
    large = full.where(F.col("held") > chunk)
    if large.isEmpty():
        return first
    first = stored(first, "near")
    label = components(first, "near").select(F.col("node").alias("fp"), "component")
    parted = dealt.join(large.select("bucket"), "bucket", "left_semi").join(label, "fp", "left")
    parted = stored(parted.withColumn("component", F.coalesce("component", "fp")), "buckets")
    held = parted.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = held.groupBy("bucket").agg(F.max(F.struct("held", "component")).alias("top")).select("bucket", F.col("top.component").alias("largest"))
    rest = parted.join(largest, "bucket").where("component <> largest")
    counted = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("blocks")).join(large, "bucket")
    counted = counted.select("bucket", "blocks", F.ceil(F.col("held") / chunk).alias("chunks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).alias("block")
    asking = rest.join(counted, "bucket").select("fp", "bucket", block, each("chunks").alias("chunk"))
    asked = parted.join(counted, "bucket").select("fp", "bucket", each("blocks").alias("block"), "chunk")
    cells = asking.union(asked.select("fp", "bucket", "block", "chunk")).distinct()
    return first.union(near_in_cells(cells, sketches, ["bucket", "block", "chunk"])).distinct()


def near_in_cells(cells: DataFrame, sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs ``a, b`` that connect the near sketches (``fp, sketch``) of each cell of ``fp`` by ``keys``."""
    rows = cells.join(sketches, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    most = most_difference(CANDIDATE)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        found: set[tuple[bytes, bytes]] = set()
        for group in groups_of(batches, keys):
            if group.num_rows < 2:
                continue
            fps = group.column("fp").to_pylist()
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(fps), -1)
            found.update((min(e), max(e)) for e in forest_of_sketches(fps, sketches, most))
            if len(found) > 50_000:
                yield arrow_rows(schema, *map(list, zip(*found, strict=True)))
                found.clear()
        if found:
            yield arrow_rows(schema, *map(list, zip(*found, strict=True)))

    return rows.select(*keys, "fp", "sketch").mapInArrow(link, "a binary, b binary").distinct()


def forest_of_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges, each confirmed on whole sets, that connect what is linked at ``percent`` hundredths of the union."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(ids, kind="stable")
    holders, starts = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    at = np.concatenate([[0], np.cumsum(size)])
    edges, left = [], np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier and left.any():
            x = frontier.pop()
            own = ids[at[x] : at[x + 1]]
            count = starts[own + 1] - starts[own]
            ends = np.cumsum(count)
            places = np.arange(ends[-1]) + np.repeat(starts[own] - ends + count, count)
            both = np.bincount(holders[places], minlength=len(sets))
            near = np.flatnonzero(left & (100 * both >= percent * (size + size[x] - both)))
            edges += [(x, int(y)) for y in near]
            left[near] = False
            frontier += near.tolist()
    return edges


def confirmed(cells: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links ``a, b`` that connect the sets of each cell; ``cells`` has ``fp``, ``members`` (a set as bytes) and ``keys``."""
    rows = cells.repartition(*keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys):
            sets = dict(zip(group.column("fp").to_pylist(), group.column("members").to_pylist(), strict=True))
            fps = list(sets)
            edges = forest_of_sets([np.frombuffer(s, np.uint64) for s in sets.values()], percent) if len(fps) > 1 else []
            if edges:
                yield arrow_rows(pa.schema([("a", pa.binary()), ("b", pa.binary())]), [fps[x] for x, _ in edges], [fps[y] for _, y in edges])

    return rows.select(*keys, "fp", "members").mapInArrow(link, "a binary, b binary")


def with_sets(docs: DataFrame) -> DataFrame:
    """``cluster, chunks, fp, members`` of ``cluster, chunks, fp, text``: the whole set of shingles, 8 bytes each."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingles(*utf8(batch.column("text")))
            own = [distinct(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cluster", "chunks", "fp")), pa.array(own, pa.binary())], names=["cluster", "chunks", "fp", "members"]
            )

    return docs.mapInArrow(compute, "cluster binary, chunks long, fp binary, members binary")


def links(docs: DataFrame, known: DataFrame, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Confirmed links ``a, b`` between the distinct shingle sets (``fp``) of ``known``, as a spanning forest.

    1. Sets are found alike by bands and odd sketches; what that connects is a cluster.
    2. The texts of clusters are read again. A cluster is checked as a whole, set
       against set, or in parts if it has more than ``cell`` sets or many shingles.
    3. In a cluster of several parts, the sets outside its largest component so
       far are checked against all its parts, so no link is lost to the parting.
    """
    reps = known.where("n > 0").groupBy("fp").agg(
        F.min(F.struct("doc_id", "key")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    reps = stored(reps, "sets")
    clusters = components(candidates(reps, cell), "clusters")
    placed = clusters.select(F.col("node").alias("fp"), F.col("component").alias("cluster")).join(reps.select("fp", "of", "n"), "fp")
    sizes = placed.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / cell, F.sum("n") * 8 / CELL_BYTES)).alias("chunks")
    )
    placed = placed.join(sizes, "cluster").select(
        "cluster", "chunks", "fp", F.col("of.doc_id").alias("of_id"), F.col("of.key").alias("of_key")
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    sets = stored(with_sets(docs.join(placed, same).select("cluster", "chunks", "fp", "text")), "members")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    first = stored(confirmed(sets.withColumn("chunk", chunk), ["cluster", "chunk"], percent), "links")
    parted = sets.where("chunks > 1")
    if parted.isEmpty():
        return first
    label = components(first, "parts").select(F.col("node").alias("fp"), "component")
    members = stored(
        parted.select("cluster", "chunks", "fp").join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "parted"
    )
    held = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = held.groupBy("cluster").agg(F.max(F.struct("held", "component")).alias("top")).select("cluster", F.col("top.component").alias("largest"))
    rest = members.join(largest, "cluster").where("component <> largest")
    blocks = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / cell).alias("blocks"))
    rest = rest.join(blocks, "cluster").select(
        "fp", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    )
    others = members.join(blocks, "cluster").select(
        "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk")
    )
    cells = rest.union(others).distinct().join(parted.select("cluster", "fp", "members"), "fp")
    return first.union(stored(confirmed(cells, ["cluster", "block", "chunk"], percent), "links"))


def judged(documents: DataFrame, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """``doc_id, key, n, component_id`` of every row."""
    docs = text_of(documents).select("doc_id", row_key().alias("key"), "text")
    known = stored(features(docs), "features")
    label = components(links(docs, known, percent, cell), "components").select(F.col("node").alias("fp"), "component")
    rows = known.select("doc_id", "key", "n", "fp").join(label, "fp", "left").select("doc_id", "key", "n", F.coalesce("component", "fp").alias("component"))
    rows = stored(rows, "labelled")
    # a table of its own, so that Spark can split the rows of a component of any size when it joins them
    least = stored(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    full = rows.where("n > 0").join(least, "component").select("doc_id", "key", "n", "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id")))


def near_duplicates(documents: DataFrame, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``documents``.

    Texts without words have no shingles and are linked with nothing. Rows with
    one shingle set, exact copies above all, are one node from the start. Rows
    with a null doc_id link like others but never give a component its id; where
    a component has no other rows its id is null, and they are kept.
    """
    out = judged(documents, percent, cell)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, with all its columns.

    Texts without words all stay. Of rows that share doc_id and text one stays,
    whichever it is. The list of what goes is counted: up to ``BROADCAST_ROWS`` rows (16
    bytes each) it is sent to the texts, beyond that Spark joins as it sees fit.
    """
    found = stored(judged(documents).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "judged")
    goes = found.where("not kept").select(F.col("doc_id").alias("goes_id__"), F.col("key").alias("goes_key__")).distinct()
    goes = stored(goes, "goes")
    if goes.count() <= BROADCAST_ROWS:
        goes = F.broadcast(goes)
    doc_id, key = documents["doc_id"].cast("long"), F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    out = documents.join(goes, doc_id.eqNullSafe(F.col("goes_id__")) & (key == F.col("goes_key__")), "left_anti")
    several = found.where("kept and n > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("more_id__"), F.col("key").alias("more_key__"))
    several = stored(several.agg(F.count(F.lit(1)).alias("rows__")).where("rows__ > 1").drop("rows__"), "several")
    if several.isEmpty():
        return out
    again = (out["doc_id"].cast("long") == F.col("more_id__")) & (F.xxhash64(F.coalesce(out["text"], F.lit(""))) == F.col("more_key__"))
    return out.join(several, again, "left_anti").unionByName(out.join(several, again, "left_semi").dropDuplicates(["doc_id", "text"]))
