"""Embedding near-dedup: a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.blobs import groups_of
from doccat.llm.common import stored
from doccat.llm.components import components

COSINE = 0.95
#: Vectors of the sample that centres are fitted on, and centres at most: 4096 of 1024 numbers are 16 MB to broadcast.
SAMPLE, MOST_CENTRES = 20_000, 4096
#: Distinct vectors per centre, shards that each vector goes to, and members from which a shard is clustered again.
TARGET, OVERLAP, MOST_MEMBERS = 500, 3, 6000
LEVELS = 4
#: Graph: candidates looked at, edges kept, slack of pruning; search: nodes held.
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 32
#: Recall that the audit wants; below it the search is done again with twice the overlap and beam.
RECALL = 0.98
#: Audit: one vector in so many is asked, vectors at least, and so many planted ones; vectors compared at a time, in bytes.
AUDIT_SHARE, AUDIT_QUERIES, PLANTED, BLOCK_BYTES = 50, 512, 256, 8_000_000


def classes(embeddings: DataFrame) -> DataFrame:
    """``vec_id, node, vec``: the vector as float64 bytes and its digest; both null where it can link with nothing."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, nodes = [], []
            for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                good = vec_id is not None and value and None not in value
                x = np.array(value, float) + 0.0 if good else np.zeros(0)
                good = good and bool(np.isfinite(x).all()) and bool(x.any())
                vecs.append(x.tobytes() if good else None)
                nodes.append(hashlib.md5(x.tobytes()).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "node", "vec"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(compute, "vec_id long, node binary, vec binary")


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of length 1, double precision; scaled first, so that none overflows."""
    values = column.to_pylist()
    x = np.frombuffer(b"".join(values), float).reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from rows spread evenly over the sample; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        label = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        for c in np.unique(label):
            total = x[label == c].sum(axis=0)
            centres[c] = total / max(1e-12, float(np.sqrt((total * total).sum())))
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, overlap: int) -> np.ndarray:
    overlap = min(overlap, len(centres))
    out = []
    for i in range(0, len(x), 4096):
        sims = x[i : i + 4096].astype(np.float32) @ centres.T
        out.append(np.argpartition(-sims, overlap - 1, axis=1)[:, :overlap] if overlap < len(centres) else np.tile(np.arange(len(centres)), (len(sims), 1)))
    return np.concatenate(out)


def sharded(vectors: DataFrame, overlap: int, most: int = MOST_MEMBERS, target: int = TARGET) -> DataFrame:
    """``shard, node, vec``: every vector in the shards of its ``overlap`` nearest centres.

    Vectors of different dimensions never share a shard. A shard of more than
    ``most`` members is clustered again on a sample of its own; what cannot be
    parted in four rounds stays as it is and is not dropped.
    """
    spark = vectors.sparkSession
    shards = []
    for row in vectors.groupBy(F.octet_length("vec").alias("width")).count().collect():
        own = vectors.where(F.octet_length("vec") == row.width)
        k = int(min(MOST_CENTRES, max(1, row["count"] // target)))
        sample = own.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").toArrow()
        centres = spark.sparkContext.broadcast(k_means(units(sample.column("vec")), k))

        def assign(batches: Iterator[pa.RecordBatch], width=row.width, centres=centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = nearest(units(batch.column("vec")), centres.value, overlap)
                take = np.repeat(np.arange(batch.num_rows), near.shape[1])
                part = batch.take(pa.array(take))
                names = pa.array([f"{width}/{c}" for c in near.ravel()])
                yield pa.RecordBatch.from_arrays([names, part.column("node"), part.column("vec")], names=["shard", "node", "vec"])

        shards.append(own.select("node", "vec").mapInArrow(assign, "shard string, node binary, vec binary"))
    if not shards:
        return vectors.select(F.lit("").alias("shard"), "node", "vec").where(F.lit(False))
    out = shards[0]
    for more in shards[1:]:
        out = out.union(more)
    out = stored(out, "shards")
    for _ in range(LEVELS):
        large = stored(out.groupBy("shard").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most), "large")
        if large.isEmpty():
            break
        rows = out.join(large, "shard")
        picked = rows.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / 2000)) == 0).repartition("shard").sortWithinPartitions("shard")

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups_of(batches, ["shard"]):
                held = group.column("held")[0].as_py()
                centres = k_means(units(group.column("vec")), int(min(64, max(2, held // target))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group.column("shard")[0].as_py()]), pa.array([centres.tobytes()], pa.binary()), pa.array([len(centres)])], names=["shard", "centres", "k"]
                )

        fitted = stored(picked.select("shard", "vec", "held").mapInArrow(fit, "shard string, centres binary, k long"), "centres")
        salt = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("held") / 20_000))
        members = rows.select("shard", salt.alias("salt"), "node", "vec")
        known = fitted.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("held") / 20_000) - 1)).alias("salt"), "centres", "k")

        def reassign(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"shard": pa.array([], pa.string()), "node": pa.array([], pa.binary()), "vec": pa.array([], pa.binary())})
            k = right.column("k")[0].as_py()
            near = nearest(units(left.column("vec")), np.frombuffer(right.column("centres")[0].as_py(), np.float32).reshape(k, -1), overlap)
            part = left.take(pa.array(np.repeat(np.arange(left.num_rows), near.shape[1])))
            names = [f"{s}/{c}" for s, c in zip(part.column("shard").to_pylist(), near.ravel(), strict=True)]
            return pa.table({"shard": pa.array(names), "node": part.column("node"), "vec": part.column("vec")})

        finer = members.groupBy("shard", "salt").cogroup(known.groupBy("shard", "salt")).applyInArrow(reassign, "shard string, node binary, vec binary")
        out = stored(out.join(large, "shard", "left_anti").union(finer), "shards")
    return out


def parts_of(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component; every edge is given in both directions."""
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, source, label[target])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def connected(y: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Edges (source * n + target) with more of them until the graph is one: each row gets one to its nearest row of another component."""
    n = len(y)
    while True:
        part = parts_of(n, pairs // n, pairs % n)
        if not part.any():
            return pairs
        outer = np.empty(n, np.int64)
        for i in range(0, n, 512):
            sims = y[i : i + 512] @ y.T
            sims[part[i : i + 512, None] == part] = -3
            outer[i : i + 512] = sims.argmax(axis=1)
        pairs = np.unique(np.concatenate([pairs, np.arange(n) * n + outer, outer * n + np.arange(n)]))


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Each row's edges: its nearest candidates, without those that a kept one is nearer to by the factor ``ALPHA``; and back.

    Where groups of rows have all their candidates among themselves, edges between them make the graph one.
    """
    n = len(x)
    size = min(CANDIDATES, n - 1)
    if size < 1:
        return [np.zeros(0, np.int64)] * n
    y = x.astype(np.float32)
    sources, targets = [], []
    for i in range(0, n, 512):
        sims = y[i : i + 512] @ y.T
        rows = np.arange(len(sims))
        sims[rows, rows + i] = -2
        near = np.argpartition(-sims, size - 1, axis=1)[:, :size]
        own = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-own, axis=1)
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        away = np.sqrt(np.maximum(0, 2 - 2 * own))
        vectors = y[near]
        between = ALPHA * np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))))
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for c in range(size):
            now = alive[:, c] & (kept.sum(axis=1) < DEGREE)
            kept[:, c] = now
            alive &= ~(now[:, None] & (between[:, c, :] <= away))
        row, place = np.nonzero(kept)
        sources.append(row + i)
        targets.append(near[row, place])
    source, target = np.concatenate(sources), np.concatenate(targets)
    pairs = connected(y, np.unique(np.concatenate([source * n + target, target * n + source])))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def in_range(x: np.ndarray, starts: np.ndarray, edges: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of cosine ``cosine`` or more, found by searching the graph for every row, all rows at a time.

    ``starts`` and ``edges`` are the adjacency lists, one after the other, of a
    connected graph. Greedy search from the medoid and from the row's own node
    holds the ``beam`` best nodes until all of them have been expanded; then nodes
    in range are expanded as long as new ones turn up.
    """
    n, y = len(x), x.astype(np.float32)
    degree = np.diff(starts)
    slack = np.float32(1e-4)

    def neighbours(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen neighbours of nodes, each once a query, with their cosines."""
        count = degree[node]
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        to = edges[np.arange(ends[-1]) + np.repeat(starts[node] - ends + count, count)]
        asked = np.repeat(query, count)
        new = ~seen[asked, to]
        pairs = np.unique(asked[new] * n + to[new])
        asked, to = pairs // n, pairs % n
        seen[asked, to] = True
        sims = np.empty(len(to), np.float32)
        for i in range(0, len(to), 100_000):
            sims[i : i + 100_000] = np.einsum("ij,ij->i", y[asked[i : i + 100_000]], y[to[i : i + 100_000]])
        return asked, to, sims

    found: list[np.ndarray] = []
    medoid = int((y @ y.mean(axis=0)).argmax())
    for first in range(0, n, 2048):
        asking = np.arange(first, min(n, first + 2048))
        seen = np.zeros((n, n), bool) if n <= 2048 else None
        if seen is None:
            seen = np.zeros((first + len(asking), n), bool)
        size = max(2, min(beam, n))
        held = np.full((len(asking), size), -1)
        score = np.full((len(asking), size), -3, np.float32)
        done = np.ones((len(asking), size), bool)
        held[:, 0], score[:, 0], done[:, 0] = medoid, y[asking] @ y[medoid], False
        seen[asking, medoid] = True
        own = np.flatnonzero(asking != medoid)
        held[own, 1], score[own, 1], done[own, 1] = asking[own], 1, False
        seen[asking, asking] = True
        hits = [(asking, np.full(len(asking), medoid), score[:, 0].copy())]
        while not done.all():
            best = np.where(done, -4, score).argmax(axis=1)
            rows = np.flatnonzero(~done[np.arange(len(asking)), best])
            done[rows, best[rows]] = True
            asked, to, sims = neighbours(asking[rows], held[rows, best[rows]])
            near = sims >= cosine - slack
            hits.append((asked[near], to[near], sims[near]))
            if not len(asked):
                continue
            # put the new nodes beside the held ones and keep the best
            row = asked - first
            heads = np.searchsorted(row, np.arange(len(asking) + 1))
            width = int(np.diff(heads).max())
            more, more_score = np.full((len(asking), width), -1), np.full((len(asking), width), -3, np.float32)
            place = np.arange(len(row)) - heads[row]
            more[row, place], more_score[row, place] = to, sims
            all_held, all_score = np.concatenate([held, more], axis=1), np.concatenate([score, more_score], axis=1)
            all_done = np.concatenate([done, more < 0], axis=1)
            keep = np.argpartition(-all_score, size - 1, axis=1)[:, :size]
            held, score, done = (np.take_along_axis(a, keep, axis=1) for a in (all_held, all_score, all_done))
        query, node = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        near = np.concatenate([h[2] for h in hits]) >= cosine - slack
        query, node = query[near], node[near]
        found.append(query * n + node)
        while len(query):
            fresh = []
            for i in range(0, len(query), 20_000):
                asked, to, sims = neighbours(query[i : i + 20_000], node[i : i + 20_000])
                near = sims >= cosine - slack
                fresh.append((asked[near], to[near]))
            query, node = np.concatenate([f[0] for f in fresh]), np.concatenate([f[1] for f in fresh])
            found.append(query * n + node)
    pairs = np.unique(np.concatenate(found))
    query, node = pairs // n, pairs % n
    exact = np.concatenate([np.einsum("ij,ij->i", x[query[i : i + 100_000]], x[node[i : i + 100_000]]) for i in range(0, len(query), 100_000)])
    good = (exact >= cosine) & (query != node)
    query, node = query[good], node[good]
    both = np.unique(np.concatenate([query * n + node, node * n + query]))
    return both // n, both % n


LINKED = "node binary, near array<binary>"


def close_pairs(x: np.ndarray, z: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and of ``z`` in range of each other, all compared a block at a time and confirmed in double precision."""
    out, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], max(1, 8_000_000 // max(1, len(z)))
    y, other = x.astype(np.float32), z.astype(np.float32).T
    for i in range(0, len(x), step):
        row, at = np.nonzero(y[i : i + step] @ other >= cosine - np.float32(1e-4))
        for j in range(0, len(row), 100_000):
            r, a = row[j : j + 100_000] + i, at[j : j + 100_000]
            good = np.einsum("ij,ij->i", x[r], z[a]) >= cosine
            out.append((r[good], a[good]))
    return np.concatenate([r for r, _ in out]), np.concatenate([a for _, a in out])


def listed(row: np.ndarray, names: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    """``node, near``: for each row that occurs, the nodes that stand beside it."""
    order = np.argsort(row, kind="stable")
    row, others = row[order], others[order]
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    near = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), pa.array(others, pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(names[row[heads]], pa.binary()), near], names=["node", "near"])


def graph(shards: DataFrame) -> DataFrame:
    """``node, near``: adjacency lists of every shard's graph, united."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["shard"]):
            nodes = np.array(group.column("node").to_pylist(), object)
            lists = pruned(units(group.column("vec")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array([nodes[e].tolist() for e in lists], pa.list_(pa.binary()))], names=["node", "near"]
            )

    dealt = shards.repartition("shard").sortWithinPartitions("shard")
    each = dealt.mapInArrow(compute, LINKED)
    return each.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def searched(shards: DataFrame, united: DataFrame, cosine: float, beam: int) -> DataFrame:
    """``node, near``: all nodes found in range of each, confirmed in double precision."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["shard"]):
            names = group.column("node").to_pylist()
            place = {node: i for i, node in enumerate(names)}
            lists = [[place[e] for e in near if e in place] for near in group.column("near").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(e) for e in lists])])
            edges = np.array([e for own in lists for e in own], np.int64)
            query, node = in_range(units(group.column("vec")), starts, edges, cosine, beam)
            at, nodes = np.searchsorted(query, np.arange(len(names) + 1)), np.array(names, object)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[full], pa.binary()), pa.array([nodes[node[at[i] : at[i + 1]]].tolist() for i in full], pa.list_(pa.binary()))],
                    names=["node", "near"],
                )

    rows = shards.join(united, "node").select("shard", "node", "vec", "near")
    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    each = dealt.mapInArrow(compute, LINKED)
    return each.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def visited(
    vectors: DataFrame, shards: DataFrame, found: DataFrame, cosine: float, missed: DataFrame | None = None, most: int = 20_000
) -> DataFrame:
    """``node, near`` with the links across shards: every node is compared with all shards that hold one of its links.

    A node that is in range of a member of a shard it doesn't lie in visits that
    shard and is compared with all members there, which are more than the
    member's neighbours in the united graph. What is found sends nodes to
    further shards, until none has anywhere left to go. At most ``most``
    visitors of a shard share a task.

    Links that the search has ``missed`` send their nodes too, and shards that
    hold an end of one are compared with themselves.
    """
    placed = shards.select("node", "shard")
    every, seen, fresh = found, placed, found
    if missed is not None:
        ends = missed.select("node").union(missed.select(F.explode("near").alias("node"))).distinct()
        wanting = stored(placed.join(ends, "node", "left_semi").select("shard").distinct(), "wanting")
        members = placed.join(wanting, "shard", "left_semi").select("node", F.array("node").alias("near"))
        seen = placed.join(wanting, "shard", "left_anti").select("node", "shard")
        fresh = found.unionByName(members).unionByName(missed)
    while True:
        pairs = fresh.select("node", F.explode("near").alias("other"))
        reached = pairs.join(placed.withColumnRenamed("node", "other"), "other").select("node", "shard").distinct()
        visits = stored(reached.join(seen, ["node", "shard"], "left_anti"), "visits")
        if visits.isEmpty():
            return every.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        asked = stored(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")), "asked")
        salt = F.pmod(F.xxhash64("node", F.lit(4)), F.col("parts"))
        visitors = visits.join(asked, "shard").join(vectors.select("node", "vec"), "node").select("shard", salt.alias("salt"), "node", "vec")
        members = shards.join(asked, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), "node", "vec")

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"node": pa.array([], pa.binary()), "near": pa.array([], pa.list_(pa.binary()))})
            guests, hosts = (np.array(t.column("node").to_pylist(), object) for t in (left, right))
            row, at = close_pairs(units(left.column("vec")), units(right.column("vec")), cosine)
            different = guests[row] != hosts[at]
            row, at = row[different], at[different]
            return pa.Table.from_batches([listed(row, guests, hosts[at]), listed(at, hosts, guests[row])])

        fresh = stored(visitors.groupBy("shard", "salt").cogroup(members.groupBy("shard", "salt")).applyInArrow(compare, LINKED), "near")
        every, seen = every.unionByName(fresh), seen.unionByName(visits.select("node", "shard"))


def planted(vectors: DataFrame, most: int = PLANTED) -> DataFrame:
    """``node, vec``: copies of ``most`` vectors, each moved by a fifth of its length: cosine 0.979 or more with its original.

    An audit sees links by them in any table. Their nodes are longer than those of vectors.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vecs = batch.column("node").to_pylist(), []
            for node, vec in zip(nodes, batch.column("vec").to_pylist(), strict=True):
                x = units(pa.array([vec], pa.binary()))[0]
                noise = np.random.default_rng(list(node)).normal(size=len(x))
                vecs.append((x + 0.2 * noise / np.sqrt((noise * noise).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b"planted" + n for n in nodes], pa.binary()), pa.array(vecs, pa.binary())], names=["node", "vec"])

    chosen = vectors.select("node", "vec").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(most)
    return chosen.mapInArrow(move, "node binary, vec binary")


def is_planted(node: str | Column) -> Column:
    return F.octet_length(node) > 16


def compared(vectors: DataFrame, asked: DataFrame, cosine: float) -> DataFrame:
    """``node, near``: true links of the vectors ``asked``, each compared with all vectors.

    The vectors asked for are broadcast ``BLOCK_BYTES`` at a time, whatever their number.
    """
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("vec"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)) == block).select("node", "vec").toArrow()
        widths = np.array([len(v) for v in chosen.column("vec").to_pylist()])
        by_width = {}
        for width in set(widths.tolist()):
            own = chosen.filter(pa.array(widths == width))
            by_width[width] = np.array(own.column("node").to_pylist(), object), units(own.column("vec"))
        shared = vectors.sparkSession.sparkContext.broadcast(by_width)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.array([len(v) for v in batch.column("vec").to_pylist()])
                for width, (names, x) in shared.value.items():
                    part = batch.filter(pa.array(size == width))
                    if part.num_rows:
                        own = np.array(part.column("node").to_pylist(), object)
                        row, place = close_pairs(x, units(part.column("vec")), cosine)
                        different = names[row] != own[place]
                        yield listed(row[different], names, own[place[different]])

        part = stored(vectors.select("node", "vec").mapInArrow(compare, LINKED), "compared")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))


def judged(true: DataFrame, found: DataFrame) -> tuple[float | None, DataFrame]:
    """Share of the true links that the search has found, and what it has missed (``node, near``).

    The share is that over all links or the mean of the nodes, whichever is less; null if there is no link.
    """
    pairs = true.join(found.withColumnRenamed("near", "seen"), "node", "left")
    missed = pairs.select("node", F.size("near").alias("all"), F.array_except("near", F.coalesce("seen", F.array().cast("array<binary>"))).alias("near"))
    missed = stored(missed, "missed")
    hit = F.col("all") - F.size("near")
    row = missed.agg((F.sum(hit) / F.sum("all")).alias("links"), F.avg(hit / F.col("all")).alias("nodes")).first()
    return None if row.links is None else min(row.links, row.nodes), missed.where(F.size("near") > 0).select("node", "near")


def links(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, beam: int = BEAM, rounds: int = 3) -> tuple[DataFrame, float | None]:
    """``node, near`` for distinct vectors, and the recall of the last search; it is repeated with twice the overlap and beam while that is too low.

    The audit asks one vector in ``AUDIT_SHARE``, but ``AUDIT_QUERIES`` at least, and
    planted ones, which lie in the graph like all others and are not given out:
    tables of few links are judged by these. If the last search still falls
    short, the shards that hold an end of a missed link are compared with
    themselves, and the search goes on from there.
    """
    every = stored(vectors.select("node", "vec").unionByName(planted(vectors)), "searched")
    share = max(1, min(AUDIT_SHARE, vectors.count() // AUDIT_QUERIES))
    asked = every.where(is_planted("node") | (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(share)) == 0))
    true = stored(compared(every, asked, cosine), "audit")
    for more in range(rounds):
        shards = sharded(every, overlap << more)
        united = stored(graph(shards), "graph")
        found = stored(searched(shards, united, cosine, beam << more), "near")
        found = stored(visited(every, shards, found, cosine), "near")
        reached, missed = judged(true, found)
        if reached is None or reached >= RECALL:
            break
    else:
        found = stored(visited(every, shards, found, cosine, missed), "near")
    near = F.filter("near", lambda node: ~is_planted(node))
    return found.where(~is_planted("node")).select("node", near.alias("near")).where(F.size("near") > 0), reached


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall``, one row for each row of ``embeddings``.

    Equal vectors are one node of the graph and count as linked with each other.
    Vectors that are null, empty or zero, hold null or non-finite numbers, or have
    a null vec_id, link with nothing and are kept; vectors of different
    dimensions don't link. ``recall`` is the share of an audit's links that the
    search found, the same in all rows; null if no vector can link.
    """
    rows = stored(classes(embeddings), "vectors")
    vectors = stored(
        rows.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes"
    )
    found, reached = links(vectors, cosine)
    found = stored(found, "links")
    sizes = vectors.select(F.col("node").alias("other"), "copies")
    pairs = found.select("node", F.explode("near").alias("other"))
    linked = pairs.join(sizes, "other").groupBy("node").agg(F.sum("copies").alias("others"))
    # components need one edge of each node to every later one only
    label = components(pairs.where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b")), "components")
    joined = vectors.join(linked, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = stored(joined.select("node", "least", "copies", F.coalesce("others", F.lit(0).cast("long")).alias("others"), "component"), "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    each = joined.join(least, "component").select("node", (F.col("copies") - 1 + F.col("others")).alias("links"), "component_id")
    out = rows.select("vec_id", "node").join(each, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(reached).cast("double").alias("recall"),
    )
