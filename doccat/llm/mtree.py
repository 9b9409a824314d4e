"""Exact top-k by inner product: M-trees of paged metric nodes, searched best first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.blobs import groups_of
from doccat.llm.common import stored

K, EVERY, SCALE = 5, 50, 256
#: Distinct vectors for each routing object of the top, and objects at most: 4096 of 1024 numbers are 32 MB to broadcast.
PER_OBJECT, MOST_OBJECTS = 1000, 4096
#: Vectors of a tree and entries of a page at most, and queries that visit a tree in one task.
TREE_ROWS, PAGE, VISITORS = 4096, 64, 2048
#: Squared lengths up to here keep every score within a long.
MOST_SQUARE = 2.0**62 * (1 - 1e-9)


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, node, vec`` of each row that takes part: floor(scale * x) as int64 bytes and a digest of them; repeated rows once."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values = lists.flatten()
            whole = values.is_valid().to_numpy(zero_copy_only=False)
            x = np.floor(values.fill_null(0).to_numpy(zero_copy_only=False) * float(scale))
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.concatenate([[0], np.cumsum(np.where(np.isfinite(x), x, 0) ** 2)])
            whole &= np.isfinite(x) & (np.abs(x) < 2.0**31.5)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            good = np.concatenate([[0], np.cumsum(~whole)])
            fine = (good[ends] == good[starts]) & ~(square[ends] - square[starts] > MOST_SQUARE)
            fine &= lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            data = np.where(whole, x, 0).astype(np.int64)
            vecs = [data[a:z].tobytes() for a, z in zip(starts[fine], ends[fine], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(fine)), pa.array([hashlib.md5(v).digest() for v in vecs], pa.binary()), pa.array(vecs, pa.binary())],
                names=["vec_id", "node", "vec"],
            )

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(compute, "vec_id long, node binary, vec binary").distinct()


def matrix(vecs: list[bytes]) -> np.ndarray:
    """Vectors of one dimension as rows: float64 where all inner products are exact in it, or else int64."""
    x = np.frombuffer(b"".join(vecs), np.int64).reshape(len(vecs), len(vecs[0]) // 8)
    small = x.astype(float)
    return small if not x.size or (small * small).sum(axis=1).max() < 2.0**52 else x


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``x`` with ``y``, which may be of either kind."""
    if x.dtype != y.dtype:
        x, y = x.astype(np.int64), y.astype(np.int64)
    return x @ y


# --- trees ------------------------------------------------------------------------

class Space:
    """Distances in which the nearest vector has the greatest inner product.

    A vector of length |x| gets a further component sqrt(top - |x|^2), a query a
    zero: then |q - x|^2 = |q|^2 + top - 2 q.x. ``top`` is the greatest squared length.
    """

    def __init__(self, x: np.ndarray):
        self.x = x.astype(float)
        self.square = (self.x * self.x).sum(axis=1)
        self.top = float(self.square.max())
        self.more = np.sqrt(np.maximum(0, self.top - self.square))

    def between(self, rows: np.ndarray, one: int) -> np.ndarray:
        away = self.square[rows] + self.square[one] - 2 * (self.x[rows] @ self.x[one]) + (self.more[rows] - self.more[one]) ** 2
        return np.sqrt(np.maximum(0, away))


def middle(space: Space, rows: np.ndarray) -> int:
    """The vector nearest to the mean."""
    mean = space.x[rows].mean(axis=0)
    return int(rows[(space.square[rows] - 2 * (space.x[rows] @ mean)).argmin()])


def pages_of(space: Space, most: int = PAGE) -> list[dict]:
    """Pages of an M-tree, the root first. An entry is a vector, or a page with its pivot and covering radius.

    Each entry has its distance to the pivot of the page it stands in. Members
    go to the nearest of a page's pivots, which are spread evenly over them.
    """
    pages: list[dict] = []

    def grown(rows: np.ndarray, pivot: int) -> int:
        number = len(pages)
        far = space.between(rows, pivot)
        page = {"pivot": pivot, "radius": float(far.max()), "leaf": len(rows) <= most}
        pages.append(page)
        if page["leaf"]:
            page |= {"rows": rows, "far": far, "child": np.zeros(len(rows), np.int32), "radii": np.zeros(len(rows))}
            return number
        count = min(most, -(-2 * len(rows) // most))
        chosen = rows[np.linspace(0, len(rows) - 1, count).astype(int)]
        nearest = np.argmin([space.between(rows, int(c)) for c in chosen], axis=0)
        if (nearest == nearest[0]).all():
            nearest = np.arange(len(rows)) * count // len(rows)
        parts = [rows[nearest == c] for c in range(count) if (nearest == c).any()]
        pivots = np.array([middle(space, p) for p in parts])
        child = np.array([grown(p, int(m)) for p, m in zip(parts, pivots, strict=True)], np.int32)
        radii = np.array([pages[c]["radius"] for c in child])
        page |= {"rows": pivots, "far": space.between(pivots, pivot), "child": child, "radii": radii}
        return number

    every = np.arange(len(space.x))
    grown(every, middle(space, every))
    return pages


PAGES = (
    "shard long, part long, page int, leaf boolean, top double, pivot binary, radius double, vecs array<binary>, nodes array<binary>, "
    "least array<long>, child array<int>, far array<double>, radii array<double>"
)


def trees(placed: DataFrame) -> DataFrame:
    """The pages of all trees, a row each, from ``shard, part, node, vec, least``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["shard", "part"]):
            vecs = np.array(group.column("vec").to_pylist() + [None], object)[:-1]
            nodes = np.array(group.column("node").to_pylist() + [None], object)[:-1]
            least = group.column("least").to_numpy()
            space = Space(matrix(vecs.tolist()))
            shard, part = group.column("shard")[0].as_py(), group.column("part")[0].as_py()
            for number, page in enumerate(pages_of(space)):
                rows, leaf = page["rows"], page["leaf"]
                yield pa.RecordBatch.from_pylist(
                    [{
                        "shard": shard, "part": part, "page": number, "leaf": leaf, "top": space.top, "pivot": vecs[page["pivot"]],
                        "radius": page["radius"], "vecs": vecs[rows].tolist(), "nodes": nodes[rows].tolist() if leaf else [],
                        "least": least[rows].tolist() if leaf else [], "child": page["child"].tolist(), "far": page["far"].tolist(),
                        "radii": page["radii"].tolist(),
                    }],
                    schema=kinds,
                )

    kinds = pa.schema([
        ("shard", pa.int64()), ("part", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("top", pa.float64()), ("pivot", pa.binary()),
        ("radius", pa.float64()), ("vecs", pa.list_(pa.binary())), ("nodes", pa.list_(pa.binary())), ("least", pa.list_(pa.int64())),
        ("child", pa.list_(pa.int32())), ("far", pa.list_(pa.float64())), ("radii", pa.list_(pa.float64())),
    ])
    rows = placed.select("shard", "part", "node", "vec", "least").repartition("shard", "part")
    return rows.sortWithinPartitions("shard", "part", "node").mapInArrow(compute, PAGES)


class Tree:
    """The pages of one tree, ready to be searched; ``computed`` counts the inner products that searches needed."""

    def __init__(self, pages: list[dict]):
        self.pages = {p["page"]: p | {k: np.array(p[k]) for k in ("least", "child", "far", "radii")} | {"x": matrix(p["vecs"])} for p in pages}
        root = self.pages[0]
        self.pivot, self.radius, self.top, self.computed = matrix([root["pivot"]]), root["radius"], root["top"], 0
        self.nodes = [n for p in self.pages.values() for n in p["nodes"]]
        first = 0
        for p in self.pages.values():
            p["first"] = first
            first += len(p["nodes"])

    def best(self, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry of ``nodes``, score): the ``k`` best vectors of each query, none below its floor; ties go to the smaller ``least``.

        Each query opens its waiting page of the greatest score that it may
        hold, all queries at a time, and those that open the same page share its
        entries. An entry whose distance to the pivot of its page tells that it
        is too far, with its radius, is passed over without an inner product.
        """
        q, n = queries.astype(float), len(queries)
        whole = (q * q).sum(axis=1) + self.top
        slack = 1e-9 * whole + 1e-6
        limit = floors.astype(float)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, entry, score, least
        away = np.sqrt(np.maximum(0, whole - 2 * dot(queries, self.pivot[0]).astype(float)))
        self.computed += n
        bound = (whole - np.maximum(0, away - self.radius) ** 2) / 2 + slack
        waiting = (np.arange(n), np.zeros(n, np.int64), bound, away)
        while len(waiting[0]):
            waiting = tuple(c[waiting[2] >= limit[waiting[0]]] for c in waiting)
            order = np.lexsort((-waiting[2], waiting[0]))
            waiting = tuple(c[order] for c in waiting)
            now = np.ones(len(order), bool)
            now[1:] = waiting[0][1:] != waiting[0][:-1]
            asked, opened, _, distance = (c[now] for c in waiting)
            later, fresh = [tuple(c[~now] for c in waiting)], [held]
            for number in np.unique(opened).tolist():
                page, own = self.pages[number], asked[opened == number]
                gap = np.maximum(0, np.abs(distance[opened == number][:, None] - page["far"]) - page["radii"])
                fits = (whole[own, None] - gap**2) / 2 + slack[own, None] >= limit[own, None]
                rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
                if not len(rows):
                    continue
                scores = dot(queries[own[rows]], page["x"][columns].T)
                self.computed += scores.size
                own = own[rows]
                if page["leaf"]:
                    r, c = np.nonzero(scores >= limit[own, None])
                    fresh.append((own[r], page["first"] + columns[c], scores[r, c].astype(np.int64), page["least"][columns[c]]))
                    continue
                far = np.sqrt(np.maximum(0, whole[own, None] - 2 * scores.astype(float)))
                most = (whole[own, None] - np.maximum(0, far - page["radii"][columns]) ** 2) / 2 + slack[own, None]
                r, c = np.nonzero(most >= limit[own, None])
                later.append((own[r], page["child"][columns[c]].astype(np.int64), most[r, c], far[r, c]))
            if len(fresh) > 1:
                held = tuple(np.concatenate(c) for c in zip(*fresh, strict=True))
                order = np.lexsort((held[1], held[3], -held[2], held[0]))
                held = tuple(c[order] for c in held)
                place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
                held = tuple(c[place < k] for c in held)
                last = np.flatnonzero(place[place < k] == k - 1)
                limit[held[0][last]] = np.maximum(limit[held[0][last]], held[2][last])
            waiting = tuple(np.concatenate(c) for c in zip(*later, strict=True))
        return held[0], held[1], held[2]


# --- search -----------------------------------------------------------------------

FOUND = "query binary, node binary, score long"


def visited(visits: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """``query, node, score``: the ``k`` best vectors of each tree that a query visits; ``visits`` has ``shard, part, query, vec, floor``.

    At most some ``VISITORS`` queries of a tree share a task, so a tree that all want is searched by many.
    """
    tasks = stored(visits.groupBy("shard", "part").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("chunks")), "visits")
    chunk = F.pmod(F.xxhash64("query"), F.col("chunks")).alias("chunk")
    asking = visits.join(tasks, ["shard", "part"]).select("shard", "part", chunk, "query", "vec", "floor")
    asked = pages.join(tasks, ["shard", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.binary()), "node": pa.array([], pa.binary()), "score": pa.array([], pa.int64())})
        tree, names = Tree(right.to_pylist()), np.array(left.column("query").to_pylist() + [None], object)
        floors = np.array([-np.inf if f is None else f for f in left.column("floor").to_pylist()])
        query, entry, score = tree.best(matrix(left.column("vec").to_pylist()), k, floors)
        nodes = np.array([*tree.nodes, None], object)
        return pa.table({"query": pa.array(names[query], pa.binary()), "node": pa.array(nodes[entry], pa.binary()), "score": pa.array(score, pa.int64())})

    keys = ["shard", "part", "chunk"]
    return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, FOUND)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` other rows of greatest integer inner product, for each row whose vec_id ``every`` divides.

    Vectors are floor(scale * x). Each goes to the nearest of some routing
    objects, a sample of the vectors; what an object gets is a tree, or several
    if it is much. A query searches the tree it lies in, and then, with the
    score reached there, all trees that may hold as much by their objects'
    radii. So the result is exact; pages that can't reach it are not opened.

    Equal vectors are one entry of a tree and are told apart at the end. Ties go
    to the smaller vec_id; a query with fewer other rows gets all of them. Rows
    that repeat as a whole count once. Vectors that are null or hold null or
    non-finite components, have a null vec_id or are so long that a score would
    not fit a long take no part; vectors of different dimensions have no score.
    An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = stored(integers(embeddings, scale), "vectors")
    nodes = stored(rows.groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.max((F.col("vec_id") % every == 0)).alias("asks")), "nodes")
    objects = nodes.orderBy(F.xxhash64("node"), "node").limit(int(min(MOST_OBJECTS, max(1, nodes.count() // PER_OBJECT)))).select("vec").toArrow()
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    vecs = objects.column("vec").to_pylist()
    for width in {len(v) for v in vecs}:
        numbers = np.array([i for i, v in enumerate(vecs) if len(v) == width])
        by_width[width] = numbers, matrix([vecs[i] for i in numbers]).astype(float)
    shared = spark.sparkContext.broadcast(by_width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("vec").to_pylist()
            widths = np.array([len(v) for v in own], np.int64)
            shard, away = -1 - widths, np.zeros(len(own))
            for width, (numbers, centres) in shared.value.items():
                at = np.flatnonzero(widths == width)
                if len(at):
                    x = matrix([own[i] for i in at]).astype(float)
                    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
                    near = far.argmin(axis=1)
                    shard[at], away[at] = numbers[near], np.sqrt(np.maximum(0, far[np.arange(len(at)), near]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(away)], names=[*batch.schema.names, "shard", "away"])

    placed = stored(nodes.mapInArrow(assign, "node binary, vec binary, least long, asks boolean, shard long, away double"), "placed")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).alias("parts"), F.max("away").alias("radius"))
    sizes = stored(sizes, "shards")
    placed = placed.join(sizes.drop("radius"), "shard").withColumn("part", F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")))
    placed = stored(placed.select("shard", "part", "node", "vec", "least", "asks"), "parts")
    pages = stored(trees(placed), "pages")

    queries = placed.where("asks").select("shard", "part", F.col("node").alias("query"), "vec")
    first = stored(visited(queries.withColumn("floor", F.lit(None).cast("long")), pages, k + 1), "first")
    floors = first.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
    radii = np.zeros(len(vecs))
    for row in sizes.where("shard >= 0").toArrow().to_pylist():  # a row for each routing object
        radii[row["shard"]] = row["radius"]
    covering = spark.sparkContext.broadcast(radii)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("vec").to_pylist()
            widths = np.array([len(v) for v in own], np.int64)
            floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()], float)
            for width, (numbers, centres) in shared.value.items():
                at = np.flatnonzero(widths == width)
                for i in range(0, len(at), 512):
                    some = at[i : i + 512]
                    q = matrix([own[j] for j in some]).astype(float)
                    size = np.sqrt((q * q).sum(axis=1))[:, None]
                    most = q @ centres.T + size * covering.value[numbers]
                    slack = 1e-9 * size * (np.sqrt((centres * centres).sum(axis=1)) + covering.value[numbers]) + 1e-6
                    row, place = np.nonzero(most + slack >= floor[some][:, None])
                    part = batch.take(pa.array(some[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[place]), *part.columns], names=["shard", *part.schema.names])
            # a dimension without routing objects has one shard of its own
            rest = ~np.isin(widths, list(shared.value))
            if rest.any():
                part = batch.filter(pa.array(rest))
                yield pa.RecordBatch.from_arrays([pa.array(-1 - widths[rest]), *part.columns], names=["shard", *part.schema.names])

    asking = queries.withColumnsRenamed({"shard": "own_shard", "part": "own_part"}).join(floors, "query").select("query", "vec", "floor", "own_shard", "own_part")
    routed = asking.mapInArrow(route, "shard long, query binary, vec binary, floor long, own_shard long, own_part long")
    more = routed.join(sizes.select("shard", "parts"), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    more = more.where("not (shard = own_shard and part = own_part)").select("shard", "part", "query", "vec", "floor")
    second = stored(visited(stored(more, "routed"), pages, k + 1), "second")

    ids = rows.select("node", "vec_id").withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    every_row = first.union(second).join(ids.drop("nth"), "node")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "node")
    best = every_row.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score", "node"))).alias("best"))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    others = F.filter("best", lambda r: ~((r["vec_id"] == F.col("query_id")) & (r["node"] == F.col("query"))))
    out = asked.join(lists, "query").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "one"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
