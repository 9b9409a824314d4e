"""Top-k search, collocations and periodic runs against plain versions and SQL: given tables, odd rows, empty tables."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from compare import connect, difference
from conftest import same_rows
from pyspark.sql import functions as F

from doccat.llm import collocations, mtree, runs
from doccat.llm.hashing import mix
from doccat.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, node string, shard string, rank int"


@pytest.fixture(params=["documents", "odd", "repeated", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


# --- top-k ------------------------------------------------------------------------

def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", None, 7) for i, v in rows], VECTORS)


def test_top_k_of_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1, 180)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)]  # more copies than k, ids with and without a query among them
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(350, [0.0] * 4), (400, [1.0, 2.0]), (401, [2.0, 2.0]), (450, [3.0]), (500, []), (501, []), (-50, [-9.0, 8.0, 7.0, 1e6]), (-51, [1e5] * 4)]
    same_rows(mtree.top_k(vectors_of(spark, rows)), brute.best_rows(rows), "query_id", "rank", "vec_id", "score")


def test_top_k_of_long_vectors_and_repeated_rows(spark):
    rows = [(0, [2.0**21, 1.0]), (1, [2.0**21, 3.0]), (2, [-(2.0**21), 0.25]), (50, [2.0**20 + 1 / 256, 1.0])]
    same_rows(mtree.top_k(vectors_of(spark, rows + rows)), brute.best_rows(rows), "query_id", "rank", "vec_id", "score")
    far = [(100, [2.0**40, 0.0]), (101, [1e300, 0.0])]
    same_rows(mtree.top_k(vectors_of(spark, rows + far)), brute.best_rows(rows), "query_id", "rank", "vec_id", "score")


def test_top_k_over_many_trees(spark, monkeypatch):
    """Small trees, pages and tasks: several trees of an object, pages of three levels, many tasks of a tree."""
    for name, value in (("PER_OBJECT", 60), ("TREE_ROWS", 40), ("VISITORS", 7)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 6)), 0.01 * rng.normal(size=(300, 6)) + 1, rng.normal(size=(100, 6)) * 5])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    same_rows(mtree.top_k(vectors_of(spark, rows)), brute.best_rows(rows), "query_id", "rank", "vec_id", "score")


def test_no_vectors(spark):
    assert mtree.top_k(vectors_of(spark, [])).collect() == []
    assert mtree.top_k(vectors_of(spark, [(50, [1.0])])).collect() == []


def test_bounds_save_inner_products():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.floor(256 * (centres[rng.integers(0, 30, 2000)] + 0.05 * rng.normal(size=(2000, 16)))).astype(np.int64)
    vecs, space = [v.tobytes() for v in x], mtree.Space(x.astype(float))
    pages = [
        p | {
            "page": n, "top": space.top, "pivot": vecs[p["pivot"]], "vecs": [vecs[r] for r in p["rows"]],
            "nodes": [vecs[r] for r in p["rows"]] if p["leaf"] else [], "least": list(p["rows"]),
        }
        for n, p in enumerate(mtree.pages_of(space))
    ]
    for p in pages:
        below = [pages[c] for c in p["child"]] if not p["leaf"] else []
        assert all(len(b["far"]) <= mtree.PAGE for b in below)
    tree = mtree.Tree(pages)
    names = {v: i for i, v in enumerate(vecs)}
    want = [np.lexsort((np.arange(len(x)), -(x @ q)))[:6] for q in x[:50]]
    for group in (range(50), [7]):
        query, entry, score = tree.best(x[list(group)].astype(float), 6, np.full(len(group), -np.inf))
        got = [(group[i], names[tree.nodes[e]], s) for i, e, s in zip(query, entry, score, strict=True)]
        assert got == [(i, j, x[i] @ x[j]) for i in group for j in want[i]]
    assert tree.computed < 0.3 * 50 * len(x)


# --- collocations -----------------------------------------------------------------

COLLOCATION = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(df, **how):
    return brute.collocations([(r.lang, r.text) for r in df.select("lang", "text").collect()], **how)


def test_collocations(docs):
    same_rows(collocations.collocations(docs, least=3), plain(docs, least=3), *COLLOCATION)


def test_longer_phrases(documents):
    how = {"longest": 4, "least": 6, "covered": 70, "top": 50}
    same_rows(collocations.collocations(documents, **how), plain(documents, **how), *COLLOCATION)


@pytest.mark.parametrize(("sampled", "proposed", "bits"), [(0, 2, 2**27), (64, 1, 2**27), (64, 2**30, 2**27), (4, 2, 2**13)])
def test_any_sample_and_filter_give_the_same(documents, monkeypatch, sampled, proposed, bits):
    """An empty sample, the whole corpus, one that proposes nothing, filters that take nearly everything."""
    for name, value in (("SAMPLED", sampled), ("PROPOSED", proposed), ("MOST_BITS", bits), ("BUCKET_BYTES", 100_000)):
        monkeypatch.setattr(collocations, name, value)
    few = documents.where("doc_id < 60")
    same_rows(collocations.collocations(few, least=4), plain(few, least=4), *COLLOCATION)


def test_scores_past_64_bits(spark):
    counts = [(3, 7, 5), (10**13, 10**13, 10**13), (999_999_999_999_937, 10**15 - 1, 10**15 - 2), (5 * 10**12 + 1, 9 * 10**14 + 7, 8 * 10**14 + 3)]
    rows = spark.createDataFrame(counts, "a long, l long, r long").select("a", "l", "r", collocations.score("a", "l", "r").alias("score"))
    for a, left, right, score in rows.collect():
        assert score == 1_000_000 * a * a // (left * right)


def test_pieces_and_white_space(spark):
    texts = [("en", "Big  Dog\tran! big dog, ran\x0bbig dog ran.big dog")] * 10 + [(None, "big dog")] * 10 + [("", "big\x00 dog.")] * 10 + [("en", None)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    same_rows(collocations.collocations(df), plain(df), *COLLOCATION)
    found = {(r.lang, r.phrase): r.a for r in collocations.collocations(df).collect()}
    assert found["und", "big dog"] == 10 and found["", "big\x00 dog"] == 10


# --- runs -------------------------------------------------------------------------

DIGEST = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs(docs):
    found = runs.digest(runs.periodic_runs(runs.planted(docs)))
    rows = docs.select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 50_000]
    same_rows(found.join(docs.where("length(text) >= 50000").select("doc_id"), "doc_id", "left_anti"),
              [brute.run_digest(r.doc_id, brute.planted_words(r.doc_id, r.text)) for r in short], *DIGEST)
    assert found.count() == len(rows)


def test_runs_of_made_up_words():
    rng = random.Random(1)
    for _ in range(400):
        words, size, kinds = [], rng.randint(0, 140), rng.randint(1, 4)
        while len(words) < size:
            if rng.random() < 0.5:
                words += [rng.randint(0, kinds) for _ in range(rng.randint(1, 10))]
            else:
                words += ([rng.randint(0, kinds) for _ in range(rng.randint(1, 9))] * 12)[: rng.randint(1, 60)]
        hashes = mix(np.array(words, np.uint64) + np.uint64(9))
        found = runs.runs_of(hashes, np.zeros(len(words), np.int64))
        assert [tuple(r) for r in found.tolist()] == brute.runs(words)
    cut = runs.runs_of(mix(np.zeros(60, np.uint64)), np.arange(60) // 30)
    assert cut.tolist() == [[0, 30, 1], [30, 30, 1]]


def test_long_and_repetitive_texts(spark):
    texts = {1: "a " * 60_000, 2: "a b\n" * 30_000 + "c", 3: " ".join(str(k % 500) for k in range(60_000)), 4: "x " * 23, 5: "x " * 24}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(df).collect()}
    assert found == {1: [(0, 60_000, 1)], 2: [(0, 60_000, 2)], 3: [(0, 60_000, 500)], 4: [], 5: [(0, 24, 1)]}
    kept = {r.doc_id: r.collapsed for r in runs.periodic_runs(df).collect()}
    assert kept[1] == "a" and kept[2] == "a b c" and kept[5] == "x" and kept[4] == texts[4].strip()


def test_best_run_by_exact_exponent(spark):
    rows = [(1, [(0, 24, 8), (40, 30, 10), (80, 9, 3)]), (2, [(5, 31, 10), (50, 25, 8)]), (3, [])]
    df = spark.createDataFrame([(i, r, "") for i, r in rows], "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    best = {r.doc_id: (r.start, r.length, r.period, r.exponent_milli) for r in runs.digest(df.orderBy(F.col("doc_id"))).collect()}
    assert best == {1: (0, 24, 8, 3000), 2: (50, 25, 8, 3125), 3: (None, None, None, None)}
