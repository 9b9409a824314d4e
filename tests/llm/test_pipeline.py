"""The stages of the pipeline, each on its own input, and the whole run."""

from __future__ import annotations

import collections

import brute
import pytest
from conftest import pairs

import corpus_pipeline as P


@pytest.fixture(params=["documents", "odd", "repeated", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_stages_keep_the_columns(docs, spark, sf_dir):
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        out.count()


def test_language_stage(documents, spark, sf_dir):
    assert P.known_language(spark, documents, sf_dir).count() == documents.count()


def test_language_stage_rejects_texts_without_letters(odd, spark, sf_dir):
    left = {r.doc_id for r in P.known_language(spark, odd, sf_dir).collect()}
    assert not left & {8, 9, 10, 14} and {1, 2, 5, 19} <= left


def test_dedup_stage(documents, spark, sf_dir):
    left = {r.doc_id for r in P.one_of_each_group(spark, documents, sf_dir).collect()}
    assert left == {i for i, _, _, kept in brute.near(pairs(documents)) if kept}


def test_dedup_stage_on_repeated_rows(repeated, spark, sf_dir):
    left = collections.Counter(r.doc_id for r in P.one_of_each_group(spark, repeated, sf_dir).collect())
    assert left[1] == left[7] == left[11] == 1 and not left[2] + left[3]


def test_decontamination_stage(documents, spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id for r in P.free_of_benchmarks(spark, documents, sf_dir).collect()}
    assert left == {r[0] for r in brute.contamination(pairs(documents), items) if not r[-1]}


def test_mixture_stage(documents, spark, sf_dir):
    from doccat.llm.mixture import mix

    words = collections.Counter()
    for i, t in pairs(P.in_proportion(spark, documents, sf_dir)):
        words[i] += len(brute.WORD.findall(t))
    assert words == {r.doc_id: r.taken for r in mix(documents).collect() if r.taken}


def test_whole_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:], strict=False))


def test_components(spark):
    """Stars, chains, cycles and single links of hashed nodes, against a plain union-find."""
    import hashlib
    import random

    from doccat.llm.components import components

    rng = random.Random(8)
    node = lambda k: hashlib.md5(str(k).encode()).digest()
    pairs = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(200)] + [(2000 + k, 2000 + (k + 1) % 15) for k in range(15)]
    pairs += [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(150)] + [(1, 1), (4000, 4000), (0, 1)]
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(node(a)), root(node(b))))
            parent[y] = x
    links = spark.createDataFrame([(node(a), node(b)) for a, b in pairs], "a binary, b binary")
    found = {bytes(r.node): bytes(r.component) for r in components(links, "test").collect()}
    assert found == {x: root(x) for x in parent}
    assert components(links.limit(0), "test").isEmpty()
