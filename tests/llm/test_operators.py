"""Each operator against its plain version: given documents, odd ones, repeated rows, an empty table."""

from __future__ import annotations

import collections
import functools

import brute
import numpy as np
import pytest
from conftest import pairs, same_rows
from pyspark.sql import functions as F

from doccat.llm import anchors, decontaminate, flatgraph, langid, mixture, oddsketch, phrases, rans, secretscan, severity


@pytest.fixture(params=["documents", "odd", "repeated", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(params=["documents", "odd", "nothing"])
def distinct_docs(request):
    return request.getfixturevalue(request.param)


def test_secrets(docs):
    found = secretscan.digest(secretscan.scan(docs, F.col("source"), F.col("lang")))
    want = []
    for i, t in pairs(docs):
        spans = brute.secrets(t or "")
        kinds = collections.Counter(s[1] for s in spans)
        want.append((i, kinds[0], kinds[1], kinds[2], brute.sha(",".join(f"{k}:{a}:{z}" for a, _, z, k in spans))))
    same_rows(found, want, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def test_owned_and_copied_secrets(odd, spark):
    found = {r.doc_id: r for r in secretscan.digest(secretscan.scan(odd, F.col("source"), F.col("lang"))).collect()}
    assert "owned:" in found[24].spans and found[24].n_live >= 1
    assert found[23].spans.count("assign") == found[23].n_assign == 2
    many = spark.createDataFrame([(i, f"token=ABCDEFGH99 {i}", f"o{i}") for i in range(5)], "doc_id long, text string, source string")
    rows = secretscan.digest(secretscan.scan(many, F.col("source"), F.col("source"))).collect()
    assert all(r.n_copied == 1 and r.n_live == 0 for r in rows)


def test_many_spans(spark):
    text = " ".join(f"token={i:08d}é" for i in range(700))
    found = secretscan.digest(secretscan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), F.lit("o"), F.lit("r"))).first()
    assert found.base_sha256 == brute.sha(",".join(f"{k}:{a}:{z}" for a, _, z, k in brute.secrets(text)))


def test_bytes_removed(docs):
    same_rows(phrases.repeats_removed(docs), brute.bytes_removed(pairs(docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_words_removed(docs):
    same_rows(anchors.repeats_removed(docs), brute.words_removed(pairs(docs)), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_tokens(distinct_docs):
    import public_tokenizers

    want = brute.tokens(pairs(distinct_docs), public_tokenizers.path("byte_bpe_50k.json"))
    same_rows(rans.tokenised(distinct_docs), want, "doc_id", "start", "n_tokens", "ids_crc32")


def test_tokens_of_repeated_rows(repeated):
    rows = rans.tokenised(repeated).orderBy("start").collect()
    assert len(rows) == repeated.count()
    ends = np.cumsum([0, *(r.n_tokens for r in rows)])
    assert [r.start for r in rows] == ends[:-1].tolist()
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows)


def test_decoding_from_a_checkpoint():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 200_000).clip(0, 3000).astype(np.uint32)
    tokens, n = np.unique(ids, return_counts=True)
    coder = rans.Coder(tokens, rans.quantised(n))
    states, words, marks = coder.encode(ids, 64)
    assert (coder.decode(len(ids), 64, states, words) == ids).all()
    step = rans.CHECKPOINT * len(marks)
    assert (coder.decode(len(ids), 64, marks[-1][1:], words, int(marks[-1][0]), step) == ids[step * 64 :]).all()


@pytest.mark.parametrize("n", [[5], [1, 1, 1], [10**9, 1, 1, 1], list(range(1, 2000))])
def test_frequencies_fill_the_table(n):
    out = rans.quantised(np.array(n))
    assert out.sum() == 1 << rans.PRECISION and out.min() >= 1


def test_near_duplicates(distinct_docs):
    same_rows(oddsketch.near_duplicates(distinct_docs), brute.near(pairs(distinct_docs)), "doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_in_parts(documents):
    """Cells of two sets force every cluster into parts and the second round of checks."""
    same_rows(oddsketch.near_duplicates(documents, cell=2), brute.near(pairs(documents)), "doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_of_repeated_rows(repeated):
    rows = oddsketch.near_duplicates(repeated).collect()
    assert len(rows) == repeated.count()
    assert [r.kept for r in rows if r.doc_id == 1] == [True, True]
    assert not any(r.kept for r in rows if r.doc_id in (2, 3))
    assert all(r.component_id == 1 for r in rows if r.doc_id in (1, 2, 3))


def test_contamination(docs, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").union(
        spark.createDataFrame([(900, "One two"), (901, None), (902, "!!"), (903, "123")], "item_id long, text string")
    )
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = brute.contamination(pairs(docs), items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same_rows(decontaminate.digest(decontaminate.contamination(docs, bench)), want, *columns)


def test_contamination_by_several_automata(odd, documents, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    found = decontaminate.digest(decontaminate.contamination(documents, bench, most=2000))
    same_rows(found, brute.contamination(pairs(documents), items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_repeated_rows_stay_with_several_automata(repeated, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").union(
        spark.createDataFrame([(900, "One two"), (901, None), (903, "123")], "item_id long, text string")
    )
    items = [tuple(r) for r in bench.collect()]
    found = decontaminate.digest(decontaminate.contamination(repeated, bench, most=2000))
    want = brute.contamination(pairs(repeated), items)
    same_rows(found, want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Héllo, A-B  c!")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b C")], "item_id long, text string")
    (row,) = decontaminate.contamination(docs, bench).collect()
    raw = "Héllo, A-B  c!".encode()
    assert [raw[p.start : p.end].decode() for p in row.pieces] == ["A-B  c"]


def test_mixture(docs):
    rows = mixture.mix(docs).collect()
    source = collections.defaultdict(list)
    given = docs.select("doc_id", "text", "source").collect()
    for r in given:
        source[r.source].append(len(brute.WORD.findall(r.text or "")))
    assert len(rows) == len(given)
    if not rows:
        return
    want = brute.shares({s: sum(n) for s, n in source.items()})
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), abs=len(source))
    assert all(r.taken <= 3 * r.size for r in rows)
    of = {r.doc_id: r.source for r in given}
    for r in rows:
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sum(source[of[r.doc_id]])
    assert sorted(map(str, mixture.mix(docs).collect())) == sorted(map(str, rows))


def test_better_documents_come_first(spark):
    good, junk = "plain words of prose " * 5, "#$ %% && ** " * 5
    rows = [(i, good if i % 2 else junk, "b" if i < 400 else "a") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixture.mix(docs).where("doc_id >= 400").collect()
    odd, even = (sum(r.taken > 0 for r in taken if r.doc_id % 2 == k) for k in (1, 0))
    assert odd > 2 * even


def test_language(documents):
    rows = langid.language_id(documents).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == len(truth) and len(held) > 20
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(odd, repeated, nothing):
    rows = {r.doc_id: r for r in langid.language_id(odd).collect()}
    for i in (8, 9, 10, 14):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0)
    assert rows[1].lang_pred in ("en", "fr") and rows[19].lang_pred in ("en", "fr")
    assert langid.language_id(repeated).count() == repeated.count()
    assert langid.language_id(nothing).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}


def test_severity(spark, documents):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choice(words, 80).tolist()
        bad = i % 5 == 0
        if bad:
            for _ in range(1 + i % 7):
                text[rng.integers(80)] = ["vile", "foul"][i % 2]
        rows.append((i, " ".join(text)))
        if i < 500:
            labels.append((i, int(bad)))
    rows += [(600, "123 !! 45"), (601, "  \n "), (602, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in severity.severity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(out) == 603
    assert all(out[i].severity == out[i].p_toxic == 0 and not out[i].toxic for i in range(600, 603))
    right = np.mean([out[i].toxic == (i % 5 == 0) for i in range(500, 600)])
    assert right > 0.95
    mild = np.mean([out[i].severity for i in range(0, 600, 5) if i % 7 == 0])
    severe = np.mean([out[i].severity for i in range(0, 600, 5) if i % 7 == 6])
    assert severe > mild


def test_severity_without_labels(odd, nothing, spark):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    rows = severity.severity(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r.toxic for r in rows)
    assert severity.severity(nothing, labels).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")


def test_flat_graph(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[200:400] = x[0] + rng.normal(size=(200, 16)) * 0.12
    x[400:430] = x[1]
    rows = [(i, v.astype(np.float32).tolist(), 0, "x") for i, v in enumerate(x)]
    kept = np.array([r[1] for r in rows])
    kept /= np.sqrt((kept**2).sum(axis=1, keepdims=True))
    links = kept @ kept.T >= 0.95
    got = {r.vec_id: r for r in flatgraph.near_duplicates(vectors(spark, rows)).collect()}
    n = np.array([got[i].n_links for i in range(1500)])
    true = links.sum(axis=1) - 1
    assert (n <= true).all() and n.sum() >= 0.98 * true.sum()
    assert all(got[i].component_id == 1 for i in range(400, 430))


def test_flat_graph_clusters_large_shards_again(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(rng.normal(size=(900, 8)).astype(np.float32))]
    own = flatgraph.classes(vectors(spark, rows)).select("node", "vec")
    shards = flatgraph.sharded(own, 2, most=120, target=50)
    assert shards.select("node").distinct().count() == 900
    assert shards.groupBy("shard").count().agg(F.max("count")).first()[0] < 900


def jittered(groups: int, members: int, seed: int) -> np.ndarray:
    """Groups of near-copies, all within 0.95 of their group and far from the others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    x = np.repeat(centres / np.sqrt((centres**2).sum(axis=1, keepdims=True)), members, axis=0)
    x = x + rng.normal(size=x.shape) * 0.2 / 8
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def test_groups_of_near_copies_are_all_searched():
    x = jittered(25, 60, 6)
    lists = flatgraph.pruned(x)
    starts = np.concatenate([[0], np.cumsum([len(e) for e in lists])])
    query, node = flatgraph.in_range(x, starts, np.concatenate(lists), 0.95, flatgraph.BEAM)
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    assert true[query, node].all() and len(query) >= 0.98 * true.sum()


def test_a_group_over_many_shards_is_linked_across_them(spark, monkeypatch):
    """Twenty centres in one group of near-copies, two of them for each vector; the first search is taken as it is."""
    monkeypatch.setattr(flatgraph, "sharded", functools.partial(flatgraph.sharded, target=20))
    monkeypatch.setattr(flatgraph, "RECALL", 0)
    monkeypatch.setattr(flatgraph, "AUDIT_QUERIES", 64)
    x = jittered(1, 400, 7)
    own = flatgraph.classes(vectors(spark, [(i, v.tolist(), 0, "x") for i, v in enumerate(x.astype(np.float32))])).select("node", "vec")
    found, _ = flatgraph.links(own, overlap=2)
    true = (x @ x.T >= 0.95).sum() - len(x)
    assert found.agg(F.sum(F.size("near"))).first()[0] >= 0.98 * true


@pytest.mark.parametrize("members", [2, 60])
def test_what_the_search_misses_is_settled(spark, monkeypatch, members):
    """A search that finds nothing, on a table of few links and on one of many."""
    nothing = spark.createDataFrame([], flatgraph.LINKED)
    monkeypatch.setattr(flatgraph, "searched", lambda *_: nothing)
    x = np.concatenate([np.random.default_rng(8).normal(size=(1500, 64)), jittered(3, members, 9)])
    own = flatgraph.classes(vectors(spark, [(i, v.tolist(), 0, "x") for i, v in enumerate(x.astype(np.float32))])).select("node", "vec")
    near, recall = flatgraph.links(own, rounds=1)
    assert recall == 0
    found = near.agg(F.sum(F.size("near"))).first()[0]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert found == (x @ x.T >= 0.95).sum() - len(x)


@pytest.mark.parametrize(("rows", "groups"), [(500, 0), (2000, 5)])
def test_every_table_is_searched_through_the_graph(spark, monkeypatch, rows, groups):
    """Tables without links and with few of them: the first search is enough, and only what is asked is compared with all."""
    asked, searches = [], []
    compared, searched = flatgraph.compared, flatgraph.searched
    monkeypatch.setattr(flatgraph, "compared", lambda every, some, cosine: asked.append(some.count()) or compared(every, some, cosine))
    monkeypatch.setattr(flatgraph, "searched", lambda *given: searches.append(1) or searched(*given))
    x = np.concatenate([np.random.default_rng(10).normal(size=(rows, 64)), jittered(groups, 4, 11)])
    got = flatgraph.near_duplicates(vectors(spark, [(i, v.tolist(), 0, "x") for i, v in enumerate(x.astype(np.float32))])).collect()
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert len(searches) == 1 and len(asked) == 1 and asked[0] <= max(1024, rows // 3) + flatgraph.PLANTED
    assert {r.recall for r in got} == {got[0].recall} and got[0].recall >= 0.98
    assert [r.n_links for r in sorted(got)] == true.tolist()


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 0.0]
    rows = [
        (1, one, 0, None), (2, one, 1, None), (2, one, 1, None), (3, None, 0, None), (4, [], 0, None), (5, [0.0, 0.0], 0, None),
        (6, [float("nan"), 1.0], 0, None), (7, [None, 1.0], 0, None), (None, one, 0, None), (8, [1.0, 0.0, 0.0], 0, None), (9, [1e30, 0.0], 0, None),
    ]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in flatgraph.near_duplicates(vectors(spark, rows)).collect()))
    assert got == sorted([
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
        (-1, 0, None, True), (8, 0, 8, True), (9, 3, 1, False),
    ])
    assert flatgraph.near_duplicates(vectors(spark, [])).count() == 0
