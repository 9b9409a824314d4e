from __future__ import annotations

import math
import re

import pytest

from doccat.operators import batch as B
from doccat.operators import search as Q
from doccat.operators.postings import TextIndex

TEXTS = {"1": "red apple red", "2": "green apple", "3": "blue sky", "4": "Red sky at night", "5": "apple pie and apple cake", "6": None, "7": " "}
CLAUSES = [
    (1, "contents", "Red", "should"), (1, "contents", "apple", "should"), (1, "contents", "apple", "should"),
    (2, "contents", "apple", "must"), (2, "contents", "red", "should"), (2, "contents", "pie", "must_not"),
    (3, "contents", "sky", "must"), (3, "contents", "missing", "must"),
    (4, "contents", "sky", "must_not"),
    (5, "nowhere", "sky", "should"),
    (6, "contents", "night", "must"), (6, "contents", "red", "must"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id string, contents string")


@pytest.fixture(scope="module")
def clauses(spark):
    return spark.createDataFrame(CLAUSES, "query_id long, field string, term string, occur string")


@pytest.fixture(scope="module", params=["texts", "stored"])
def index(request, texts, tmp_path_factory):
    return TextIndex(texts) if request.param == "texts" else TextIndex.write(texts, str(tmp_path_factory.mktemp("batch") / "index"))


def brute(query: int) -> dict[str, float]:
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in TEXTS.items()}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    own = {(t.lower(), o) for q, f, t, o in CLAUSES if q == query and f == "contents"}
    must, should, never = ({t for t, o in own if o == kind} for kind in ("must", "should", "must_not"))
    out = {}
    for i, w in words.items():
        if not must <= set(w) or never & set(w) or not (must or should & set(w)):
            continue
        out[i] = 0.0
        for t in (must | should) & set(w):
            df, tf = sum(t in x for x in words.values()), w.count(t)
            out[i] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


def test_matches_and_scores_by_brute_force(index, clauses):
    found = {}
    for r in B.match_batch(index, clauses).collect():
        found.setdefault(r.query_id, {})[r.id] = r.score
    want = {q: brute(q) for q in (1, 2, 6)}
    assert set(found) == {1, 2, 6}
    for q, scores in want.items():
        assert found[q] == pytest.approx(scores)


def test_best_documents(index, clauses):
    rows = B.search_batch(index, clauses, limit=2).orderBy("query_id", "rank").collect()
    want = [(q, n + 1, i) for q in (1, 2, 6) for n, (i, _) in enumerate(sorted(brute(q).items(), key=lambda e: (-round(e[1], 6), e[0]))[:2])]
    assert [(r.query_id, r.rank, r.id) for r in rows] == want


def test_one_query_is_the_single_search(index, spark):
    one = B.clauses_of(spark.createDataFrame([(9, "apple red, apple!")], "query_id long, query string"))
    batch = {r.id: r.score for r in B.match_batch(index, one).collect()}
    assert batch == pytest.approx({r.id: r.score for r in Q.score_bm25(index, "apple red").collect()})


def test_weights_fields_and_a_catalogue(index, texts, spark):
    titles = TextIndex(spark.createDataFrame([("1", "Pie"), ("3", "pie chart")], "id string, title string"), field="title")
    rows = [(1, "title", "pie", "should", 1.0), (1, "contents", "pie", "should", 0.0), (1, "title", "pie", "should", 5.0)]
    asked = spark.createDataFrame(rows, "query_id long, field string, term string, occur string, weight double")
    found = {r.id: r.score for r in B.match_batch([index, titles], asked).collect()}
    assert set(found) == {"1", "3", "5"} and found["5"] == 0 and found["1"] > found["3"] > 0
    few = B.search_batch([index, titles], asked, 5, catalog=texts.where("id > '2'")).collect()
    assert [(r.rank, r.id) for r in few] == [(1, "3"), (2, "5")]


def test_no_queries(index, clauses):
    assert B.search_batch(index, clauses.limit(0)).collect() == []


def scans(df, folder: str) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "FileScan" in line and f"index/{folder}" in line.split("Location")[1]]


def test_postings_are_read_once(texts, clauses, tmp_path, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    found = B.search_batch(TextIndex.write(texts, str(tmp_path / "index")), clauses)
    assert len(scans(found, "postings")) == 1
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_frequencies_after_an_append(texts, clauses, tmp_path, spark):
    path = str(tmp_path / "index")
    TextIndex.write(texts, path)
    changed = spark.createDataFrame([("1", "pie"), ("8", "apple sky")], "id string, contents string")
    index = TextIndex.append(changed, path, removed=texts.where("id = '3'").select("id"))
    rows = [(i, t) for i, t in TEXTS.items() if i not in ("1", "3")] + [("1", "pie"), ("8", "apple sky")]
    rebuilt = TextIndex(spark.createDataFrame(rows, "id string, contents string"))
    got, want = ({(r.query_id, r.id): r.score for r in B.match_batch(x, clauses).collect()} for x in (index, rebuilt))
    assert got == pytest.approx(want) and got
    for match in (lambda x: Q.match_prefix(x, "app"), lambda x: Q.match_wildcard(x, "*i?"), lambda x: Q.match_fuzzy(x, "aple")):
        assert {r.id for r in match(index).collect()} == {r.id for r in match(rebuilt).collect()} != set()


def test_patterns_are_looked_for_among_the_terms(texts, tmp_path, spark):
    """Only buckets of the terms found are opened."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    index = TextIndex.write(texts, str(tmp_path / "index"))
    for found, mark in ((Q.match_prefix(index, "app"), "StartsWith"), (Q.match_wildcard(index, "*pp?e"), "RLIKE"), (Q.match_fuzzy(index, "aple"), "levenshtein")):
        assert {r.id for r in found.collect()} == {"1", "2", "5"}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        (postings,) = scans(found, "postings")
        assert "dynamicpruning" in postings and mark.lower() in plan.lower()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_postings_are_shuffled_once_and_hits_not_at_all(spark, texts, clauses, monkeypatch):
    monkeypatch.setattr(B, "HITS", 3)
    found = B.match_batch(TextIndex(texts), clauses)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(id#\d+, [2-9]", plan)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    want = {(q, i) for q in (1, 2, 6) for i in brute(q)}
    assert {(r.query_id, r.id) for r in found.collect()} == want


def test_no_clauses_find_nothing(spark, texts, clauses):
    assert B.search_batch(TextIndex(texts), clauses.limit(0)).isEmpty()
