from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from doccat.operators import search as Q
from doccat.operators.postings import N_BUCKETS, TextIndex, build_postings, refresh_postings
from doccat.plans import search as PS
from doccat.session import shared_folder

WORDS = ["ab", "ba", "abc", "acb", "cab", "the", "teh", "hte", "then", "tehn", "Ärger", "ärgre"]
_random = random.Random(7)
TEXTS = {
    f"d{i:03d}": " ".join(_random.choice(WORDS) for _ in range(_random.choice([0, 1, 3, 8, 40]))) for i in range(120)
}


def split(text):
    return re.findall(r"\w+", text.lower())


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id string, contents string")


@pytest.fixture(scope="module", params=["texts", "stored"])
def index(spark, texts, request):
    if request.param == "texts":
        return TextIndex(texts)
    return TextIndex.write(texts, shared_folder(spark, "index"), n_buckets=5)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        ("1", "Doe_Jo_01.01.2000", "Alpha report", "Doe", ["a b", "General"], None),
        ("2", "doe_Al_01.01.2000", "beta", "Doe", None, None),
        ("3", "Inbox", None, None, ["b"], None),
        ("4", "Inbox", "Alpha report", "doe", ["General"], "true"),
    ]
    schema = "id string, concern string, title string, lastname string, categories array<string>, deleted string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns(
        {"date": F.timestamp_seconds(F.col("id").cast("int") * 86400), "contents": F.lit("secret"), "checksum": F.lit("c")}
    )


def ids(df):
    got = [r.id for r in df.collect()]
    assert len(got) == len(set(got)), "ids are distinct"
    return set(got)


def test_postings(texts):
    want = {}
    for d, text in TEXTS.items():
        for pos, t in enumerate(split(text)):
            want.setdefault((d, t), []).append(pos)
    rows = build_postings(texts).collect()
    assert {(r.id, r.term): r.positions for r in rows} == want
    assert all(r.tf == len(r.positions) and r.n_terms == len(split(TEXTS[r.id])) for r in rows)


def test_refresh_equals_rebuild(spark, texts):
    changed = spark.createDataFrame([("d001", "new words"), ("new", "the end")], "id string, contents string")
    gone = spark.createDataFrame([("d002",)], "id string")
    after = texts.where(~F.col("id").isin("d001", "d002")).unionByName(changed)
    got = refresh_postings(build_postings(texts), changed, gone)
    assert sorted(map(str, got.collect())) == sorted(map(str, build_postings(after).collect()))


def test_appended_index_equals_a_rebuilt_one(spark, texts):
    path = shared_folder(spark, "index")
    TextIndex.write(texts, path, n_buckets=3)
    changed = spark.createDataFrame([("d001", "the new words"), ("new", "the end")], "id string, contents string")
    gone = spark.createDataFrame([("d002",)], "id string")
    again = spark.createDataFrame([("new", "the very end"), ("d002", "")], "id string, contents string")
    TextIndex.append(changed, path, gone, n_buckets=3)
    index = TextIndex.append(again, path, n_buckets=7, writer="w", batch_id=0)
    repeated = TextIndex.append(again, path, n_buckets=7, writer="w", batch_id=0)
    after = texts.where(~F.col("id").isin("d001", "d002")).unionByName(changed.where("id = 'd001'")).unionByName(again)
    for stored in (index, repeated):
        for words in ("the", "end new", "abc"):
            assert ids(Q.match_terms(stored, words)) == ids(Q.match_terms(TextIndex(after), words))
        assert ids(Q.match_all(stored)) == ids(Q.match_all(TextIndex(after)))
        score = lambda i: {r.id: r.score for r in Q.score_bm25(i, "the end").collect()}
        assert score(stored) == pytest.approx(score(TextIndex(after)))


def test_bucket_pruning(spark, texts):
    stored = TextIndex.write(texts, shared_folder(spark, "index"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = stored.terms(["the"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "(bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0].replace("isnotnull(bucket#", "")
    assert "EqualTo(term,the)" in plan
    assert {r.n_buckets for r in stored._postings.select("n_buckets").distinct().collect()} == {N_BUCKETS}


def test_terms(index):
    assert ids(Q.match_terms(index, "ABC then")) == {d for d, t in TEXTS.items() if {"abc", "then"} & set(split(t))}
    assert ids(Q.match_all(index)) == {d for d, t in TEXTS.items() if split(t)}
    assert ids(Q.match_prefix(index, "te*")) == {d for d, t in TEXTS.items() if any(w.startswith("te") for w in split(t))}
    assert ids(Q.match_prefix(index, "*")) == ids(Q.match_all(index))
    want = {d for d, t in TEXTS.items() if any(re.fullmatch("a.*b", w) for w in split(t))}
    assert ids(Q.match_wildcard(index, "A*B")) == want
    assert ids(Q.match_wildcard(index, "?Rger")) == {d for d, t in TEXTS.items() if "ärger" in split(t)}


def test_bool(index):
    the, ab, abc = (Q.match_terms(index, w) for w in ("the", "ab", "abc"))
    sets = {d: set(split(t)) for d, t in TEXTS.items()}
    assert ids(Q.match_bool((the, ab), (), (abc,))) == {d for d, s in sets.items() if {"the", "ab"} <= s and "abc" not in s}
    assert ids(Q.match_bool((), (the, ab), (abc,))) == {d for d, s in sets.items() if {"the", "ab"} & s and "abc" not in s}
    assert ids(Q.match_bool((the,), (ab,))) == {d for d, s in sets.items() if "the" in s}
    with pytest.raises(ValueError):
        Q.match_bool(must_not=(the,))


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance_by_brute_force(spark):
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)] + ["abcdef", "badcfe", "bacdfe", "ä"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for q in ("abcdef", "abca", "aabb", "ab", "a", "äb"):
        for edits in (0, 1, 2):
            got = {r.w for r in df.where(Q.within_edits(F.col("w"), q, edits)).collect()}
            assert got == {w for w in words if osa(q, w) <= edits}, (q, edits)


def test_fuzzy(index):
    want = {d for d, t in TEXTS.items() if any(osa("the", w) <= 1 for w in split(t))}
    assert ids(Q.match_fuzzy(index, "The", 1)) == want


def sloppy(tokens, words, slop):
    """Distinct places for the words whose shifted positions lie within ``slop``."""
    places = [[i for i, t in enumerate(tokens) if t == w] for w in words]
    for choice in itertools.product(*places):
        shifted = [p - i for i, p in enumerate(choice)]
        if len(set(choice)) == len(choice) and max(shifted) - min(shifted) <= slop:
            return True
    return False


@pytest.mark.parametrize("words, slop", [("the ab", 0), ("the the", 0), ("the", 0), ("the ab", 2), ("ab the abc", 3), ("ab ab", 1), ("ab the ab", 2)])
def test_phrase_by_brute_force(index, words, slop):
    want = {d for d, t in TEXTS.items() if sloppy(split(t), words.split(), slop)}
    assert ids(Q.match_phrase(index, words, slop)) == want


def test_bm25_by_brute_force(index):
    docs = {d: split(t) for d, t in TEXTS.items() if split(t)}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for w, weight in (("the", 1.0), ("abc", 3.0)):
        df = sum(w in t for t in docs.values())
        for d, t in docs.items():
            if tf := t.count(w):
                part = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
                want[d] = want.get(d, 0) + weight * part
    got = {r.id: r.score for r in Q.score_bm25(index, "the abc the", {"ABC": 3.0}).collect()}
    assert got == pytest.approx(want)
    best = sorted(want, key=lambda d: (-round(want[d], 6), d))
    top = [r.id for r in Q.top_ranked(Q.score_bm25(index, "the abc", {"abc": 3.0}), 5, 3).collect()]
    assert top == best[3:8]


def test_catalogue_fields(catalog):
    assert ids(Q.match_field(catalog, "lastname", "Doe")) == {"1", "2"}
    assert ids(Q.match_field(catalog, "title", "REPORT x")) == {"1", "4"}
    assert ids(Q.match_field(catalog, "categories", "b")) == {"1", "3"}
    assert ids(Q.match_prefix(catalog, "Doe*", "concern")) == {"1", "2"}
    assert ids(Q.match_prefix(catalog, "Doe", "lastname")) == {"1", "2"}
    assert ids(Q.match_prefix(catalog, "*", "title")) == {"1", "2", "4"}
    assert ids(Q.match_wildcard(catalog, "doe_?o*", "concern")) == {"1"}
    assert ids(Q.match_wildcard(catalog, "d*", "lastname")) == {"4"}
    low, high = (F.timestamp_seconds(F.lit(86400 * d)) for d in (2, 3))
    assert ids(Q.match_range(catalog, "date", low, high)) == {"2", "3"}
    assert ids(Q.match_range(catalog, "date", high=low)) == {"1", "2"}
    for field in ("loc", "checksum", "filename", "url", "imported_at"):
        with pytest.raises(ValueError):
            Q.match_field(catalog, field, "x")


def test_page_and_sort(catalog):
    everything = [r.id for r in Q.sort_by(catalog, "concern asc,title asc").collect()]
    assert everything == ["2", "1", "4", "3"]
    pages = [r.id for o in (0, 2, 4) for r in Q.page(catalog, limit=2, offset=o).collect()]
    assert pages == everything
    assert [r.id for r in Q.sort_by(catalog, "lastname desc").collect()] == ["4", "1", "2", "3"]


def test_facets(catalog):
    rows = [(r.field, r.value, r.n) for r in Q.facets(catalog, ["concern", "categories"]).collect()]
    assert rows == [
        ("categories", "General", 2), ("categories", "a b", 1), ("categories", "b", 1),
        ("concern", "Inbox", 2), ("concern", "Doe_Jo_01.01.2000", 1), ("concern", "doe_Al_01.01.2000", 1),
    ]
    top = [(r.field, r.value, r.n) for r in Q.facets(catalog, ["concern", "categories"], limit=1).collect()]
    assert top == [("concern", "Inbox", 2), ("categories", "General", 2)]


def test_returnable(catalog):
    assert "contents" not in Q.returnable(catalog.withColumn("version", F.lit(1))).columns
    assert "version" not in Q.returnable(catalog.withColumn("version", F.lit(1))).columns


def test_structured_query(spark, catalog, texts):
    found = PS.search(catalog, catalog.select("id"), sort="title asc", limit=2, offset=1, facets=["lastname"])
    assert [r.id for r in found.docs.collect()] == ["2", "3"]
    assert found.num_found.first().num_found == 3 and found.start == 1
    assert [(r.value, r.n) for r in found.facets.collect()] == [("Doe", 2)]
    scores = catalog.select("id", F.col("id").cast("double").alias("score"))
    ranked = PS.search(catalog, scores.select("id"), scores, filter=F.col("concern") != "Inbox")
    assert [r.id for r in ranked.docs.collect()] == ["2", "1"]


@pytest.mark.parametrize("concern, want", [("doe", {"1", "2"}), ("doe_al*", {"2"}), ("d?e_jo*", {"1"}), ("", {"1", "2", "3"}), ("*", {"1", "2", "3"})])
def test_web_search(spark, catalog, concern, want):
    index = TextIndex(spark.createDataFrame([(str(i), "word") for i in range(1, 5)], "id string, contents string"))
    page = PS.search_concern(catalog, index, "word", concern)
    assert page.columns == ["id", "title", "concern"] and ids(page) == want
    assert ids(PS.search_concern(catalog, index, "*", concern)) == want


def test_normalize_query(spark):
    rows = [("Gränicher +Odermatt", None, False), ("Gränicher +Odermatt", "lastname asc", True),
            ("lastname:Gränicher +firstname:Ursula", None, False), ("lastname:Gränicher", None, True)]
    df = spark.createDataFrame(rows, "query string, sort string, is_object boolean")
    assert [(r.query, r.sort) for r in Q.normalize_query(df).collect()] == [
        ("contents:(Gränicher +Odermatt)", "concern asc,title asc"),
        ("contents:(Gränicher +Odermatt)", "lastname asc"),
        ("lastname:Gränicher +firstname:Ursula", "concern asc,title asc"),
        ("lastname:Gränicher", None),
    ]


def test_page_state(spark):
    rows = [(0, 20, "forward"), (20, 20, "backward"), (10, 20, "backward"), (60, 20, None), (40, 20, "forward")]
    df = spark.createDataFrame(rows, "offset bigint, num bigint, direction string")
    got = [(r.new_offset, r.next_disabled, r.back_disabled) for r in Q.page_state(df, F.lit(50)).collect()]
    assert got == [(20, False, False), (0, False, True), (0, False, True), (0, False, True), (60, True, False)]
