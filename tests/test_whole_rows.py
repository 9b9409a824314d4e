"""Nothing is lost on the way: unscored matches, lists, several patches, binary files, many-valued fields."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doccat.operators import metadata as OM
from doccat.operators import search as Q
from doccat.plans.search import search

CATALOG = "id string, title string, concern string, content_type string, stamps array<string>"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        ("a", "Alpha", "x", "application/pdf", ["2001", "2011"]), ("b", "beta", "x", "text/html", ["2005"]), ("c", "Gamma", "y", None, None),
    ]
    return spark.createDataFrame(rows, CATALOG).withColumn("deleted", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("b", 2.0)], "id string, score double")


def ids(df):
    return [r.id for r in df.collect()]


def test_matches_without_a_score_stay(catalog, scores):
    found = search(catalog, catalog.select("id"), scores)
    assert ids(found.docs) == ["b", "a", "c"] and found.num_found.first()[0] == 3


def test_sort_by_score_in_any_case(catalog, scores):
    assert ids(search(catalog, catalog.select("id"), scores, sort="score DESC,title asc").docs) == ["b", "a", "c"]
    assert ids(Q.sort_by(catalog, "title Desc")) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        Q.sort_columns("title down")


def test_ranges_of_many_values(catalog):
    inside = catalog.where(Q.field_range("stamps", "2010", "2012", many=True))
    assert ids(inside) == ["a"]
    assert sorted(ids(Q.match_range(catalog, "stamps", low="2002"))) == ["a", "b"]


def test_content_type_is_searched_by_words(catalog):
    assert ids(Q.match_field(catalog, "content_type", "pdf")) == ["a"]


def test_creation_dates_stay_a_list(spark):
    bag = {"date": ["2010-01-01T00:00:00Z"], "Creation-Date": ["one", "two"]}
    df = spark.createDataFrame([("/a/b.pdf", bag, {})], "path string, extracted map<string,array<string>>, supplied map<string,array<string>>")
    assert OM.derive_metadata(df).first().props["Creation-Date"] == ["one", "two"]


def test_patches_of_one_document_are_merged(spark):
    rows = [("a", "old", {"k": ["v"]}, None)]
    catalog = spark.createDataFrame(rows, "id string, title string, props map<string,array<string>>, deleted string")
    patches = spark.createDataFrame(
        [("a", {"title": "first", "categories": "c"}, 1), ("a", {"title": "second"}, 2)], "id string, changes map<string,string>, order int"
    )
    row = OM.patch_metadata(catalog, patches).first()
    assert row.title == "second" and row.props["categories"] == ["c"] and row.props["k"] == ["v"]


def test_binary_files_have_no_text(spark):
    bag = {"Content-Type": ["application/pdf"], "pdf:charsPerPage": ["900"]}
    rows = [("/a/x.pdf", bytearray(b"%PDF-1.4 words"), bag, {}), ("/a/y.pdf", bytearray(b"plain words"), bag, {}), ("/a/z.png", bytearray(b"\x89PNG\x00"), bag, {})]
    df = spark.createDataFrame(rows, "path string, content binary, extracted map<string,array<string>>, supplied map<string,array<string>>")
    out = {r.path: r for r in OM.import_documents(df).collect()}
    assert (out["/a/x.pdf"].contents, out["/a/x.pdf"].error) == (None, "no text")
    assert (out["/a/y.pdf"].contents, out["/a/y.pdf"].error) == ("plain words", None)
    assert out["/a/z.png"].contents is None and (out["/a/z.png"].error is None) == out["/a/z.png"].convert


def test_texts_stay_whole_whatever_bytes_they_hold(spark):
    bag = {"Content-Type": ["text/plain"]}
    given = {"/a/nul.txt": "one\0two", "/a/head.txt": "%PDF is how such files begin"}
    rows = [(p, bytearray(t.encode()), bag, {}) for p, t in given.items()] + [("/a/nul.pdf", bytearray(b"a\0b"), {"Content-Type": ["application/pdf"]}, {})]
    df = spark.createDataFrame(rows, "path string, content binary, extracted map<string,array<string>>, supplied map<string,array<string>>")
    out = {r.path: (r.contents, r.error) for r in OM.import_documents(df).collect()}
    assert out == {**{p: (t, None) for p, t in given.items()}, "/a/nul.pdf": ("a\0b", None)}
