from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from doccat.config import SPACE_CHARS, Settings
from doccat.functions import metadata as M
from doccat.functions import paths as P
from doccat.functions import props as B
from doccat.functions import text as X
from doccat.operators import metadata as OM

DOCS = Settings(root="/srv/docs/")
SCANNED = {
    "Content-Type": ["application/pdf"],
    "X-Parsed-By": ["default", "pdf"],
    "language": [""],
    "pdf:charsPerPage": ["0", "0"],
    "title": ["untitled"],
}
FILE = "/srv/docs/m/Musterfrau_Klara_30.12.1947/Briefe/2019-08-21_Anfrage Versicherung.pdf"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def bags(spark, rows):
    """Rows of ``path, extracted, supplied`` from Python values."""
    return spark.createDataFrame(
        rows, "path string, extracted map<string,array<string>>, supplied map<string,array<string>>"
    )


def test_metadata_of_a_person_document(spark):
    supplied = {"origin": ["Praxis"]}
    row = OM.derive_metadata(bags(spark, [(FILE, SCANNED, supplied)]), settings=DOCS).first()
    assert row.concern == "Musterfrau_Klara_30.12.1947"
    assert row.title == "2019-08-21_Anfrage Versicherung"
    assert row.loc == "m/Musterfrau_Klara_30.12.1947/Briefe/2019-08-21_Anfrage Versicherung.pdf"
    assert (row.lastname, row.firstname, row.birthdate) == ("Musterfrau", "Klara", "19471230")
    assert row.date_text == "2019-08-21" and row.date == dt.datetime(2019, 8, 21)
    assert row.props["Creation-Date"] == ["2019-08-21"]
    assert row.props["dc_title"] == row.props["pdf_docinfo_title"] == [row.title]
    assert "dc:title" not in row.props and row.props["origin"] == ["Praxis"]
    assert row.id == md5("/" + row.loc)


@pytest.mark.parametrize(
    "path, want",
    [
        ("file:///srv/docs/a/b.pdf", "/a/b.pdf"),
        ("file:/srv/docs/a/b.pdf", "/a/b.pdf"),
        ("/srv/docs/a/b.pdf", "/a/b.pdf"),
        ("/srv/docs2/a/b.pdf", "/srv/docs2/a/b.pdf"),
        ("file:x.txt", "file:x.txt"),
    ],
)
def test_file_id(one, path, want):
    assert one(lambda p: P.file_id(p, DOCS), path) == md5(want)


def test_location(one):
    assert one(lambda p: P.location(p, DOCS), "/srv/docs/a/b.pdf") == "a/b.pdf"
    assert one(lambda p: P.location(p, DOCS), "/srv/docs2/b.pdf") == "/srv/docs2/b.pdf"


@pytest.mark.parametrize(
    "path, parts",
    [
        ("/a/b/c.tar.gz", ("/a/b", "c.tar.gz", ".gz", "c.tar", "b")),
        ("/a/.hidden", ("/a", ".hidden", "", ".hidden", "a")),
        ("/c.", ("/", "c.", ".", "c", "")),
        ("c", (".", "c", "", "c", ".")),
        ("/a.b/c", ("/a.b", "c", "", "c", "a.b")),
    ],
)
def test_path_parts(one, path, parts):
    fns = (P.dirname, P.basename, P.extension, P.stem, P.parent_name)
    assert tuple(one(fn, path) for fn in fns) == parts


@pytest.mark.parametrize("path, want", [("/a/x.PNG", True), ("/motif", True), ("/a.png.pdf", False), ("/x.psd", True)])
def test_needs_conversion(one, path, want):
    assert one(P.needs_conversion, path) is want


def test_visible(one):
    assert one(P.visible, "/a/.b/c") is False and one(P.visible_name, "/a/.b/c") is True
    assert one(P.visible, "/a/b.c/d") is True and one(P.visible_name, "/a/.c") is False


PDF = {"Content-Type": ["application/pdf"]}


@pytest.mark.parametrize(
    "props, want",
    [
        (PDF, True),
        ({**PDF, "pdf:charsPerPage": []}, True),
        ({**PDF, "pdf:charsPerPage": ["99"]}, True),
        ({**PDF, "pdf:charsPerPage": ["100"]}, True),
        ({**PDF, "pdf:charsPerPage": ["101"]}, False),
        ({**PDF, "pdf:charsPerPage": ["0", "975"]}, False),
        ({**PDF, "pdf:charsPerPage": [""], "pdf_charsPerPage": ["500"]}, False),
        ({**PDF, "pdf:charsPerPage": ["many"]}, True),
        ({**PDF, "pdf:charsPerPage": ["200 chars"]}, False),
        ({**PDF, "xmp:CreatorTool": ["ocrmypdf 14"]}, False),
        ({**PDF, "xmp_CreatorTool": ["ocrmypdf 14"]}, False),
        ({"Content-Type": ["text/plain"]}, False),
        ({"Content-Type": ["application/pdf", "x"]}, False),
        ({}, False),
    ],
)
def test_needs_ocr(spark, props, want):
    df = bags(spark, [("/x", props, {})])
    assert df.select(B.needs_ocr(F.col("extracted"))).first()[0] is want


def test_has_meta_falls_through_an_empty_value(spark):
    df = bags(spark, [("/x", {"a:b": [""], "a_b": ["hello"]}, {}), ("/x", {"a:b": ["other"], "a_b": ["hello"]}, {}),
                      ("/x", {"a:b": ["x", "hello"]}, {})])
    got = [r[0] for r in df.select(B.has_meta(F.col("extracted"), "a:b", "ell")).collect()]
    assert got == [True, False, None]


@pytest.mark.parametrize(
    "title, want",
    [(None, True), ("", True), ("  UNTITLED\t", True), ("Fast Report Document", True), (" pdfpreview﻿", True),
     ("   ", False), ("untitled 2", False), ("Report", False)],
)
def test_boilerplate_title(one, title, want):
    assert one(lambda t: M.boilerplate_title(t.cast("string")), title) is want


@pytest.mark.parametrize(
    "path, concern, names",
    [
        ("/x/Doe_John_01.02.2000/a.pdf", "Doe_John_01.02.2000", ("Doe", "John", "20000201")),
        ("/x/van_der_Doe_John_01.02.2000_more/a.pdf", "van_der_Doe_John_01.02.2000", ("van_der_Doe", "John", "20000201")),
        ("/x/y/Doe_John_01.02.2000 letter.pdf", "Doe_John_01.02.2000", ("Doe", "John", "20000201")),
        ("/x/Doe_John_31.02.2000/a.pdf", "Doe_John_31.02.2000", ("Doe", "John", None)),
        ("/x/plain/a.pdf", "plain", (None, None, None)),
        ("/a.pdf", "", (None, None, None)),
    ],
)
def test_concern_and_person(spark, path, concern, names):
    row = OM.derive_metadata(bags(spark, [(path, {}, {})])).first()
    assert row.concern == concern and (row.lastname, row.firstname, row.birthdate) == names


def test_given_concern_skips_the_names(spark):
    row = OM.derive_metadata(bags(spark, [("/x/Doe_John_01.02.2000/a.pdf", {}, {"concern": ["Mine"]})])).first()
    assert row.concern == "Mine" and row.lastname is None


@pytest.mark.parametrize(
    "props, name, want",
    [
        ({"date": ["2010-01-01T00:00:00Z"]}, "2019-08-21_x.pdf", "2010-01-01T00:00:00Z"),
        ({"Creation-Date": ["c"]}, "2019-08-21_x.pdf", "2019-08-21"),
        ({"Creation-Date": ["c"]}, "2019_08.21 x.pdf", "2019-08-21"),
        ({"Creation-Date": ["c"]}, "2020-13-02_x.pdf", None),
        ({"Creation-Date": ["c"]}, "2019-08-21", "c"),
        ({"meta:creation-date": ["m"], "Last-Modified": ["l"]}, "x.pdf", "m"),
        ({"date": [""], "Last-Modified": ["l"]}, "x.pdf", "l"),
        ({"Last-Save-Date": ["s"]}, "x.pdf", None),
        ({}, "x.pdf", None),
    ],
)
def test_document_date(spark, props, name, want):
    df = bags(spark, [("/a/" + name, props, {})])
    assert df.select(M.document_date(F.col("extracted"), F.col("path"))).first()[0] == want


def test_creation_date_follows_a_derived_date_only(spark):
    rows = OM.derive_metadata(
        bags(spark, [("/a/x", {"date": ["d"], "Creation-Date": ["c"]}, {}), ("/a/2019-08-21_x", {"Creation-Date": ["c"]}, {})])
    ).collect()
    assert [r.props["Creation-Date"] for r in rows] == [["c"], ["2019-08-21"]]


def test_title_copies(spark):
    props = {"title": ["Real"], "dc:title": ["old"], "pdf_docinfo:title": ["old"]}
    row = OM.derive_metadata(bags(spark, [("/a/x.pdf", props, {})])).first()
    assert row.title == "Real"
    assert {row.props[k][0] for k in ("dc:title", "pdf_docinfo:title", "dc_title", "pdf_docinfo_title")} == {"Real"}


def test_normalize_keys_keeps_the_first_value(spark):
    df = spark.sql("SELECT map('a:b', cast(null AS array<string>), 'a_b', array('x'), 'a;b', array('y'), 'c-d.e', array('z')) AS p")
    assert df.select(B.normalize_keys(F.col("p"))).first()[0] == {"a_b": ["x"], "c-d.e": ["z"]}


def test_merge_supplied_wins(spark):
    df = bags(spark, [("/x", {"a": ["1"], "b": ["2"]}, {"b": ["3"], "c": ["4"]}), ("/x", None, {"c": ["4"]})])
    got = [r[0] for r in df.select(B.merge_props(F.col("extracted"), F.col("supplied"))).collect()]
    assert got == [{"a": ["1"], "b": ["3"], "c": ["4"]}, {"c": ["4"]}]


def test_trim_space(one):
    assert one(X.trim_space, SPACE_CHARS + "a b" + SPACE_CHARS) == "a b"
    assert one(X.trim_space, "​ a") == "​ a"


def test_tokens(one):
    assert one(X.tokens, "Müller's v2_final, 3.5 – É́x!") == ["müller", "s", "v2_final", "3", "5", "é́x"]


@pytest.mark.parametrize(
    "payload, want",
    [("c29tZXRoaW5n", b"something"), ("c29t ZXRo\naW5n", b"something"), ("-_8", b"\xfb\xff"), ("YQ==junk", b"a"), ("YWJjZ", b"abc"), ("", b"")],
)
def test_lenient_base64(one, payload, want):
    assert bytes(one(X.lenient_base64, payload)) == want


def test_html_to_text(one):
    html = "<p>a &lt;b&gt;</p><script>var x='</p>';</script><!-- no -->\n<STYLE>p{}</STYLE>&amp;lt; &quot;c&#39;"
    assert one(X.html_to_text, html) == "a <b> &lt; \"c'"


def test_version_name(spark):
    df = spark.sql("SELECT '/r/Doe_J_01.01.2000/2019-08-21_Kurz bericht.pdf' AS p, date'2024-03-07' AS d")
    assert df.select(M.version_name(F.col("p"), F.col("d"))).first()[0] == (
        "Doe_J_01.01.2000_2019-08-21_Kurz bericht_2024-3-7.pdf"
    )


def test_import_keeps_failures_apart(spark):
    rows = [("/a/ok.pdf", b"  text ", PDF), ("/a/gone.pdf", None, PDF), ("/a/none.pdf", b"x", None), ("/a/bad.txt", b"a\xffb", {})]
    files = spark.createDataFrame(rows, "path string, content binary, extracted map<string,array<string>>").withColumn(
        "supplied", F.create_map().cast("map<string,array<string>>")
    )
    done = {r.path: r for r in OM.import_documents(files).collect()}
    assert {p: r.error for p, r in done.items()} == {
        "/a/ok.pdf": None, "/a/gone.pdf": "unreadable", "/a/none.pdf": "no metadata", "/a/bad.txt": None
    }
    assert done["/a/ok.pdf"].contents == "text" and done["/a/ok.pdf"].ocr is True
    assert done["/a/ok.pdf"].checksum == md5("  text ")
    assert done["/a/bad.txt"].contents == "a�b"
    assert OM.imported(OM.import_documents(files)).count() == 2


def test_patch_values(spark):
    catalog = OM.derive_metadata(bags(spark, [("/a/x.pdf", {"keep": ["k"]}, {}), ("/a/y.pdf", {}, {})]))
    changes = {"title": "T", "author": '["A", 1]', "subject": "[bad", "name": "[x y]", "date": "2020-01-02", "_version_": "9"}
    ids = {r.path: r.id for r in catalog.collect()}
    patches = spark.createDataFrame([(ids["/a/x.pdf"], changes)], "id string, changes map<string,string>")
    rows = {r.path: r for r in OM.patch_metadata(catalog, patches).collect()}
    new = rows["/a/x.pdf"]
    assert new.title == "T" and new.date_text == "2020-01-02" and new.date == dt.datetime(2020, 1, 2)
    assert new.props["author"] == ["A", "1"] and new.props["subject"] == ["[bad"]
    assert new.props["name"] == ["Err: [x y]"] and new.props["keep"] == ["k"]
    assert "_version_" not in new.props and rows["/a/y.pdf"].title == "y"


def test_display_metadata(spark):
    catalog = OM.derive_metadata(bags(spark, [("/a/x.pdf", {"categories": ["B", "C"]}, {}), ("/a/y.pdf", PDF, {})]))
    shown = {(r.id, r.key): r.value for r in OM.display_metadata(catalog).collect()}
    x, y = (md5(p) for p in ("/a/x.pdf", "/a/y.pdf"))
    assert shown[x, "categories"] == "B,C" and shown[y, "categories"] == "General"
    assert shown[y, "content-type"] == "application/pdf" and (x, "date") not in shown


def test_stamp_is_utc(spark):
    df = OM.stamp(spark.range(1), F.lit("2024-02-29T13:00:00+01:00").cast("timestamp"), "watcher")
    row = df.first()
    assert (row.imported_at, row.doctype, row.origin) == ("2024-02-29T12:00:00.000Z", "Inbox", "watcher")


def test_json_lists_are_strings(one):
    assert one(OM.patch_value, json.dumps(["a", "b"])) == ["a", "b"]
