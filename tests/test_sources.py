from __future__ import annotations

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.config import CATALOG_SCHEMA, Settings
from doccat.operators import search as Q
from doccat.operators.postings import TextIndex
from doccat.operators.sync import sync_plan
from doccat.plans.ingest import with_checksums, with_ids
from doccat.sources import catalog as C
from doccat.sources import files as SF
from doccat.sources import intake as SI
from doccat.sources import text as ST
from doccat.sources.schema import align_schema
from doccat.streaming import ingest as SG


def put(root, name, content=b"text"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture()
def root(tmp_path):
    base = str(tmp_path / "docs")
    for name in ("s/subd/a.pdf", "s/subd/b.txt", "s/subd/deep/c.txt", "s/.hidden", "s/.dir/x.txt", "aaa_inbox/Doe_Jo_01.02.2000_a.txt"):
        put(base, name, name.encode())
    return base


def test_scan_files(spark, root):
    names = sorted(os.path.relpath(r.path.removeprefix("file:"), root) for r in SF.scan_files(spark, root).collect())
    assert names == ["aaa_inbox/Doe_Jo_01.02.2000_a.txt", "s/subd/a.pdf", "s/subd/b.txt", "s/subd/deep/c.txt"]


def test_scan_reads_no_bytes_it_does_not_need(spark, root):
    plan = SF.scan_files(spark, root).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_walk_gives_what_the_scan_gives(spark, root):
    names = ["_part", "_k=v", "x._COPYING_", "_metadata", "_metadata_d/a.txt", "_no/a.txt", "_k=v d/a.txt", "c._COPYING_/a.txt", "sp ace/ü %20 #?.txt", "q/" * 5 + "deep"]
    for name in names:
        put(root, f"odd/{name}")
    put(root, "odd/empty.txt", b"")
    os.symlink(os.path.join(root, "s/subd"), os.path.join(root, "odd/linked"))
    os.symlink(os.path.join(root, "nothing"), os.path.join(root, "odd/dangling"))
    os.utime(os.path.join(root, "s/subd/b.txt"), ns=(1, 1_234_567_891_987_654_321))
    os.makedirs(os.path.join(root, "bare"))
    columns = ["path", "modification_time", "length"]
    for top in (root, f"file://{root}/", os.path.join(root, "*/subd")):
        found = sorted(SF.walk_files(spark, top).collect())
        assert found == sorted(SF.scan_files(spark, top).select(*columns).collect()) and len(found) >= 3
    assert len(SF.walk_files(spark, root).collect()) == 12
    assert SF.walk_files(spark, os.path.join(root, "bare")).isEmpty()
    alone = os.path.join(root, "s/subd/b.txt")
    assert [r.path for r in SF.walk_files(spark, alone).collect()] == [f"file:{alone}"]
    with pytest.raises(AnalysisException):
        SF.walk_files(spark, os.path.join(root, "missing"))


def test_walk_leaves_the_listing_to_tasks(spark, root):
    assert "binaryFile" not in SF.walk_files(spark, root)._jdf.queryExecution().executedPlan().toString()


def test_list_files(spark, root):
    settings = Settings(root=root)
    from doccat.functions import paths as P

    catalog = SF.scan_files(spark, root).select(P.location(P.strip_scheme(F.col("path")), settings).alias("loc"))
    assert SF.list_files(catalog, "s/subd").count() == 2
    assert SF.list_files(catalog, "/s/subd/", with_subdirs=True).count() == 3
    assert [r.name for r in SF.list_files(catalog, "s/subd", pattern=r"\.pdf$").collect()] == ["a.pdf"]
    assert SF.list_files(catalog, "s/subd", True, r"^d|^a").count() == 2
    assert {r.name for r in SF.list_files(catalog, "", with_subdirs=True).collect()} == {"s", "aaa_inbox"}


def test_align_schema(spark):
    df = spark.sql("SELECT 'x' AS id, 7 AS title, array('a') AS lastname, 'b' AS author, 'soon' AS date, 3 AS extra, map('k', array('v')) AS props")
    row = align_schema(df).first()
    assert row.title == "7" and row.lastname == "a" and row.author == ["b"] and row.date is None and row.subject is None
    assert row.props == {"extra": ["3"], "k": ["v"]}
    assert align_schema(df).drop("props").schema.fieldNames() == CATALOG_SCHEMA.fieldNames()
    again = align_schema(align_schema(df)).first()
    assert again == row
    plain = align_schema(spark.sql("SELECT 'x' AS id"), T.StructType([T.StructField("id", T.StringType())])).first()
    assert plain.props == {}


def test_intake(spark):
    rows = [
        ({"filepath": "a//b.txt", "title": "T"}, "c29tZXRoaW5n"), ({"title": "T"}, "YQ=="), ({"filepath": ""}, "YQ=="),
        ({"filepath": "../x"}, "YQ=="), (None, "YQ=="), ({"filepath": "x"}, None),
    ]
    got = SI.intake_batch(spark.createDataFrame(rows, "metadata map<string,string>, payload string"), Settings(root="/r/")).collect()
    assert [r.status for r in got] == [202, 400, 400, 400, 400, 400]
    assert got[0].path == "/r/a/b.txt" and bytes(got[0].content) == b"something"
    assert got[0].supplied["origin"] == ["REST API"] and got[0].supplied["title"] == ["T"]
    assert got[1].path is None and got[1].content is None


def test_get_document(spark):
    catalog = spark.createDataFrame([("1", "a.txt"), ("2", None), ("3", "c"), ("3", "c")], "id string, loc string")
    asked = spark.createDataFrame([(i,) for i in "1234"], "id string")
    files = spark.createDataFrame([("file:/r/a.txt", b"bytes")], "path string, content binary")
    got = {r.id: (r.status, r.path, r.content and bytes(r.content)) for r in SI.get_document(catalog, asked, files, Settings(root="/r")).collect()}
    assert got == {"1": (200, "/r/a.txt", b"bytes"), "2": (404, None, None), "3": (500, None, None), "4": (404, None, None)}


def test_get_metadata(spark):
    catalog = spark.createDataFrame([("1", "t", "secret", 3)], "id string, title string, contents string, version int")
    got = SI.get_metadata(catalog, spark.createDataFrame([("1",), ("2",)], "id string"))
    assert set(got.columns) == {"id", "title", "status"}
    assert {r.id: r.status for r in got.collect()} == {"1": 200, "2": 404}


def test_json_result(spark):
    rows = SI.json_result(spark.sql("SELECT 'a' AS id, 'x\"y' AS title")).collect()
    assert rows[0].json == '{"id":"a","title":"x\\"y"}'


def test_extract_with_a_library(spark):
    docs = spark.createDataFrame([("a", b" up "), ("b", b"\xff")], "id string, content binary")
    got = {r.id: (r.contents, r.extract_error) for r in ST.extract_with(docs, lambda b: b.decode("ascii").upper()).collect()}
    assert got["a"] == ("UP", None) and got["b"][0] is None and got["b"][1].startswith("UnicodeDecodeError")


def test_extract_by_type(spark):
    docs = spark.createDataFrame([(b"<p>a</p>", "text/html"), (b" b ", "text/plain; charset=UTF-8"), (b"c", "application/pdf")], "c binary, t string")
    assert [r[0] for r in docs.select(ST.extract_content(F.col("c"), F.col("t"))).collect()] == ["a", "b", None]


# --- stored catalogue -----------------------------------------------------------

def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, title string, deleted string")


def seen(store):
    return {r.id: r.title for r in store.read().collect()}


def test_store_lays_deltas_over_the_last_full_version(spark, tmp_path):
    store = C.CatalogStore(spark, str(tmp_path / "c"))
    assert store.version() == -1
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(rows(spark, ("1", "a", None), ("2", "b", None)))
    store.write(rows(spark, ("2", "c", None), ("3", "d", None)))
    store.write(rows(spark, ("1", None, "true"), ("3", "e", None)).withColumn("extra", F.lit("x")))
    assert seen(store) == {"2": "c", "3": "e"} and store.version() == 2
    before = sorted(map(str, store.read(tombstones=True).drop("version", "last_batch_id").collect()))
    assert store.compact() == 3
    assert sorted(map(str, store.read(tombstones=True).drop("version", "last_batch_id").collect())) == before


def test_unfinished_version_is_not_read(spark, tmp_path):
    store = C.CatalogStore(spark, str(tmp_path / "c"))
    store.write(rows(spark, ("1", "a", None)))
    rows(spark, ("1", "half", None)).write.parquet(f"{store.path}/data/version=1")
    assert seen(store) == {"1": "a"}
    store.write(rows(spark, ("1", "b", None)))
    assert seen(store) == {"1": "b"}


def test_a_batch_is_applied_once(spark, tmp_path):
    store = C.CatalogStore(spark, str(tmp_path / "c"))
    store.write(rows(spark, ("1", "a", None)), writer="w", batch_id=0)
    assert store.write(rows(spark, ("1", "again", None)), writer="w", batch_id=0) == 0
    assert store.write(rows(spark, ("1", "other", None)), writer="v", batch_id=0) == 1
    assert store.write(rows(spark, ("1", "again", None)), writer="w", batch_id=0) == 0
    assert seen(store) == {"1": "other"}
    assert [r.title for r in store.changed_in(0).collect()] == ["a"]


def test_two_writers_that_saw_the_same_last_version(spark, tmp_path, monkeypatch):
    store = C.CatalogStore(spark, str(tmp_path / "c"))
    store.write(rows(spark, ("1", "a", None)))
    with monkeypatch.context() as both:
        both.setattr(C.Commits, "last", lambda self: 0)
        assert [store.write(rows(spark, ("2", t, None), (t, t, None))) for t in "xy"] == [1, 2]
    assert seen(store) == {"1": "a", "2": "y", "x": "x", "y": "y"} and store.read().count() == 4


def test_compaction_beside_a_writer(spark, tmp_path):
    store = C.CatalogStore(spark, str(tmp_path / "c"))
    store.write(rows(spark, ("1", "a", None), ("2", "old", None)))
    late = store.commits.claim()
    store.write(rows(spark, ("3", "c", None)))
    assert store.compact() == 3 and seen(store) == {"1": "a", "2": "old", "3": "c"}
    data = rows(spark, ("2", "b", None), ("3", "older", None)).withColumn("last_batch_id", F.lit(None).cast("bigint"))
    data.write.parquet(f"{store.path}/data/version={late}")
    store.commits.add(late, "delta", data.schema.json())
    want = {"1": "a", "2": "b", "3": "c"}
    assert seen(store) == want and store.compact() == 4 and seen(store) == want
    assert len(store.commits.current()) == 1


def test_write_catalog(spark, tmp_path):
    assert C.write_catalog(rows(spark, ("1", "a", None)), str(tmp_path / "c")).count() == 1
    assert C.write_catalog(rows(spark, ("2", "b", None)), str(tmp_path / "c")).first().id == "2"


# --- streams ----------------------------------------------------------------------

def ingest(spark, root, store, checkpoint, settings):
    files = SF.without_properties(SF.stream_files(spark, root))
    SG.stream_ingest(files, store, checkpoint, settings=settings, index_path=store.path + "/index").awaitTermination()


def test_ingest_add_edit_remove(spark, root, tmp_path):
    settings, store = Settings(root=root), C.CatalogStore(spark, str(tmp_path / "c"))
    checkpoint = str(tmp_path / "cp")
    ingest(spark, root, store, checkpoint, settings)
    first = {r.loc: r for r in store.read().collect()}
    assert set(first) == {"aaa_inbox/Doe_Jo_01.02.2000_a.txt", "s/subd/a.pdf", "s/subd/b.txt", "s/subd/deep/c.txt"}
    assert first["s/subd/b.txt"].contents == "s/subd/b.txt" and first["s/subd/b.txt"].origin == "watcher"

    ingest(spark, root, store, checkpoint, settings)
    assert store.read().count() == 4

    put(root, "s/new.txt", b"fresh")
    ingest(spark, root, store, checkpoint, settings)
    assert store.read().where("loc = 's/new.txt'").first().contents == "fresh"
    index = TextIndex.read(spark, store.path + "/index")
    assert Q.documents(store.read(), Q.match_terms(index, "fresh")).first().loc == "s/new.txt"
    assert Q.match_all(index).count() == 5

    # a new checkpoint replays every file; the catalogue already knows them
    version = store.version()
    ingest(spark, root, store, str(tmp_path / "cp2"), settings)
    assert store.read().count() == 5 and store.read().where(F.col("version") > version).count() == 0

    put(root, "s/new.txt", b"edited")
    os.remove(os.path.join(root, "s/subd/a.pdf"))
    on_disk = with_checksums(with_ids(SF.scan_files(spark, root), settings))
    plan = {r.action: r.n for r in sync_plan(on_disk, store.read()).groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert plan == {"keep": 3, "update": 1, "remove": 1}


def test_stream_files_skips_dotted_paths(spark, root, tmp_path):
    out = str(tmp_path / "out")
    run = SF.stream_files(spark, root, max_files=2).select("path").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_route_stream(spark, root, tmp_path):
    out, settings = str(tmp_path / "out"), Settings(root=root)
    files = SF.stream_files(spark, root).select("path")
    SG.stream_route(files, out, str(tmp_path / "cp"), settings).awaitTermination()
    moves = spark.read.parquet(out).where("action = 'move'").collect()
    assert [m.destination for m in moves] == ["d/Doe_Jo_01.02.2000/a.txt"]


def test_change_stream_over_several_batches(spark, tmp_path):
    source, schema = str(tmp_path / "feed"), "id string, op string, ts timestamp, seq bigint, checksum string"
    store = C.CatalogStore(spark, str(tmp_path / "c"))

    def send(*events):
        df = spark.createDataFrame(list(events), "id string, op string, t int, seq bigint, checksum string")
        df.withColumn("ts", F.timestamp_seconds("t")).drop("t").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        SG.stream_changes(stream, store, str(tmp_path / "cp")).awaitTermination()

    send(("a", "add", 1, 1, "1"), ("b", "add", 1, 2, "2"))
    send(("a", "unlink", 5, 3, None), ("b", "change", 2, 4, "3"))
    send(("a", "add", 4, 5, "late"), ("c", "add", 6, 6, "4"))
    assert {r.id: r.checksum for r in store.read().collect()} == {"b": "3", "c": "4"}
    assert store.read(tombstones=True).where("id = 'a'").first().deleted == "true"
