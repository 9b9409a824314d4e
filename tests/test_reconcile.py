"""A collection that follows its files: rescans, change feeds, failures, interrupted jobs."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from doccat.config import Settings
from doccat.operators import search as Q
from doccat.plans import reconcile as R
from doccat.sources.files import read_files
from doccat.sources.tables import PartedTable

def day():
    return F.lit("2024-03-05T10:00:00Z").cast("timestamp")


def put(root, name: str, text: str) -> None:
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(text)


def key(name: str) -> str:
    return hashlib.md5(f"/{name}".encode()).hexdigest()


def actions(df) -> dict[str, str]:
    return {r.id: r.action + (f": {r.error}" if r.error else "") for r in df.collect()}


def state(to) -> dict[str, tuple]:
    return {r.loc: (r.contents, r.version) for r in to.rows().collect()}


@pytest.fixture
def root(tmp_path):
    root = str(tmp_path / "root")
    for name, text in (("a/one 1.txt", "red apple"), ("a/two.txt", "green apple"), ("b/Doe_Jo_01.02.2000/2020-01-02_three.txt", "blue sky")):
        put(root, name, text)
    return root


def test_rescan(spark, root, tmp_path):
    to = R.Collection(spark, str(tmp_path / "c"), Settings(root=root), parts=4, buckets=4)
    assert to.rows().isEmpty() and Q.match_terms(to.index(), "apple").isEmpty()
    first = actions(R.rescan(to, root, as_of=day()))
    assert set(first.values()) == {"add"} and len(first) == 3
    row = to.rows().where("loc like 'b/%'").first()
    assert (row.concern, row.birthdate, row.date_text, row.title, row.n_terms, row.version) == ("Doe_Jo_01.02.2000", "20000201", "2020-01-02", "2020-01-02_three", 2, 1)
    assert actions(R.rescan(to, root, as_of=day())) == {}

    put(root, "a/one 1.txt", "yellow pear")
    os.utime(os.path.join(root, "a/two.txt"), (1, 1))
    os.remove(os.path.join(root, "b/Doe_Jo_01.02.2000/2020-01-02_three.txt"))
    put(root, "c.txt", "sky")
    got = actions(R.rescan(to, root, as_of=day()))
    assert got == {key("a/one 1.txt"): "update", key("a/two.txt"): "keep", key("b/Doe_Jo_01.02.2000/2020-01-02_three.txt"): "remove", key("c.txt"): "add"}
    assert state(to) == {"a/one 1.txt": ("yellow pear", 2), "a/two.txt": ("green apple", 1), "c.txt": ("sky", 1)}
    index = to.index()
    hit = lambda word: {r.id for r in Q.match_terms(index, word).collect()}
    assert hit("apple") == {key("a/two.txt")} and hit("pear") == {key("a/one 1.txt")} and hit("sky") == {key("c.txt")} and not hit("blue")
    assert index.stats.count() == 3 and to.rows(tombstones=True).where("deleted = 'true'").count() == 1
    noted = [(r.id, r.version, r.version_name, r.archived_on) for r in to.versions().collect()]
    assert noted == [(key("a/one 1.txt"), 1, "a_one 1_2024-3-5.txt", "2024-03-05")]
    assert actions(R.rescan(to, root, as_of=day())) == {}
    put(root, "b/Doe_Jo_01.02.2000/2020-01-02_three.txt", "blue sky")
    assert list(actions(R.rescan(to, root, as_of=day())).values()) == ["update"]
    assert to.rows().count() == 4


def test_change_feed(spark, root, tmp_path):
    to = R.Collection(spark, str(tmp_path / "c"), Settings(root=root), parts=4, buckets=4)
    feed = lambda *events: spark.createDataFrame(
        [(f"{root}/{p}", op, ts, n) for n, (p, op, ts) in enumerate(events)], "path string, op string, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    first = feed(("a/one 1.txt", "add", 10), ("a/two.txt", "add", 10), ("a/gone.txt", "add", 11), ("x.txt", "unlink", 5))
    assert actions(R.apply_feed(to, first)) == {key("a/one 1.txt"): "add", key("a/two.txt"): "add", key("a/gone.txt"): "failed: vanished"}
    put(root, "a/one 1.txt", "black tea")
    second = feed(("a/one 1.txt", "change", 20), ("a/one 1.txt", "unlink", 19), ("a/two.txt", "change", 20))
    assert actions(R.apply_feed(to, second)) == {key("a/one 1.txt"): "update", key("a/two.txt"): "keep"}
    assert actions(R.apply_feed(to, feed(("a/two.txt", "unlink", 30)))) == {key("a/two.txt"): "remove"}
    assert actions(R.apply_feed(to, feed(("a/two.txt", "add", 25)))) == {}
    assert state(to) == {"a/one 1.txt": ("black tea", 2)} and to.rows().first().origin == "watcher"
    assert [r.id for r in Q.match_terms(to.index(), "apple tea").collect()] == [key("a/one 1.txt")]


def test_a_job_that_died_is_run_again(spark, root, tmp_path, monkeypatch):
    to = R.Collection(spark, str(tmp_path / "c"), Settings(root=root), parts=4, buckets=4)
    R.rescan(to, root, as_of=day())
    put(root, "a/one 1.txt", "yellow pear")
    with monkeypatch.context() as broken:
        broken.setattr(to.catalog, "apply", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            R.rescan(to, root, as_of=day())
    R.rescan(to, root, as_of=day())
    assert state(to)["a/one 1.txt"] == ("yellow pear", 2) and to.versions().count() == 1
    assert [r.id for r in Q.match_terms(to.index(), "pear").collect()] == [key("a/one 1.txt")]


def test_one_failure_costs_one_document(spark, root):
    put(root, "a/x.gz", "as it is")
    rows = spark.createDataFrame([(f"{root}/{p}",) if p else (None,) for p in ("a/one 1.txt", "none", "a", "a/two.txt", "a/x.gz", None)], "path string")
    got = {(r.path or "").removeprefix(root): (bytes(r.content) if r.content else None, r.read_error) for r in read_files(rows, most_bytes=9).collect()}
    assert got["/a/one 1.txt"] == (b"red apple", None) and got["/none"] == (None, "vanished") and got["/a/two.txt"] == (None, "too large")
    assert got["/a/x.gz"] == (b"as it is", None)
    assert got["/a"][1].startswith("unreadable") and got[""][1].startswith("unreadable")


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "t"), "id string, n int, m map<string, int>", F.pmod(F.ascii("id"), F.lit(8)))
    rows = lambda *pairs: spark.createDataFrame([(i, n, {}) for i, n in pairs], "id string, n int, m map<string, int>")
    assert table.read().isEmpty()
    assert table.apply(rows(("a", 1), ("b", 2), ("c", 3))) == 3
    files = lambda: {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "t")).select("path").collect()}
    before = files()
    assert table.apply(rows(("a", 7), ("i", 9))) == 1
    assert len(before & files()) == 2
    table.apply(rows(), rows(("b", 0)), spark.createDataFrame([(2,)], "part int"))
    assert sorted((r.id, r.n) for r in table.read().collect()) == [("a", 7), ("c", 3), ("i", 9)]
    assert table.apply(rows()) == 0


def test_files_are_dealt_out_before_they_are_read(spark, root, tmp_path, monkeypatch):
    """Few bytes of names stand for many of text, so they must not stay in the one part Spark makes of them."""
    parts = []

    def noted(rows, most_bytes=None):
        parts.append(rows.rdd.getNumPartitions())
        return read_files(rows, most_bytes)

    monkeypatch.setattr(R, "read_files", noted)
    to = R.Collection(spark, str(tmp_path / "c"), Settings(root=root), parts=4, buckets=4)
    R.rescan(to, root, as_of=day())
    feed = [(f"{root}/c.txt", "add", 5, 0)]
    put(root, "c.txt", "sky")
    R.apply_feed(to, spark.createDataFrame(feed, "path string, op string, ts long, seq long").withColumn("ts", F.timestamp_seconds(F.col("ts") + 2 * 10**9)))
    assert parts == [4 * spark.sparkContext.defaultParallelism] * 2
    assert len(state(to)) == 4


def test_ids_of_a_batch_are_kept_once(spark, tmp_path, monkeypatch):
    from doccat.sources import tables

    made, plain = {}, tables.drop_folder

    def looked(session, path):
        made[os.path.basename(path).partition("-")[0]] = session.read.parquet(path).count()
        plain(session, path)

    monkeypatch.setattr(tables, "drop_folder", looked)
    table = PartedTable(spark, str(tmp_path / "t"), "id string, n int", F.col("n") % 2)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, n int")
    table.apply(rows(("a", 1), ("b", 2), ("c", 3)))
    table.apply(rows(("a", 4), ("a", 5), ("d", 7)), gone=rows(("c", 0)).select("id"), touched=spark.createDataFrame([(1,)], "part int"))
    assert made == {"batch": 3, "ids": 3}
    assert sorted((r.id, r.n) for r in table.read().collect()) == [("a", 4), ("a", 5), ("b", 2), ("d", 7)]
