from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doccat.operators import sync as S
from doccat.plans.ingest import pending

FILES = [("new", "a"), ("same", "b"), ("edited", "c2"), ("unread", None), ("unhashed", "d"), ("buried", "e")]
KNOWN = [("same", "b", None), ("edited", "c1", None), ("unread", "x", None), ("unhashed", None, None), ("gone", "g", None), ("buried", "e", "true")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "id string, checksum string")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(KNOWN, "id string, checksum string, deleted string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_differences(files, catalog):
    assert ids(S.new_files(files, catalog)) == ["buried", "new"]
    assert ids(S.changed_files(files, catalog)) == ["edited", "unread"]
    assert ids(S.deleted_files(files, catalog)) == ["gone"]
    assert ids(pending(files, catalog)) == ["buried", "edited", "new", "unread"]
    assert {r.id: r.action for r in S.sync_plan(files, catalog).collect()} == {
        "new": "add", "buried": "add", "same": "keep", "edited": "update", "unread": "update", "unhashed": "keep", "gone": "remove"
    }


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], "id string, title string, n int")
    docs = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("3", "z", 1), (None, "free", 1)], "id string, title string, seq int")
    new = S.upsert_documents(old, docs, order=("seq",))
    rows = {r.title: r for r in new.collect()}
    assert set(rows) == {"b", "y", "z", "free"} and rows["y"].n is None
    again = S.upsert_documents(new, docs, order=("seq",))
    assert sorted(map(str, again.collect())) == sorted(map(str, new.collect()))
    assert S.upsert_documents(old, docs).where("id = '1'").count() == 1
    generated = S.upsert_documents(old, docs.drop("id")).where("title = 'free'").first().id
    assert len(generated) == 32


def test_remove_and_duplicates(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("3", "a"), ("4", None), ("5", None)], "id string, checksum string")
    going = spark.createDataFrame([("2",), ("unknown",)], "id string")
    assert ids(S.remove_documents(rows, going)) == ["1", "1", "3", "4", "5"]
    assert [(r.id, r.copies) for r in S.duplicate_ids(rows).collect()] == [("1", 2)]
    assert [(r.checksum, r.copies, r.keep_id) for r in S.duplicate_content(rows).collect()] == [("a", 3, "1")]


def feed(spark, *rows):
    df = spark.createDataFrame(list(rows), "id string, op string, t int, seq bigint, checksum string")
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def empty(spark):
    return spark.createDataFrame([], "id string, checksum string, last_ts timestamp, last_seq bigint")


def test_last_event_wins(spark):
    changes = feed(spark, ("a", "add", 1, 1, "1"), ("a", "change", 2, 2, "2"), ("b", "add", 1, 3, "3"), ("b", "unlink", 1, 4, None))
    after = {r.id: r for r in S.apply_changes(empty(spark), changes).collect()}
    assert after["a"].checksum == "2" and after["a"].deleted is None
    assert after["b"].deleted == "true" and after["b"].checksum is None
    assert ids(S.live(S.apply_changes(empty(spark), changes))) == ["a"]


def test_a_late_event_cannot_bring_a_file_back(spark):
    first = S.apply_changes(empty(spark), feed(spark, ("a", "unlink", 5, 9, None)))
    late = S.apply_changes(first, feed(spark, ("a", "add", 4, 3, "old")))
    assert S.live(late).count() == 0
    newer = S.apply_changes(late, feed(spark, ("a", "add", 6, 10, "new")))
    assert S.live(newer).first().checksum == "new"


def test_batches_give_what_one_batch_gives(spark):
    rows = [(f"f{i % 7}", ["add", "change", "unlink"][i % 3], (i * 37) % 50, i, str(i)) for i in range(60)]
    whole = S.apply_changes(empty(spark), feed(spark, *rows))
    stepwise = empty(spark)
    for start in range(0, 60, 20):
        stepwise = S.apply_changes(stepwise, feed(spark, *rows[start:start + 20]))
    pick = lambda df: sorted((r.id, r.checksum, r.deleted, r.last_seq) for r in df.collect())
    assert pick(whole) == pick(stepwise)


def test_settled(spark):
    rows = spark.createDataFrame([("a", 10.0), ("b", 11.5)], "id string, s double").withColumn(
        "modification_time", F.col("s").cast("timestamp")
    )
    now = F.lit(12).cast("timestamp")
    assert ids(S.settled_files(rows, 1.0, now)) == ["a"]
    assert ids(S.settled_files(rows, 0.5, now)) == ["a", "b"]


def test_upsert_without_an_order_keeps_the_same_row(spark):
    known = spark.createDataFrame([("a", "old", None), ("z", "stays", 0)], "id string, title string, n int")
    docs = spark.createDataFrame([("a", f"t{i}", i % 3 or None) for i in range(40)], "id string, title string, n int")
    kept = {tuple(sorted((r.id, r.title) for r in S.upsert_documents(known, part).collect()))
            for part in (docs, docs.orderBy(F.col("title").desc()), docs.repartition(5, "title"))}
    assert len(kept) == 1 and ("z", "stays") in kept.pop()
