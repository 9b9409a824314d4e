"""What used to fail, or grow faster than its input, on larger tables."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from doccat.llm import oddsketch
from doccat.plans.registry import QUERIES
from doccat.sources import files as SF
from doccat.sources import tables


def _documents(spark, n: int, parts: int, folder: str) -> None:
    text = F.concat(F.lit("the word "), F.col("doc_id").cast("string"))
    rows = spark.range(1, n + 1).withColumnRenamed("id", "doc_id").select(
        "doc_id", text.alias("text"), F.lit("de").alias("lang"), F.lit("src1").alias("source"), F.length(text).cast("bigint").alias("n_chars")
    )
    rows.repartition(parts).write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_in_a_folder_streams_like_one_in_a_file(spark, tmp_path, parts):
    _documents(spark, 24, parts, str(tmp_path))
    assert QUERIES["stream_route"](spark, str(tmp_path)).count() == 24


def test_a_stream_of_an_empty_table_gives_no_rows(spark, tmp_path):
    _documents(spark, 0, 1, str(tmp_path))
    routed = QUERIES["stream_route"](spark, str(tmp_path))
    assert routed.columns == ["doc_id", "path", "action", "destination"] and routed.count() == 0


def test_folders_are_not_listed_by_a_task_each(spark, tmp_path):
    n = 10 * spark.sparkContext.defaultParallelism
    for i in range(n):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "file").write_text("x")
    spark.sparkContext.setJobGroup("walk", "walk")
    try:
        files = SF.scan_files(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("walk") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert files.count() == n


def test_a_scan_lists_and_reads_in_few_tasks(spark, tmp_path, monkeypatch):
    """Neither passes files through the driver's listing nor makes a task of every 32 small files."""
    cores = spark.sparkContext.defaultParallelism
    for i in range(5 * cores):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "ä b.txt").write_text(f"text {i:03}")
    files = SF.scan_files(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan(files) and "EvalPython" in plan(files) and "EvalPython" not in plan(files.drop("content"))
    assert files.rdd.getNumPartitions() == 4 * cores
    assert sorted(bytes(r.content) for r in files.collect()) == [b"text %03d" % i for i in range(5 * cores)]
    monkeypatch.setattr(SF, "READ_BYTES", 8)
    assert SF.scan_files(spark, str(tmp_path)).rdd.getNumPartitions() == 5 * cores


def test_a_stream_of_files_does_not_write_its_logs_anew_every_ten_batches(spark, tmp_path):
    from doccat.session import BATCH_SETTINGS, small_batches

    for i in range(12):
        (tmp_path / "files" / f"{i}").mkdir(parents=True)
        (tmp_path / "files" / f"{i}" / "a.txt").write_text(f"text {i}")
    before = {key: spark.conf.get(key, None) for key, _, _ in BATCH_SETTINGS}
    try:
        stream = SF.stream_files(spark, str(tmp_path / "files"), max_files=1).select("content")
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        run = writer.trigger(availableNow=True).start()
        run.awaitTermination()
        assert len([p for p in run.recentProgress if p.numInputRows]) == 12 and spark.read.parquet(str(tmp_path / "out")).count() == 12
        names = [f.name for folder in ("cp/sources/0", "out/_spark_metadata") for f in (tmp_path / folder).iterdir()]
        assert len(names) >= 24 and not any("compact" in name for name in names)
        key, default, _ = BATCH_SETTINGS[0]
        spark.conf.set(key, "1m")
        small_batches(spark, local=True)
        assert spark.conf.get(key) == "1m"
        spark.conf.set(key, default)
        small_batches(spark, local=True)
        assert spark.conf.get(key) == "256k"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_scan_reads_what_only_spark_opens(spark, tmp_path):
    (tmp_path / "a.txt").write_text("red")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.grown.link./in", f"file://{tmp_path}")
    assert [(r.path, bytes(r.content)) for r in SF.scan_files(spark, "viewfs://grown/in").collect()] == [("viewfs://grown/in/a.txt", b"red")]


def test_a_batch_is_kept_once_at_most_and_only_while_it_is_laid_over(spark, tmp_path, monkeypatch):
    kept = []

    def folder(spark, name):
        kept.append(tmp_path / f"{name}-{len(kept)}")
        return str(kept[-1])

    monkeypatch.setattr(tables, "shared_folder", folder)
    table = tables.PartedTable(spark, str(tmp_path / "t"), "id string, n int", F.col("n") % 2)
    rows = lambda *given: spark.createDataFrame(list(given), "id string, n int")
    assert table.apply(rows(("a", 1), ("b", 2))) == 2 and not kept
    assert table.apply(rows(("a", 3), ("c", 5))) == 1
    assert len(kept) == 1 and not kept[0].exists()
    assert sorted(map(tuple, table.read().collect())) == [("a", 3), ("b", 2), ("c", 5)]


@pytest.mark.parametrize("most", [0, 10**9])
def test_parts_are_rewritten_in_groups_of_bounded_size(spark, tmp_path, monkeypatch, most):
    """Parts over the bound are rewritten one by one, smaller ones together."""
    written, plain = [], tables.PartedTable._write

    def noted(table, rows, size, parts):
        written.append((size, parts))
        plain(table, rows, size, parts)

    monkeypatch.setattr(tables.PartedTable, "_write", noted)
    monkeypatch.setattr(tables, "SHUFFLED_BYTES", most)
    source = str(tmp_path / "s")
    spark.range(400).selectExpr("cast(id as string) id", "cast(id as int) n").write.parquet(source)
    rows = spark.read.parquet(source)
    table = tables.PartedTable(spark, str(tmp_path / "t"), "id string, n int", F.col("n") % 4, 4)
    assert table.apply(rows) == 4 and written.pop()[0] > 0
    assert table.apply(rows.where("n < 40").selectExpr("id", "n + 1 as n"), rows.where("n = 100").select("id")) == 4
    assert [parts for _, parts in written] == ([1] * 4 if most == 0 else [4])
    assert sorted(r.n for r in table.read().collect()) == sorted([*range(1, 41), *range(40, 100), *range(101, 400)])


def test_parts_keep_their_order_where_tasks_write_to_all_of_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SHUFFLED_BYTES", 0)
    spark.range(300).selectExpr("md5(cast(id as string)) id", "cast(id as int) n").write.parquet(str(tmp_path / "s"))
    for parts in (None, 4):
        table = tables.PartedTable(spark, str(tmp_path / f"t{parts}"), "id string, n int", F.col("n") % 4, parts)
        table.apply(spark.read.parquet(str(tmp_path / "s")))
        files = [*(tmp_path / f"t{parts}").glob("part=*/*.parquet")]
        ids = [[r.id for r in spark.read.parquet(str(f)).collect()] for f in files]
        assert len(files) >= 4 and all(x == sorted(x) for x in ids) and sum(map(len, ids)) == 300


def test_parts_are_not_looked_for_where_a_batch_touches_all(spark, tmp_path, monkeypatch):
    asked, plain = [], tables._numbers

    def noted(rows):
        asked.append(plain(rows))
        return {*asked[-1]}

    monkeypatch.setattr(tables, "_numbers", noted)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, n int")
    table = tables.PartedTable(spark, str(tmp_path / "t"), "id string, n int", F.col("n") % 2, 2)
    table.apply(rows(("a", 1), ("b", 2), ("c", 3)))
    touched = spark.createDataFrame([(1,)], "part int")
    assert table.apply(rows(("a", 4)), touched=touched) == 2 and asked == [{0}, {1}]
    assert table.apply(rows(("b", 6), ("d", 7)), gone=rows(("c", 0)).select("id"), touched=touched) == 2 and asked[2:] == [{0, 1}]
    assert sorted((r.id, r.n) for r in table.read().collect()) == [("a", 4), ("b", 6), ("d", 7)]


def test_shuffles_go_with_their_query(spark):
    from doccat.session import SHUFFLES_DROPPED, shuffles_dropped

    before = spark.conf.get(SHUFFLES_DROPPED, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(SHUFFLES_DROPPED) == "true"
        assert spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(SHUFFLES_DROPPED, None) == before


def test_a_collection_leaves_no_copy_of_its_texts_behind(spark, tmp_path, monkeypatch):
    from doccat.config import Settings
    from doccat.plans import reconcile as R

    kept = []

    def folder(spark, name):
        kept.append(tmp_path / f"{name}-{len(kept)}")
        return str(kept[-1])

    for module in (R, tables):
        monkeypatch.setattr(module, "shared_folder", folder)
    root = tmp_path / "root"
    root.mkdir()
    for n in range(5):
        (root / f"{n}.txt").write_text(f"word {n}")
    to = R.Collection(spark, str(tmp_path / "c"), Settings(root=str(root)), parts=4, buckets=4)
    done = R.rescan(to, str(root))
    assert {r.action for r in done.collect()} == {"add"} and done.count() == 5
    (root / "1.txt").write_text("another")
    (root / "2.txt").unlink()
    R.rescan(to, str(root))
    assert {p.name.partition("-")[0] for p in kept} >= {"listing", "looked", "batch", "done"}
    assert {p.name.partition("-")[0] for p in kept if p.exists()} == {"done"}


def test_files_are_read_once_and_no_known_text_is_kept(spark, tmp_path, monkeypatch):
    from doccat.config import Settings
    from doccat.plans import reconcile as R

    plans, texts, stored = [], [], R._stored

    def noted(df, name, **options):
        rows, path = stored(df, name, **options)
        if name == "looked":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            texts.append({r.path.rpartition("/")[2]: r.contents for r in rows.collect()})
        return rows, path

    monkeypatch.setattr(R, "_stored", noted)
    root = tmp_path / "root"
    root.mkdir()
    for name in "ab":
        (root / name).write_text(f"text {name}")
    to = R.Collection(spark, str(tmp_path / "c"), Settings(root=str(root)))
    R.rescan(to, str(root))
    (root / "a").write_text("edited")
    feed = spark.createDataFrame([(f"{root}/{name}", "change", n) for n, name in enumerate("abc")], "path string, op string, seq long")
    done = R.apply_feed(to, feed.withColumn("ts", F.lit("2040-01-01").cast("timestamp")))
    assert {r.path.rpartition("/")[2]: r.action for r in done.collect()} == {"a": "update", "b": "keep", "c": "failed"}
    assert texts == [{"a": "text a", "b": "text b"}, {"a": "edited", "b": None, "c": None}]
    assert [plan.count("MapInArrow") for plan in plans] == [1, 1]
    assert {r.contents for r in to.rows().collect()} == {"edited", "text b"}


def test_parts_of_a_bucket_lose_no_candidates(spark):
    """Pairs that share one bucket only, which is dealt into many parts."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        sketch = rng.integers(0, 256, oddsketch.SKETCH_BITS // 8, dtype=np.uint8).tobytes()
        rows += [(f"{i:03}{end}".encode(), [7], sketch) for end in "ab"]
    reps = spark.createDataFrame(rows, "fp binary, bands array<long>, sketch binary")
    found = {(bytes(r.a), bytes(r.b)) for r in oddsketch.candidates(reps, chunk=8).collect()}
    assert found >= {(f"{i:03}a".encode(), f"{i:03}b".encode()) for i in range(40)}


def test_parts_that_are_sorted_are_small(spark, tmp_path, monkeypatch):
    from doccat.operators import postings as OP
    from doccat.session import PART_SIZE, sortable_parts

    sizes, plain = [], OP.sortable_parts

    @contextmanager
    def noted(session):
        with plain(session):
            sizes.append(session.conf.get(PART_SIZE))
            yield

    monkeypatch.setattr(OP, "sortable_parts", noted)
    texts = spark.createDataFrame([("1", "red apple")], "id string, contents string")
    before = spark.conf.get(PART_SIZE)
    OP.write_postings(OP.build_postings(texts), str(tmp_path / "postings"))
    assert sizes == ["16m"] and spark.conf.get(PART_SIZE) == before
    spark.conf.set(PART_SIZE, "5m")
    try:
        with sortable_parts(spark):
            assert spark.conf.get(PART_SIZE) == "5m"
        assert spark.conf.get(PART_SIZE) == "5m"
    finally:
        spark.conf.unset(PART_SIZE)
