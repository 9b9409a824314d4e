"""Session helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
PART_SIZE, PART_DEFAULT, PART_SORTED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m", "16m"
SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPLIT_SIZE, OPEN_COST, OPEN_WRITERS = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.maxConcurrentOutputFileWriters"
LISTING_TASKS, LISTING_DEFAULT = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"
#: Key, what it is by default and what it becomes; the last is for local files only.
BATCH_SETTINGS = (
    (OPEN_COST, "4194304b", "256k"),
    ("spark.sql.streaming.fileSource.log.compactInterval", "10", "500"),
    ("spark.sql.streaming.fileSink.log.compactInterval", "10", "500"),
    ("spark.sql.sources.parallelPartitionDiscovery.threshold", "32", "1000"),
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("doccat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares, or beside the session's tables if it names none."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` has named, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder, none if there is no such folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getContentSummary(folder).getLength() if store.exists(folder) else 0


def files_bytes(rows: DataFrame) -> int:
    """Bytes of the stored files that rows are made from."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f)) for f in rows.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


@contextmanager
def settings_for(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session that hold inside only, by the names they have in this module."""
    names = {globals()[k]: v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Each query inside drops its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    return settings_for(spark, SHUFFLES_DROPPED="true")


def few_listing_tasks(spark: SparkSession) -> None:
    """Let folders and files be listed by four tasks a core, not by one for each of them; a number the session names stays."""
    if spark.conf.get(LISTING_TASKS, LISTING_DEFAULT) == LISTING_DEFAULT:
        spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))


def small_batches(spark: SparkSession, local: bool) -> None:
    """Let a stream of many small files spend little on each micro-batch; what the session names stays.

    A batch's files go to one task a core, not to one for every 32 of them; logs of a stream's files and of
    its output, which a compaction writes anew as a whole, are compacted every 500 batches; and files
    in a ``local`` store are looked at in the driver, where it takes less time than a job.
    """
    for key, default, value in BATCH_SETTINGS[: len(BATCH_SETTINGS) if local else -1]:
        if spark.conf.get(key, default) in (default, None):
            spark.conf.set(key, value)


@contextmanager
def sortable_parts(spark: SparkSession) -> Iterator[None]:
    """Shuffled parts of 16 MB for a write that sorts them: a row takes about ten times as much in memory, and what a
    task can't hold is spilled. A size the session names stays."""
    own = spark.conf.get(PART_SIZE, PART_DEFAULT) not in (PART_DEFAULT, f"{64 * 2**20}b")
    if not own:
        spark.conf.set(PART_SIZE, PART_SORTED)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(PART_SIZE)


def spread(df: DataFrame, partitions: int | None, *key: str) -> DataFrame:
    """Deal rows out anew where the caller names a number of parts."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions, *key)
