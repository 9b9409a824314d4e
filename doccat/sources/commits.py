"""The list of finished versions of a stored table."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FULL, DELTA = "full", "delta"
SCHEMA = "version bigint, kind string, base bigint, writer string, batch_id bigint, detail string"
TAKEN = "FileAlreadyExistsException"


class Commits:
    """One small row per finished version, written after its data.

    A writer first claims a number, by a file that can be made only once (on a
    file system that promises this, as HDFS does), so two writers never share a
    version; where both change a row the higher number counts. A version whose
    job died has no row and is never read. A full version stands for those up to
    its ``base``; all later ones are laid over it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        files, folder = self._files("")
        if not files.exists(folder):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.path)

    def last(self) -> int:
        """The last finished version, -1 before the first."""
        return self.log().agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def current(self) -> list[Row]:
        """The last full version, if there is one, and those to lay over it, in order."""
        log = self.log()
        full = log.where(F.col("kind") == FULL).agg(F.max(F.struct("version", "base"))).first()[0]
        counts = F.col("kind") == DELTA
        if full is not None:
            counts = (counts & (F.col("version") > full.base)) | (F.col("version") == full.version)
        return sorted(log.where(counts).collect(), key=lambda r: (r.kind != FULL, r.version))

    def claim(self) -> int:
        """A version number that no other writer gets."""
        version = self.last() + 1
        while not self._made_first(f"_claims/{version}"):
            version += 1
        return version

    def settled(self) -> int:
        """The version up to which all that were claimed are finished.

        A claim of a lost job holds this back: versions after it are laid over
        again after a compaction, which costs time but no rows.
        """
        files, folder = self._files("_claims")
        current = self.current()
        start = current[0].base if current and current[0].kind == FULL else -1
        finished = {r.version for r in self.log().where(F.col("version") > start).select("version").collect()}
        claimed = [int(f.getPath().getName()) for f in files.listStatus(folder)] if files.exists(folder) else []
        unfinished = [n for n in claimed if n > start and n not in finished]
        return min(unfinished, default=max(finished, default=start) + 1) - 1

    def finished(self, writer: str | None, batch_id: int | None) -> int | None:
        """The version this writer has already finished for this batch."""
        if writer is None or batch_id is None:
            return None
        same = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
        return self.log().where(same).agg(F.max("version")).first()[0]

    def add(self, version: int, kind: str, detail: str = "", writer: str | None = None, batch_id: int | None = None,
            base: int | None = None) -> None:
        """Commit a claimed version; a full one without ``base`` replaces all before it."""
        row = self.spark.createDataFrame([(version, kind, version if base is None else base, writer, batch_id, detail)], SCHEMA)
        row.coalesce(1).write.mode("append").json(self.path)

    def _files(self, name: str):
        """The file system, and the path of ``name`` in it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _made_first(self, name: str) -> bool:
        files, path = self._files(name)
        try:
            files.create(path, False).close()
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != TAKEN:
                raise
            return False
        return True
