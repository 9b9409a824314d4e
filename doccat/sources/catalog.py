"""The stored catalogue: Parquet versions that appear as a whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.operators.sync import live
from doccat.sources.commits import DELTA, FULL, Commits


class CatalogStore:
    """Catalogue rows under ``path/data/version=N``, finished versions under ``path/commits``.

    A version is either the full catalogue or only the rows that changed, so a
    small batch writes little. Readers take the last full version and lay the
    later ones over it, newest row of an id first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def version(self) -> int:
        return self.commits.last()

    def write(self, rows: DataFrame, kind: str = DELTA, writer: str | None = None, batch_id: int | None = None,
              base: int | None = None) -> int:
        """Store ``rows`` as a version and give its number; a batch this ``writer`` has finished keeps its own."""
        done = self.commits.finished(writer, batch_id)
        if done is not None:
            return done
        version = self.commits.claim()
        data = rows.drop("version", "last_batch_id").withColumn("last_batch_id", F.lit(batch_id).cast("bigint"))
        data.write.mode("overwrite").parquet(f"{self.path}/data/version={version}")
        self.commits.add(version, kind, data.schema.json(), writer, batch_id, base)
        return version

    def read(self, tombstones: bool = False) -> DataFrame:
        """The catalogue as of the last commit; removed documents only if asked for."""
        commits = self.commits.current()
        if not commits:
            raise FileNotFoundError(f"no catalogue under {self.path}")
        base, *later = [self._rows(r.version, r.detail) for r in commits]
        rows = base
        if later:
            changed = later[0]
            for delta in later[1:]:
                changed = changed.unionByName(delta, allowMissingColumns=True)
            if len(later) > 1:  # the winners are found on two columns, so readers still read only what they ask for
                newest = changed.groupBy("id").agg(F.max("version").alias("version"))
                changed = changed.join(newest, ["id", "version"], "left_semi")
            rows = base.join(changed.select("id"), "id", "left_anti").unionByName(changed, allowMissingColumns=True)
        return rows if tombstones else live(rows)

    def changed_in(self, version: int) -> DataFrame:
        """The rows one version brought."""
        detail = self.commits.log().where(F.col("version") == version).first().detail
        return self._rows(version, detail)

    def compact(self) -> int:
        """Write the current state as a full version, tombstones included; versions still being written stay above it."""
        base = self.commits.settled()
        return self.write(self.read(tombstones=True), FULL, base=base)

    def _rows(self, version: int, schema: str) -> DataFrame:
        stored = self.spark.read.schema(T.StructType.fromJson(json.loads(schema)))
        return stored.parquet(f"{self.path}/data/version={version}").withColumn("version", F.lit(version).cast("bigint"))


def write_catalog(df: DataFrame, path: str) -> DataFrame:
    """Commit ``df`` as a new full version and give back what queries now see."""
    store = CatalogStore(df.sparkSession, path)
    store.write(df, FULL)
    return store.read()
