"""The term index as a table: who contains which term, how often and where."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.functions.text import TOKEN_PATTERN, tokens
from doccat.session import sortable_parts, spread
from doccat.sources.commits import DELTA, FULL, Commits

N_BUCKETS = 32
POSTINGS = (
    "id string, term string, tf int, n_terms int, positions array<int>, "
    "version bigint, n_buckets int, field string, bucket int"
)
STATS = "id string, n_terms int, version bigint, field string"
TERMS = "term string, df bigint, n_buckets int, bucket int, version bigint, field string"
REPLACED = "id string, version bigint"
Predicate = Callable[[Column], Column]


def build_postings(texts: DataFrame, field: str = "contents", keep: Predicate | None = None,
                   partitions: int | None = None) -> DataFrame:
    """``id, field, term, tf, n_terms, positions`` of one text column.

    Grouping happens inside each row: tokens are sorted with their positions
    and cut into runs. Nothing is shuffled, whatever the terms' frequencies.
    ``keep`` drops terms before the sort, so a search for few terms is cheap.
    ``partitions`` deals the texts out first, for inputs of few row groups.
    """
    run = F.col("_sorted")
    pairs = F.transform("_tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    if keep is not None:
        pairs = F.filter(pairs, lambda p: keep(p["term"]))
    starts = F.filter(
        F.transform(
            run, lambda p, i: F.when((i == 0) | (p["term"] != F.get(run, i - 1)["term"]), i)
        ),
        lambda i: i.isNotNull(),
    )
    runs = F.transform(
        "_starts",
        lambda start, k: F.struct(
            F.get(run, start)["term"].alias("term"),
            F.slice(run, start + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size(run)) - start)["pos"].alias(
                "positions"
            ),
        ),
    )
    return (
        spread(texts.select("id", field), partitions, "id")
        .select("id", tokens(F.col(field)).alias("_tokens"))
        .select("id", F.size("_tokens").alias("n_terms"), F.sort_array(pairs).alias("_sorted"))
        .withColumn("_starts", starts)
        .select("id", "n_terms", F.inline(runs))
        .select("id", F.lit(field).alias("field"), "term", F.size("positions").alias("tf"), "n_terms", "positions")
    )


def doc_stats(texts: DataFrame, field: str = "contents") -> DataFrame:
    """Length of each text in terms; one row for every document that has any text."""
    filled = texts.select("id", field).where(F.col(field).rlike(TOKEN_PATTERN))
    return filled.select("id", F.lit(field).alias("field"), F.size(tokens(F.col(field))).alias("n_terms"))


def refresh_postings(postings: DataFrame, texts: DataFrame, removed: DataFrame | None = None,
                     field: str = "contents") -> DataFrame:
    """Postings after ``texts`` were added or changed and the ``removed`` ids went.

    The ids that go are the side that is hashed, so the postings are not sorted for it.
    """
    gone = texts.select("id") if removed is None else texts.select("id").union(removed.select("id"))
    return postings.join(gone.distinct().hint("shuffle_hash"), "id", "left_anti").unionByName(build_postings(texts, field))


def write_postings(postings: DataFrame, path: str, n_buckets: int = N_BUCKETS, mode: str = "overwrite") -> None:
    """Store postings for term lookup.

    Folders by hash of the term prune a lookup to its bucket; rows are sorted by
    term, so the row groups of a file prune it further. The rebalance splits a
    bucket that a frequent term has swollen and joins small ones, by real size,
    into parts that a task can sort without spilling.
    """
    bucketed = postings.withColumns(
        {"n_buckets": F.lit(n_buckets), "bucket": F.pmod(F.hash("term"), F.lit(n_buckets))}
    )
    with sortable_parts(postings.sparkSession):
        (
            bucketed.hint("rebalance", "bucket")
            .sortWithinPartitions("n_buckets", "field", "bucket", "term", "id")
            .write.mode(mode)
            .option("compression", "zstd")
            .partitionBy("n_buckets", "field", "bucket")
            .parquet(path)
        )


def write_terms(postings: DataFrame, path: str) -> None:
    """Store each distinct term of stored postings with the number of its documents and its bucket, sorted by term."""
    terms = postings.groupBy("field", "n_buckets", "bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    terms.hint("rebalance", "field").sortWithinPartitions("term").write.mode("overwrite").partitionBy("field").parquet(path)


class TextIndex:
    """Term lookup over one text column, from stored postings or straight from the texts.

    A stored index has a table of its distinct terms. Patterns and near
    spellings are looked for there; only the postings of what is found are read,
    and only from its buckets.
    """

    def __init__(self, texts: DataFrame | None = None, postings: DataFrame | None = None,
                 stats: DataFrame | None = None, field: str = "contents", terms: DataFrame | None = None,
                 whole: bool = False):
        if texts is None and (postings is None or stats is None):
            raise ValueError("give the texts, or stored postings with their stats")
        self.field, self._texts, self._postings = field, texts, postings
        #: ``whole`` tells that no later version has replaced documents, so that the terms' frequencies hold.
        self._terms, self._whole = terms, whole
        self.stats = doc_stats(texts, field) if stats is None else stats

    @classmethod
    def write(cls, texts: DataFrame, path: str, field: str = "contents", n_buckets: int = N_BUCKETS) -> TextIndex:
        """Store the index of all ``texts`` as a full version."""
        _store(texts, None, path, FULL, field, n_buckets)
        return cls.read(texts.sparkSession, path, field)

    @classmethod
    def append(cls, texts: DataFrame, path: str, removed: DataFrame | None = None, field: str = "contents",
               n_buckets: int = N_BUCKETS, writer: str | None = None, batch_id: int | None = None) -> TextIndex:
        """Add or replace ``texts`` and drop the ``removed`` ids, writing no more than these."""
        _store(texts, removed, path, DELTA, field, n_buckets, writer, batch_id)
        return cls.read(texts.sparkSession, path, field)

    @classmethod
    def read(cls, spark: SparkSession, path: str, field: str = "contents") -> TextIndex:
        """The stored index. Rows of an id that a later version replaced are left out of every lookup."""
        commits = Commits(spark, f"{path}/commits").current()
        if not commits:
            raise FileNotFoundError(f"no index under {path}")

        def stored(schema: str, name: str) -> DataFrame:
            folders = [f"{path}/{name}/version={r.version}" for r in commits]
            return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders)

        postings, stats = stored(POSTINGS, "postings"), stored(STATS, "stats")
        if len(commits) > 1:
            newest = stored(REPLACED, "replaced").groupBy("id").agg(F.max("version").alias("version"))
            outdated = lambda df: (df["id"] == newest["id"]) & (df["version"] < newest["version"])
            postings = postings.join(newest, outdated(postings), "left_anti")
            stats = stats.join(newest, outdated(stats), "left_anti")
        this_field = F.col("field") == field
        terms = stored(TERMS, "terms").where(this_field)
        return cls(postings=postings.where(this_field), stats=stats.where(this_field), field=field, terms=terms, whole=len(commits) == 1)

    def lookup(self, keep: Predicate, terms: list[str] | None = None) -> DataFrame:
        """Postings whose term passes ``keep``; exact ``terms``, if known, prune the buckets."""
        if self._postings is None:
            return build_postings(self._texts, self.field, keep)
        if not terms and self._terms is not None:
            fitting = self._terms.where(keep(F.col("term"))).select("n_buckets", "bucket", "term").distinct()
            found = self._postings.join(fitting, ["n_buckets", "bucket", "term"], "left_semi")
            return found.select("id", "field", "term", "tf", "n_terms", "positions")
        found = self._postings.where(keep(F.col("term")))
        if terms and "bucket" in self._postings.columns:
            hashes = [F.pmod(F.hash(F.lit(t)), F.col("n_buckets")) for t in terms]
            hit = F.col("bucket") == hashes[0]
            for h in hashes[1:]:
                hit = hit | (F.col("bucket") == h)
            found = found.where(hit)
        return found.select("id", "field", "term", "tf", "n_terms", "positions")

    def having(self, words: DataFrame) -> DataFrame:
        """Postings of the rows (``field, term``) that stand in ``words``, which may be many."""
        rows = build_postings(self._texts, self.field) if self._postings is None else self._postings
        return rows.join(words, ["field", "term"], "left_semi").select("id", "field", "term", "tf", "n_terms")

    def frequencies(self, words: DataFrame) -> DataFrame:
        """``field, term, df`` of the words (``field, term``) that occur; from the terms alone where their counts hold."""
        if self._whole:
            return self._terms.join(words, ["field", "term"], "left_semi").select("field", "term", "df")
        return self.having(words).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def terms(self, terms: list[str]) -> DataFrame:
        lowered = sorted({t.lower() for t in terms})
        return self.lookup(lambda t: t.isin(*lowered), lowered)


def _store(texts: DataFrame, removed: DataFrame | None, path: str, kind: str, field: str, n_buckets: int,
           writer: str | None = None, batch_id: int | None = None) -> None:
    commits = Commits(texts.sparkSession, f"{path}/commits")
    if commits.finished(writer, batch_id) is not None:
        return
    version = commits.claim()
    write_postings(build_postings(texts, field), f"{path}/postings/version={version}", n_buckets)
    written = texts.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings/version={version}")
    write_terms(written, f"{path}/terms/version={version}")
    doc_stats(texts, field).write.mode("overwrite").partitionBy("field").parquet(f"{path}/stats/version={version}")
    replaced = texts.select("id") if removed is None else texts.select("id").union(removed.select("id"))
    replaced.write.mode("overwrite").parquet(f"{path}/replaced/version={version}")
    commits.add(version, kind, field, writer, batch_id)
