"""Many searches in one job: queries are rows, clauses meet the postings by an equi-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.config import BM25_B, BM25_K1
from doccat.functions.text import tokens
from doccat.operators.postings import TextIndex
from doccat.session import shared_folder

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
#: Hits (a document's word and a query that asks for it) that one task counts.
HITS = 2_000_000


def clauses_of(queries: DataFrame, column: str = "query", occur: Column | None = None, field: str = "contents") -> DataFrame:
    """``query_id, field, term, occur``: every distinct word of a text column is a clause.

    ``occur`` is an expression over ``term``; by default every word is optional.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(column)))).alias("term"))
    how = F.lit(SHOULD) if occur is None else occur
    return words.select("query_id", F.lit(field).alias("field"), "term", how.alias("occur"))


def match_batch(indexes: TextIndex | list[TextIndex], clauses: DataFrame) -> DataFrame:
    """``query_id, id, score`` of all documents that fit a query: all musts, no must_not, and a should where nothing is a must.

    ``clauses`` are rows ``query_id, field, term, occur`` and, if some words
    count more than others, ``weight``. The score is BM25 over the musts and
    shoulds, by the totals of each field. A clause that is given twice counts
    once, with its greatest weight; a field without an index has no matches; a
    query of prohibitions alone finds nothing.

    A stored index is read once, only the postings of words asked for; document
    frequencies come from its table of terms. Clauses are joined with them
    first and written. What is shuffled is the postings asked for, by document,
    once for all queries; the clauses come to them there, broadcast if Spark
    finds them small enough, and all hits of a document are then counted where
    it is. The frequencies tell how many hits there will be, and so how many tasks.
    """
    indexes = [indexes] if isinstance(indexes, TextIndex) else indexes
    weight = F.col("weight").cast("double") if "weight" in clauses.columns else F.lit(1.0)
    asked = clauses.select("query_id", "field", F.lower("term").alias("term"), "occur", weight.alias("weight"))
    asked = asked.groupBy("query_id", "field", "term", "occur").agg(F.max("weight").alias("weight"))
    musts = asked.groupBy("query_id").agg(F.count_if(F.col("occur") == MUST).alias("n_must"))
    words = asked.select("field", "term").distinct()
    own = [words.where(F.col("field") == i.field) for i in indexes]
    found = reduce(DataFrame.unionByName, [i.having(w) for i, w in zip(indexes, own, strict=True)])
    held = reduce(DataFrame.unionByName, [i.frequencies(w) for i, w in zip(indexes, own, strict=True)])
    totals = reduce(DataFrame.unionByName, [
        i.stats.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("avg_terms")).withColumn("field", F.lit(i.field)) for i in indexes
    ])
    df, tf = F.col("df"), F.col("tf")
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    weighted = asked.join(musts, "query_id").join(held, ["field", "term"]).join(totals, "field").select(
        "query_id", "field", "term", "occur", "n_must", "avg_terms", "df", (F.col("weight") * idf).alias("gain")
    )
    kept = shared_folder(clauses.sparkSession, "clauses")
    weighted.write.parquet(kept)
    weighted = clauses.sparkSession.read.schema(weighted.schema).parquet(kept)
    tasks = 1 + (weighted.agg(F.sum("df")).first()[0] or 0) // HITS
    part = F.col("gain") * tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_terms") / F.col("avg_terms")))
    occurs = {o: F.count_if(F.col("occur") == o).alias(o) for o in (MUST, SHOULD, MUST_NOT)}
    counted = found.repartition(tasks, "id").join(weighted, ["field", "term"]).groupBy("query_id", "id").agg(
        *occurs.values(), F.max("n_must").alias("n_must"), F.sum(F.when(F.col("occur") != MUST_NOT, part)).alias("score")
    )
    wanted = (F.col(MUST) == F.col("n_must")) & (F.col(MUST_NOT) == 0) & ((F.col("n_must") > 0) | (F.col(SHOULD) > 0))
    return counted.where(wanted).select("query_id", "id", "score")


def search_batch(indexes: TextIndex | list[TextIndex], clauses: DataFrame, limit: int = 10,
                 catalog: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, id, score``: the best ``limit`` documents of each query, ties by id after rounding to six places.

    With ``catalog`` only its documents count, and their frequencies stay those
    of the whole index. Each task keeps ``limit`` rows of a query before the
    ranks are given, so no query gathers all its matches in one place.
    """
    matches = match_batch(indexes, clauses).withColumn("score", F.round("score", 6))
    if catalog is not None:
        matches = matches.join(catalog.select("id"), "id", "left_semi")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return matches.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")
