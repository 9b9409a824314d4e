"""Each operator over its whole table, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.llm import (
    anchors, collocations, decontaminate, flatgraph, langid, mixture, mtree, oddsketch, phrases, rans, runs, secretscan, severity,
)
from doccat.llm.common import importable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_secret_owners(spark, sf):
    """Sources own what they publish; a source's languages stand for its repositories."""
    owner, repo = F.col("source"), F.concat_ws("/", "source", "lang")
    return secretscan.digest(secretscan.scan(table(spark, sf, "documents"), owner, repo))


@query
def op2_prefix_free_parsing(spark, sf):
    return phrases.repeats_removed(table(spark, sf, "documents"))


@query
def op3_token_files(spark, sf):
    return rans.tokenised(table(spark, sf, "documents"))


@query
def op4_toxic_severity(spark, sf):
    return severity.severity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_minhash_odd_sketch(spark, sf):
    return oddsketch.near_duplicates(table(spark, sf, "documents"))


@query
def op6_language_id(spark, sf):
    return langid.language_id(table(spark, sf, "documents"))


@query
def op7_flat_graph(spark, sf):
    return flatgraph.near_duplicates(table(spark, sf, "embeddings"))


@query
def op8_decontaminate(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.digest(found)


@query
def op9_fixed_block_anchors(spark, sf):
    return anchors.repeats_removed(table(spark, sf, "documents"))


@query
def op10_mixture(spark, sf):
    return mixture.mix(table(spark, sf, "documents"))


@query
def op11_m_tree_top_k(spark, sf):
    return mtree.top_k(table(spark, sf, "embeddings"))


@query
def op12_toivonen_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query
def op13_kruskal_runs(spark, sf):
    return runs.digest(runs.periodic_runs(runs.planted(table(spark, sf, "documents"))))


ORACLES["op11_m_tree_top_k"] = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

ORACLES["op12_toivonen_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), phrases AS (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
    FROM places, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1 AND f >= 10
), cuts AS (
    SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
        ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c
    JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
    JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE size = 3
        UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE size = 3
    ) GROUP BY ALL
), ranked AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
    FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
