"""Configured fields that stand in property bags only, and facets over values, ranges and queries."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doccat.operators import search as Q

BAGS = {
    "1": {"author": ["Jo Doe", "Al Poe"], "Word-Count": ["12", "x"], "dcterms:created": ["2010-04-02T14:49:43Z"]},
    "2": {"author": ["jo"], "Word-Count": ["7"], "dcterms_created": ["2011-01-01", "nonsense"], "template": ["Letter"]},
    "3": {"author": [], "Word-Count": ["many"], "template": ["letter", "Note"]},
    "4": {},
    "5": None,
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(BAGS.items()), "id string, props map<string, array<string>>")


def ids(df) -> set[str]:
    return {r.id for r in df.collect()}


def test_text_fields(rows):
    assert ids(Q.match_field(rows, "author", "DOE nobody")) == {"1"}
    assert ids(Q.match_field(rows, "author", "jo")) == {"1", "2"}
    assert ids(Q.match_prefix(rows, "po*", "author")) == {"1"}
    assert ids(Q.match_prefix(rows, "*", "author")) == {"1", "2"}
    assert ids(Q.match_wildcard(rows, "?oe", "author")) == {"1"}


def test_exact_fields_keep_case(rows):
    assert ids(Q.match_field(rows, "template", "Letter")) == {"2"}
    assert ids(Q.match_prefix(rows, "No", "template")) == {"3"}
    assert ids(Q.match_wildcard(rows, "?etter", "template")) == {"2", "3"}


def test_numbers_and_times(rows):
    assert ids(Q.match_range(rows, "Word-Count", 8)) == {"1"}
    assert ids(Q.match_range(rows, "Word-Count")) == {"1", "2"}
    assert ids(Q.match_field(rows, "Word-Count", 7)) == {"2"}
    low = F.lit("2010-06-01").cast("timestamp")
    assert ids(Q.match_range(rows, "dcterms_created", low)) == {"2"}
    assert ids(Q.match_range(rows, "dcterms_created", None, low)) == {"1"}


def test_unknown_and_unsearchable_fields(rows):
    for field, reason in (("nothing", "nothing"), ("url", "not indexed")):
        with pytest.raises(ValueError, match=reason):
            Q.match_field(rows, field, "x")
    with pytest.raises(ValueError):
        Q.match_field(rows.drop("props"), "author", "x")


def test_a_column_goes_before_the_bag(rows):
    named = rows.withColumn("author", F.lit("Zoe"))
    assert ids(Q.match_field(named, "author", "zoe")) == set(BAGS) and not ids(Q.match_field(named, "author", "doe"))


def test_lifted(rows):
    got = {r.id: (r["Word-Count"], r.author) for r in Q.lifted(rows, "Word-Count", "author").collect()}
    assert got == {"1": ([12], ["Jo Doe", "Al Poe"]), "2": ([7], ["jo"]), "3": (None, None), "4": (None, None), "5": (None, None)}


def counts(df) -> dict:
    got = [((r.field, r.value), r.n) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    table = [(str(i), rng.choice("abcdefgh") if i % 9 else None, rng.randrange(100) if i % 7 else None, [rng.randrange(10) for _ in range(rng.randrange(4))])
             for i in range(500)]
    return table, spark.createDataFrame(table, "id string, letter string, n int, tags array<int>").repartition(7)


def test_facets_against_plain_counts(many):
    table, rows = many
    got = counts(Q.facets(rows, ["letter", "tags"], ranges={"n": [10, 20, 50, 90], "tags": [2, 4, 6]},
                          queries={"high": F.col("n") > 60, "none": F.col("n") > 1000, "unknown": F.lit(None).cast("boolean")}))
    want = Counter(("letter", r[1]) for r in table if r[1])
    want.update(("tags", str(t)) for r in table for t in set(r[3]))
    for low, high in ((10, 20), (20, 50), (50, 90)):
        want["n", str(low)] = sum(r[2] is not None and low <= r[2] < high for r in table)
    tags = Counter(str(low) for r in table for low, high in ((2, 4), (4, 6)) if any(low <= t < high for t in r[3]))
    want.update({("query", "high"): sum((r[2] or 0) > 60 for r in table), ("query", "none"): 0, ("query", "unknown"): 0})
    for low in ("2", "4"):  # a field asked for both ways under one name adds up
        want["tags", low] += tags[low]
    assert got == dict(want)


def test_facets_limit_is_taken_in_every_task(many):
    table, rows = many
    top = Q.facets(rows, ["letter"], limit=3, ranges={"n": [0, 1, 2, 3, 4, 5]}, queries={"high": F.col("n") > 60})
    letters = sorted(Counter(r[1] for r in table if r[1]).items(), key=lambda p: (-p[1], p[0]))[:3]
    got = counts(top)
    assert {k: n for k, n in got.items() if k[0] == "letter"} == {("letter", v): n for v, n in letters}
    assert len(got) == 3 + 5 + 1
    plan = Q.facets(rows, ["letter"], limit=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_facets_of_no_rows(many):
    _, rows = many
    none = rows.where("id = 'x'")
    assert counts(Q.facets(none, ["letter"], ranges={"n": [1, 2]}, queries={"q": F.lit(True)})) == {("n", "1"): 0, ("query", "q"): 0}
    assert counts(Q.facets(none, ["letter"], limit=2)) == {}
