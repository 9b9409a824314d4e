"""Connected components of link tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import stored


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (``a, b``).

    Every round hooks each node to the smallest of itself and its neighbours.
    Both ends of the links are then renamed by that, and links that have become
    loops or repeats go, so the next round works on a fraction of them; in the
    end the hooks are followed back. Minima are reduced before the shuffle, so a
    node with very many neighbours is no burden. Nodes should be hashes: a long
    chain in the order of its nodes would shorten by one a round.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, f"{name}-links")
    hooks = []
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"))
        hooks.append(stored(hook, f"{name}-hooks"))
        hook_a, hook_b = (hooks[-1].select(F.col("node").alias(end), F.col("component").alias(f"to_{end}")) for end in "ab")
        renamed = edges.join(hook_a, "a").join(hook_b, "b").where("to_a <> to_b")
        edges = stored(renamed.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"{name}-links")
        if edges.isEmpty():
            break
    labels = hooks.pop()
    while hooks:
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        joined = hooks.pop().join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = stored(joined, f"{name}-labels")
    return labels
