"""Connected components of an edge table, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.storage import stored


def _signature(edges: DataFrame) -> tuple:
    """Row count and a sum of row hashes: equal tables have equal ones."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours to the smallest node around each node.

    ``pairs`` holds (node, neighbour). The smallest neighbour is summed up before
    the shuffle; nodes with very many neighbours are never gathered.
    """
    least = pairs.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
    linked = pairs.join(least, "node")
    if larger_only:
        linked = linked.filter(F.col("near") > F.col("node"))
        return linked.select(F.col("near").alias("a"), F.col("least").alias("b"))
    both = F.explode(F.array(F.struct(F.col("near").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b"))))
    return linked.select(both.alias("e")).select("e.a", "e.b")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node with a link: the smallest id reachable.

    ``edges`` has the columns ``a`` and ``b``, in any order and number. Large-star
    and small-star steps alternate until every node points to its component's
    smallest; the number of steps grows with the logarithm of the longest chain.
    Each round is a stored table, so that lost executors cost at most one round.
    """
    distinct = lambda e: e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(distinct(edges))
    before = _signature(current)
    while before[0]:
        both = current.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("near")))
        large = distinct(_star(both, larger_only=True))
        # Here every edge leads from the larger node to the smaller one.
        current = stored(distinct(_star(large.select(F.col("a").alias("node"), F.col("b").alias("near")), larger_only=False)))
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
