"""Connected components by alternating large-star and small-star rounds; links never leave the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .common import keep


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (u, v): each node but the smallest of its component, and that smallest node."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # hooking the labels themselves, not only the ends, keeps the number of rounds logarithmic
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v: long) to (node, component: long), component being the smallest node reachable.

    Nodes without a link to another node are not in the result. Every round writes its tables to the shared folder and deletes
    those of the round before; the smallest neighbours are one of them, so that both sides of the join are plain and Spark can
    split the links of a hub over tasks. Stops when a round changes nothing; raises if ``rounds`` did not do.
    """
    spark, start = edges.sparkSession, scratch.mark()
    edges = keep(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS c", "least(u, m) AS m"), "low")
        large = both.filter("v > u").join(low, F.col("u") == F.col("c")).selectExpr("v AS u", "m AS v").filter("u <> v")
        large = keep(large.distinct(), "large")
        # after the large star every link points from a node to a smaller one
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS c", "m"), "low")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(ends).alias("e"))
        edges = keep(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        scratch.clear(spark, start, but=1)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
