"""Connected components of an edge table by hooking to the smallest neighbour and jumping pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.session import cut

#: Edges that one task joins by itself; rounds over so few would cost the driver more in jobs than they spare.
FEW = 1 << 17


def roots(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """The representative of each of ``count`` numbers under the edges x, y: larger roots hook to smaller ones, then pointers jump."""
    to = np.arange(count)
    while True:
        a, b = to[x], to[y]
        live = a != b
        if not live.any():
            return to
        x, y, a, b = x[live], y[live], a[live], b[live]
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]


def joined_at_once(live: DataFrame) -> DataFrame:
    """(a, to) of every id on ``live``, which has ``FEW`` edges at most: one task, no round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            edges = pd.concat(parts, ignore_index=True)
            code, ids = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
            ids = np.asarray(ids)
            yield pd.DataFrame({"a": ids, "to": ids[roots(code[: len(edges)], code[len(edges) :], len(ids))]})

    kind = live.schema["a"].dataType
    return live.coalesce(1).mapInPandas(run, StructType([StructField("a", kind), StructField("to", kind)]))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b), undirected -> (id, component): the smallest id reachable, for every id on an edge.

    Each round every node points to the smallest node around it, pointers are doubled until all reach a root (so a
    chain of n takes log n steps), and edges are redrawn between roots. Aggregations are combined before the shuffle,
    so hubs do not pile up in a task. What is left once ``FEW`` edges remain is joined in one task.
    """
    both = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    live = cut(both.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = both.select(F.col("a").alias("id")).union(both.select(F.col("b").alias("id"))).distinct()
    steps = []
    for _ in range(rounds):
        left = live.count()
        if not left:
            break
        if left <= FEW:
            steps.append(cut(joined_at_once(live)))
            break
        ways = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        step = cut(low.withColumn("moved", F.lit(True)))
        while not step.filter("moved").isEmpty():
            ahead = step.select(F.col("a").alias("m"), F.col("m").alias("next"))
            step = cut(step.join(ahead, "m").select("a", F.col("next").alias("m"), (F.col("next") != F.col("m")).alias("moved")))
        step = step.select("a", F.col("m").alias("to"))
        steps.append(step)
        one = live.join(step, "a").select(F.col("to").alias("a"), "b")
        two = one.join(step.withColumnsRenamed({"a": "b", "to": "bt"}), "b").select("a", F.col("bt").alias("b"))
        live = cut(two.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    out = nodes.withColumn("component", F.col("id"))
    for n, step in enumerate(steps):
        hop = step.select(F.col("a").alias("component"), F.col("to").alias("next"))
        out = out.join(hop, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
        if n % 6 == 5:
            out = cut(out)
    # Labels are members; the smallest member of each class names it.
    named = out.groupBy("component").agg(F.min("id").alias("least"))
    return out.join(named, "component").select("id", F.col("least").alias("component"))
