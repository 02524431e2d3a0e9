"""Connected components by alternating stars: a distributed union-find.

Every round links each node to the least node that it or its neighbours know; edges and minima are written to the
shared folder, so no round depends on an earlier one's executors.  Minima are combined before they are shuffled and
joined as plain tables, so a node with very many links is split by the engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_table, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any ordered type -> (node, component), the least node that is reachable; nodes without a link
    to another are left out.  Repeated and self links do no harm."""
    least = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # structs have no greatest(): compare them instead
    if edges.schema["a"].dataType.typeName() == "struct":
        least = lambda df: df.where("a <> b").select(F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a") > F.col("b"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    held = materialize(least(edges), "edges")
    seen = None
    while True:
        mark = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == seen:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(mark)
        # large star: what lies above a node links to the least that the node knows
        known = held.select(F.col("b").alias("u"), F.col("b").alias("m")).union(held.select(F.col("a").alias("u"), F.col("b").alias("m")))
        lower = materialize(known.groupBy("u").agg(F.min("m").alias("m")), "minima")
        large = held.join(lower, held["b"] == lower["u"]).select("a", F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        # small star: what lies below a node links to the least of them, as does the node
        own = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(own.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(least(small.union(own.select("a", F.col("m").alias("b")))), "edges")
        for df in (held, lower, large, own):
            drop_table(df)
        held = nxt


class Forest:
    """Union-find over 0..n-1; the least index is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, at: np.ndarray) -> None:
        """Make one tree of all that ``at`` names."""
        r = self.roots(at)
        self.parent[r] = r.min()

    def all(self) -> np.ndarray:
        return self.roots(np.arange(len(self.parent)))
