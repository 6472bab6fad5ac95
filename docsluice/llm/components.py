"""Connected components of a graph given by its edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import Scratch


class Forest:
    """Disjoint sets of numbers, the smallest of each as its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.up]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) to its smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    told = both.join(low, "a")
    if large:
        return told.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    return told.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low")).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: columns a, b (long). Returns node, root (the component's smallest node), without the roots; its files are in `scratch`.

    Large stars and small stars in turn, until nothing changes: each turn at least halves the paths. Every
    turn is written to the shared folder. A node with very many neighbours is a key of a grouped minimum,
    which is pre-aggregated, and of a join, whose skewed partitions are split at run time."""
    now = scratch.saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (this := mark(now)) != before:
        before = this
        now = scratch.saved(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
