"""A Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups, a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import Scratch, buckets_of, named

FANOUT = 16
#: Levels of the tree that one block of FANOUT ** LEVELS neighbours holds.
LEVELS = 3
HEX = 64
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for a null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _hexes(rows) -> np.ndarray:
    """The digests of rows of bytes, as a contiguous matrix of their hexadecimal text."""
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, HEX)


def tree_levels(leaves: np.ndarray, fanout: int, levels: int | None) -> list[np.ndarray]:
    """The levels above a matrix of leaves, itself first: so many, or (None) until one node is left."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        nodes = out[-1]
        full = len(nodes) // fanout * fanout
        runs = list(nodes[:full].reshape(-1, fanout * HEX))
        out.append(_hexes(runs + [nodes[full:].reshape(-1)] * (full < len(nodes))))
    return out


def siblings(nodes: np.ndarray, at: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes at these places: which nodes their runs have (as places), which of these count (a last run
    may be shorter), and the own place in the run."""
    start = at - at % fanout
    run = start[:, None] + np.arange(fanout)
    return np.minimum(run, len(nodes) - 1), run < len(nodes), at - start


def _folded(levels: list[np.ndarray], at: np.ndarray, claimed: np.ndarray, fanout: int) -> np.ndarray:
    """The nodes that claimed leaves lead to on the last level, each beside the siblings of its place."""
    for nodes in levels[:-1]:
        run, there, own = siblings(nodes, at, fanout)
        beside = nodes[run]
        beside[np.arange(len(at)), own] = claimed
        claimed = _hexes(x[ok].reshape(-1) for x, ok in zip(beside, there, strict=True))
        at = at // fanout
    return claimed


def _siblings_text(levels: list[np.ndarray], at: np.ndarray, fanout: int) -> list[list[bytes]]:
    """For each leaf, and each level, the text of the siblings from left to right."""
    out: list[list[bytes]] = [[] for _ in at]
    for nodes in levels[:-1]:
        run, there, own = siblings(nodes, at, fanout)
        there[np.arange(len(at)), own] = False
        for told, places, ok in zip(out, run, there, strict=True):
            told.append(nodes[places[ok]].tobytes())
        at = at // fanout
    return out


def _block(table: pa.Table, fanout: int, height: int) -> tuple[pa.Table, list[np.ndarray]]:
    """A block's rows in order, and its levels."""
    table = table.sort_by("rank")
    nodes = np.frombuffer("".join(table["node"].to_pylist()).encode(), np.uint8).reshape(-1, HEX)
    return table, tree_levels(nodes, fanout, height if table["total"][0].as_py() > fanout**height else None)


class _Tree:
    """One tree for each group of a table of (grp, rank, total, node, ...), in blocks of neighbours: `layers[0]` is
    the table, each next one has the tops of the blocks below, where a group has more than one."""

    def __init__(self, ranked: DataFrame, scratch: Scratch, fanout: int, levels: int):
        self.scratch, self.fanout, self.height = scratch, fanout, levels
        self.layers, self.ends = [ranked], []
        most = ranked.agg(F.max("total")).first()[0] or 0
        while True:
            tops = scratch.saved(self._up(self.layers[-1]), "tops")
            self.ends.append(tops.where("total = 1"))
            most = -(-most // fanout**levels)
            if most <= 1:
                break
            self.layers.append(tops.where("total > 1"))

    def _blocks(self, layer: DataFrame):
        return layer.withColumn("block", F.expr(f"rank div {self.fanout**self.height}")).groupBy("grp", "block")

    def _up(self, layer: DataFrame) -> DataFrame:
        fanout, height = self.fanout, self.height

        def top(table: pa.Table) -> pa.Table:
            table, tree = _block(table, fanout, height)
            total = -(-table["total"][0].as_py() // fanout**height)
            return pa.table({"grp": table["grp"][:1], "rank": table["block"][:1], "total": pa.array([total], pa.int64()), "node": pa.array([tree[-1].tobytes().decode()], pa.string())})

        return self._blocks(layer.select("grp", "rank", "total", "node")).applyInArrow(top, "grp string, rank long, total long, node string")

    def tops(self) -> DataFrame:
        """grp, node: each group's single last node."""
        return reduce(DataFrame.union, self.ends).select("grp", "node")

    def down(self, above: DataFrame, finish, schema: str) -> DataFrame:
        """From the tops to the rows: each block of the table meets the path from its top upwards. above: grp, top
        (the group's last node), path (upwards from there). finish: a block, its levels, and these two to the result's rows."""
        fanout, height, path = self.fanout, self.height, None
        for i in reversed(range(len(self.layers))):
            ending = above.join(self.ends[i].select("grp"), "grp", "left_semi").select("grp", F.lit(0).cast("long").alias("block"), "top", "path")
            path = path.union(ending) if path else ending
            met = self._blocks(self.layers[i]).cogroup(path.toDF(*path.columns).groupBy("grp", "block"))

            def one(table: pa.Table, way: pa.Table, *, last=i == 0) -> pa.Table:
                table, tree = _block(table, fanout, height)
                up, top = way["path"][0].as_py(), way["top"][0].as_py()
                if last:
                    return finish(table, tree, up, top)
                return pa.table({"grp": table["grp"], "block": table["rank"], "top": pa.array([top] * len(table), pa.string()), "path": pa.array([p + up for p in _paths(tree, fanout)], _ARROW_PATH)})

            if i:
                path = self.scratch.saved(met.applyInArrow(one, f"grp string, block long, top string, path {_PATH}"), "paths")
        return met.applyInArrow(one, schema)


_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(levels: list[np.ndarray], fanout: int) -> list[list[dict]]:
    """For each leaf, and each level, the text of the siblings to the left and to the right."""
    at, out = np.arange(len(levels[0])), [[] for _ in levels[0]]
    for nodes in levels[:-1]:
        run, there, own = siblings(nodes, at, fanout)
        for told, places, ok, mine in zip(out, run, there, own, strict=True):
            beside = nodes[places[ok]].tobytes().decode()
            told.append({"left": beside[: HEX * mine], "right": beside[HEX * (mine + 1) :]})
        at = at // fanout
    return out


def _ranked(df: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """df (a written table with `grp` and `place`) with `rank` from 0 and `total` within grp.

    Rows are sorted over range partitions; a partition's first rank in a group is the sum of the group's counts in
    the partitions before, so a group of any size takes as many tasks as it fills. `place` tells rows equal in all
    else apart, so these don't fill one partition either."""
    ranged = df.repartitionByRange(buckets_of(df.sparkSession), "grp", *order, "place").sortWithinPartitions("grp", *order, "place")
    ranged = scratch.saved(ranged.drop("place").withColumn("at", F.monotonically_increasing_id()), "in-order").withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("grp", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = counts.select("grp", "part", (F.col("low") - before).alias("low"), F.sum("n").over(group).alias("total"))
    ranged = ranged.join(scratch.saved(counts, "counts"), ["grp", "part"]).withColumn("rank", F.col("at") - F.col("low"))
    return scratch.saved(ranged.drop("part", "at", "low"), "ranked")


def merkle_manifest(
    df: DataFrame, fields: Sequence[str], *, id_col: str = "doc_id", group_col: str = "source", claimed: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS, with_siblings: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each row of `df`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and `siblings`).

    A leaf is the sha256 of `fields`, in this order. The leaves of a group stand by ascending id; `fanout` neighbours
    each are hashed to one node, until one is left: the subroot. The groups' subroots, null first and then by the bytes
    of their names, are hashed likewise to the root. A row's proof is the text of the siblings from its leaf to the root,
    from left to right on each level (`siblings`, an array by level; `proof_sha256` is the sha256 of all of it). `claimed`
    is a leaf that someone else has for the row (null: the row's own): it is hashed up with the siblings to
    `folded_root`, and is `verified` where that is the root.

    Leaves are made in generated code and written, digests only, so texts never meet an exchange. Ranks within groups come
    from range partitions. A block has `fanout ** levels` neighbours of a group, as one contiguous matrix
    of digests in a task; its top goes on to the next layer, of which there are as many as the largest group needs (a group of a third of all rows
    is many blocks). Paths come down in the same blocks, so no row carries a proof between tasks.

    Null ids come first; rows equal in id stand by leaf, and equal leaves have places of their own. An empty text isn't a
    null one. Very long texts are hashed like others; clashing or dotted column names don't matter. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    group, leaf = named(group_col).cast("string"), leaf_digest(*(named(c) for c in fields))
    claimed = F.lit(None).cast("string") if claimed is None else claimed
    rows = df.select(named(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"), leaf.alias("node"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("place"))
    with Scratch(spark) as tmp:
        tree = _Tree(_ranked(tmp.saved(rows, "leaves"), tmp, "doc_id", "node"), tmp, fanout, levels)
        subroots = tree.tops().select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node", F.lit(0).alias("place"))
        above = _Tree(_ranked(tmp.saved(subroots, "subroots"), tmp, "key"), tmp, fanout, levels)
        root = (above.tops().first() or [None, None])[1]
        ends = above.tops().select("grp", F.col("node").alias("top"), F.array().cast(_PATH).alias("path"))
        ways = above.down(ends, lambda table, tree, up, top: pa.table({"grp": table["key"], "top": table["node"], "path": pa.array([p + up for p in _paths(tree, fanout)], _ARROW_PATH)}), f"grp string, top string, path {_PATH}")
        ways = tmp.saved(ways, "ways")
        kind = rows.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string" + ", siblings array<string>" * with_siblings

        def prove(table: pa.Table, tree: list[np.ndarray], up: list[dict], top: str) -> pa.Table:
            claims = "".join(c or x for c, x in zip(table["claimed"].to_pylist(), table["node"].to_pylist(), strict=True))
            places = np.arange(len(tree[0]))
            tops = _folded(tree, places, np.frombuffer(claims.encode(), np.uint8).reshape(-1, HEX), fanout)
            higher = [(x["left"] + x["right"]).encode() for x in up]
            beside, roots, proofs = _siblings_text(tree, places, fanout), {}, []
            for node in {x.tobytes() for x in tops}:
                now = node.decode()
                for x in up:
                    now = hashlib.sha256((x["left"] + now + x["right"]).encode()).hexdigest()
                roots[node] = now
            ends = b"".join(higher)
            for own in beside:
                proofs.append(hashlib.sha256(b"".join(own) + ends).hexdigest())
            out = {"doc_id": table["doc_id"], "leaf": table["node"], "subroot": pa.array([top] * len(table), pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array([roots[x.tobytes()] for x in tops], pa.string())}
            if with_siblings:
                out["siblings"] = pa.array([[x.decode() for x in own + higher] for own in beside], pa.list_(pa.string()))
            return pa.table(out)

        told = tree.down(ways, prove, schema)
        told = told.withColumns({"root": F.lit(root).cast("string"), "verified": F.col("folded_root") == F.lit(root)})
        told = told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["siblings"] * with_siblings)
        return scratch.saved(told, "manifest")
