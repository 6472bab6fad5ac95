"""N-gram Jaccard join with set-relation skipping: groups of documents linked by similar shingle sets.

Equal sets are joined first: from then on a set stands for all documents that have it. Shingles are ordered
by the number of sets that have them, rare ones first; two similar sets share one of their first few. So only
shingles of these prefixes that another set has are listed, sets next to each other in a list (by size, as
far as sizes allow a link) are tied together, and within each bundle of sets so tied an exact join runs:

* index-level skipping: a shingle's list is kept in blocks of equal set size and position, and a block is
  skipped as a whole if size or position leaves too little overlap;
* answer-level skipping: a set's most similar partner is compared first. If they link, the partner's answers
  give the set's: what the partner was found to reach the set reaches too and is not compared, and a set whose
  overlap with the partner is known has the same overlap with this one, but for the elements in which the two
  differ; only those few are looked up.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.blocks import SENT, UP, Dealt, Keyed, bucket_bits, by_block, key_bits, on_blocks, pack_ints, pack_keys, payloads_by, summed, table_of, unpack_ints, unpack_keys
from docsluice.llm.common import Scratch, named, text_bytes
from docsluice.llm.components import Forest, components
from docsluice.llm.token_blocks import TokenBlock, shingle_sets, write_token_blocks

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets of a bundle that meet in one task, in bytes; larger bundles are joined in pairs of chunks.
CHUNK_BYTES = 6 << 20
#: Documents of a block have numbers below this.
DOCS = 1 << 20


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """So many first shingles of n that a similar set must share one of them."""
    return n - (n * percent + 99) // 100 + 1


def needed_overlap(n: int, m, percent: int = PERCENT):
    """100 * i >= percent * (n + m - i), for i."""
    return -(-(percent * (n + m)) // (100 + percent))


def sizes_fit(small, large, percent: int = PERCENT):
    return 100 * small >= percent * large


class SkipJoin:
    """Links within a bundle of sets. A set: its number, full size and shared shingles in global order (those
    that no other set has come before them in that order and are only counted)."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray]], percent: int = PERCENT, sides: list[int] | None = None, derive: bool = True):
        order = sorted(range(len(sets)), key=lambda i: (sets[i][1], sets[i][0]))
        self.sets, self.percent, self.derive = [sets[i] for i in order], percent, derive
        #: With two sides only pairs across them are joined: pairs within a side are another task's.
        self.sides = None if sides is None else np.array([sides[i] for i in order])
        self.sorted = [np.sort(x) for _, _, x in self.sets]
        self.group = np.arange(len(sets))
        #: Of each set: its overlaps with earlier ones, as far as they were asked for.
        self.overlaps: list[dict[int, int]] = [{} for _ in sets]
        self.compared = self.derived = self.looked_up = 0

    def _inside(self, few: np.ndarray, j: int) -> int:
        """So many of `few` are in set j."""
        b = self.sorted[j]
        self.looked_up += len(few)
        if not len(b) or not len(few):
            return 0
        at = np.searchsorted(b, few)
        at[at == len(b)] = 0
        return int(np.count_nonzero(b[at] == few))

    def _compare(self, i: int, j: int) -> int:
        self.compared += 1
        a, b = (i, j) if len(self.sorted[i]) < len(self.sorted[j]) else (j, i)
        return self._inside(self.sorted[a], b)

    def _linked(self, i: int, j: int) -> bool:
        common = self.overlaps[i][j]
        return 100 * common >= self.percent * (self.sets[i][1] + self.sets[j][1] - common)

    def _candidates(self, lists: dict, i: int) -> np.ndarray:
        """Earlier sets that share a prefix shingle and may overlap enough, those that share most first."""
        _, n, shared = self.sets[i]
        own, found = n - len(shared), []
        for k in range(max(0, prefix_length(n, self.percent) - own)):
            blocks = lists.setdefault(int(shared[k]), {})
            for (m, place), members in list(blocks.items()):
                if not sizes_fit(m, n, self.percent):
                    del blocks[m, place]  # later sets are no smaller
                elif min(own + k, place) + min(n - own - k, m - place) >= needed_overlap(n, m, self.percent):
                    found += members
            blocks.setdefault((n, own + k), []).append(i)
        if not found:
            return np.zeros(0, np.int64)
        hits = np.bincount(np.array(found))
        those = np.flatnonzero(hits)
        if self.sides is not None:
            those = those[self.sides[those] != self.sides[i]]
        return those[np.argsort(-hits[those], kind="stable")]

    def run(self) -> list[tuple[int, int]]:
        """Pairs of numbers that tie each linked group together."""
        lists: dict[int, dict] = {}
        out = []
        for i in range(len(self.sets)):
            left, like, more, less = self._candidates(lists, i), None, None, None
            while len(left):
                j = int(left[0])
                known = self.overlaps[max(like, j)].get(min(like, j)) if like is not None else None
                if known is None:
                    self.overlaps[i][j] = self._compare(i, j)
                else:
                    self.derived += 1
                    self.overlaps[i][j] = known + self._inside(more, j) - self._inside(less, j)
                if self._linked(i, j):
                    out.append((self.sets[i][0], self.sets[j][0]))
                    self.group[self.group == self.group[i]] = self.group[j]
                    left = left[self.group[left] != self.group[i]]
                    if like is None and self.derive:
                        like, a, b = j, self.sorted[i], self.sorted[j]
                        more, less = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                else:
                    left = left[1:]
        return out


def _postings(row: pa.Table, keyed: Keyed, lists: Dealt, percent: int) -> pa.Table:
    """Kind 0: for each part, the listed prefix shingles with their sets; kind 1: the sets listed."""
    block = TokenBlock(row)
    sets, ends = shingle_sets(block.words, block.tokens, block.ends)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    rep = _representatives(row)
    kinds, sums, place, _ = _counted(block, sets, starts, ends, rep, keyed)
    totals = keyed.totals(kinds, sums, row["totals"])[place]
    hashes, numbers, sizes, out, at = [], [], [], [], 0
    for idx in rep.tolist():
        a, b = starts[idx], ends[idx]
        n = int(b - a)
        total = totals[at : at + n]
        at += n
        shared = np.flatnonzero(total >= 2)
        prefix = int(prefix_length(n, percent)) - (n - len(shared))
        if prefix <= 0:
            continue
        tokens = sets[a:b][shared]
        tokens = tokens[np.lexsort((tokens, total[shared]))]
        number = block.block * DOCS + idx
        hashes.append(tokens[:prefix])
        numbers.append(np.full(prefix, number))
        sizes.append(np.full(prefix, n))
        out.append((1, number & 1023, number, n, tokens.tobytes()))
    if hashes:
        h, g, n = np.concatenate(hashes), np.concatenate(numbers), np.concatenate(sizes)
        order = np.argsort(h, kind="stable")
        h, g, n = h[order], g[order].astype(np.uint64), n[order].astype(np.uint64)
        edges = lists.part_edges(h)
        for part in np.flatnonzero(np.diff(edges)).tolist():
            x, y = edges[part : part + 2]
            out.append((0, part, block.block, 0, pack_keys(lists.within_part(h[x:y])) + pack_ints(g[x:y]) + pack_ints(n[x:y])))
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("kind", "bucket", "number", "n", "payload"), columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})


def _representatives(row: pa.Table) -> np.ndarray:
    return np.sort(np.array(row["reps"][0].as_py() or [], np.int64))


def _counted(block: TokenBlock, sets, starts, ends, rep, keyed: Keyed):
    picked = np.concatenate([np.arange(starts[i], ends[i]) for i in rep.tolist()]) if len(rep) else np.zeros(0, np.int64)
    kinds, sums, place = summed(keyed.keys(sets[picked]))
    return kinds, sums, place, picked


def _listed(payloads: list[memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles with a set and its size each, of several payloads."""
    h, g, n = [], [], []
    for payload in payloads:
        x, rest = unpack_keys(payload)
        y, rest = unpack_ints(rest)
        h.append(x)
        g.append(y)
        n.append(unpack_ints(rest)[0])
    return tuple(np.concatenate(x) for x in (h, g, n))


def _lists_of_group(table: pa.Table, lists: Dealt) -> pa.Table:
    """Rows of UP of what a group of blocks has listed in a part."""
    part, grp = table["part"][0].as_py(), table["grp"][0].as_py()
    h, g, n = _listed([x for _, x in payloads_by(table, "block")])
    order = np.argsort(h, kind="stable")
    h, g, n = h[order], g[order], n[order]
    edges, out = lists.inner_edges(h), []
    for i in np.flatnonzero(np.diff(edges)).tolist():
        x, y = edges[i : i + 2]
        out.append((part << lists.inner_bits | i, part, grp, pack_keys(lists.within_bucket(h[x:y])) + pack_ints(g[x:y]) + pack_ints(n[x:y])))
    return table_of(UP, out)


def _tie(table: pa.Table, percent: int) -> pa.Table:
    """Neighbours in the lists of a bucket, tied into stars."""
    h, g, n = _listed([x for _, x in payloads_by(table, "grp")])
    order = np.lexsort((g, n, h))
    h, g, n = h[order], g[order].astype(np.int64), n[order].astype(np.int64)
    tied = (h[1:] == h[:-1]) & sizes_fit(n[:-1], n[1:], percent)
    pairs = np.unique(np.sort(np.stack((g[:-1][tied], g[1:][tied]), 1), axis=1), axis=0)
    forest = Forest()
    for a, b in pairs.tolist():
        forest.join(a, b)
    stars = forest.stars()
    return pa.table({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})


def _join_bundle(table: pa.Table, percent: int) -> pa.Table:
    bundles: dict[int, list] = {}
    for root, number, n, chunk, payload in zip(table["root"].to_pylist(), table["number"].to_pylist(), table["n"].to_pylist(), table["chunk"].to_pylist(), table["payload"].to_pylist(), strict=True):
        bundles.setdefault(root, []).append((number, n, np.frombuffer(payload, np.uint64), chunk))
    links = []
    for sets in bundles.values():
        sides = [x[3] for x in sets]
        links += SkipJoin([x[:3] for x in sets], percent, sides if len(set(sides)) > 1 else None).run()
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, block, idx (the row's place in the input).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct 5-word
    shingles (fewer words: the whole sequence as one; none: empty and linked with nothing). component_id is
    the smallest doc_id reached by links, the own one included. Every link counts: nothing is approximated
    but for 64-bit hashes of shingles. Repeated rows are documents with equal sets; a null id (or one that is
    no integer) is passed over in the minimum and gets the group's, or null in a group of its own kind. Very
    long texts are sets of many shingles and joined like others. Only the id and the text are looked at.

    The result is a table in `scratch`; all else is deleted.
    """
    total = text_bytes(docs, text_col)
    keyed, lists = Keyed(key_bits(total, 12), bucket_bits(total)), Dealt(64, bucket_bits(total))

    def count(row: pa.Table) -> pa.Table:
        block = TokenBlock(row)
        sets, ends = shingle_sets(block.words, block.tokens, block.ends)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        kinds, sums, _, _ = _counted(block, sets, starts, ends, _representatives(row), keyed)
        return table_of(SENT, keyed.send(block.block, kinds, sums))

    with Scratch(docs.sparkSession) as tmp:
        blocks = write_token_blocks(docs, tmp, "shingles", id_col=id_col, text_col=text_col, with_sets=True)
        rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes", "prints", "more_prints")).alias("idx", "x")).select("block", "idx", F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").alias("n"), F.col("x.prints").alias("p"), F.col("x.more_prints").alias("q"))
        rows = tmp.saved(rows, "rows")
        classes = tmp.saved(rows.where("n > 0").groupBy("p", "q", "n").agg(F.min("doc_id").alias("low"), F.min(F.struct("block", "idx")).alias("rep")).select("p", "q", "n", "low", (F.col("rep.block") * DOCS + F.col("rep.idx")).alias("number")), "classes")
        reps = by_block(classes.select(F.shiftright("number", 20).alias("block"), F.col("number").bitwiseAND(DOCS - 1).alias("payload")), tmp, "reps")
        words = blocks.select("block", "doc_ids", "flags", "ends", "words", "tokens")
        totals = keyed.merge(on_blocks(words, count, SENT, reps=reps), tmp, "shared")
        listed = tmp.saved(on_blocks(words, lambda row: _postings(row, keyed, lists, percent), "kind int, bucket long, number long, n long, payload binary", reps=reps, totals=totals), "lists", "kind")
        sent = listed.where("kind = 0").select(F.col("bucket").alias("part"), F.col("number").alias("block"), "payload")
        ties = lists.settled(sent, lambda t: _lists_of_group(t, lists), lambda t: _tie(t, percent), "a long, b long")
        bundles = components(ties, tmp)

        sets = listed.where("kind = 1").select("number", "n", "payload")
        tied = bundles.join(sets.select(F.col("number").alias("node"), F.length("payload").alias("bytes")), "node").groupBy("root").agg(F.sum("bytes").alias("bytes"))
        members = bundles.union(bundles.select("root", "root").distinct())
        chunks = F.ceil(F.col("bytes") / chunk_bytes)
        placed = sets.join(members, sets["number"] == members["node"]).join(tied, "root").select("root", "number", "n", "payload", chunks.alias("chunks"), F.pmod(F.xxhash64("number"), chunks).alias("chunk"))
        small = F.struct((-1 - F.pmod(F.xxhash64("root"), F.lit(8 << keyed.bucket_bits))).alias("pack"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("root").alias("pack"), F.least("chunk", c).alias("i"), F.greatest("chunk", c).alias("j")))
        each = F.explode(F.when(F.col("chunks") > 1, pairs).otherwise(F.array(small)))
        links = placed.withColumn("task", each).groupBy("task.pack", "task.i", "task.j").applyInArrow(lambda t: _join_bundle(t, percent), "a long, b long")
        linked = components(links, tmp)

        of_set = classes.join(linked, classes["number"] == linked["node"], "left").select("p", "q", "n", "low", F.coalesce("root", "number").alias("root"))
        component = of_set.groupBy("root").agg(F.min("low").alias("component_id"))
        of_set = of_set.join(component, "root").select("p", "q", "n", "component_id")
        out = rows.join(of_set, ["p", "q", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "block", "idx")
        return (scratch or Scratch(docs.sparkSession)).saved(out, "groups")


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """The documents with the smallest id of each group of `similar_groups`, with all their columns.

    Documents of no words are groups of their own. Rows that share an id count as one document: they stay or
    go together, and of rows equal in id and text one stays. Rows with a null id stay. The input is read
    again by the result; the groups are a table in `scratch`.
    """
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, percent=percent, scratch=scratch).select("doc_id", "component_id").where("doc_id is not null")
    of_kept = f"id_{uuid.uuid4().hex}"  # no column of the input has this name
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(of_kept)).distinct()
    number = named(id_col).try_cast("long")
    # ids by the million must not meet in the driver, so they are never broadcast, however few they seem
    stay = docs.join(kept.hint("merge"), number == F.col(of_kept), "left_semi")
    if not groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates([id_col, text_col])
    return stay.union(docs.where(number.isNull()))
