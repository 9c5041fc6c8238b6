"""Merkle manifest of a table with proofs for many rows at once, by octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each told with its byte length. Leaves of one group (tree) ascend by key; while
more than one node remains, two consecutive ones become their hash, a last odd one the hash of itself. The groups' roots, ordered by
group, are the leaves of one more tree of the same kind, whose root stands for the whole table.

Positions are exact ranks of a range sort. A *leaf partition* is a run of ``2**bits`` neighbouring positions of one tree.

- ``tree_nodes`` makes all inner nodes in rounds of ``bits`` levels: a task hashes the nodes of one partition up to its top, the tops
  are the leaves of the next round. No task holds more than ``2**bits`` nodes, whatever share of the rows a group has.
- ``prove`` gives the siblings of each asked leaf. Each partition computes the coordinates of the nodes that its leaves need and
  that do not follow from them (the octopus: level by level, the siblings of known nodes that are not known themselves), the
  union of all partitions' coordinates is fetched from the node table by one join, and each partition derives its shared inner nodes from its
  leaves and expands the proofs. A node near a root is asked for by many partitions; such requests are keyed by stretches of 64
  partitions and the node is copied to each, so no key has more than 64 requests.

Rows with equal keys are ordered by their digest; rows equal in both are copies of each other and take neighbouring places. A null group is a
group of its own and comes first; a null key comes first. Null fields are told as ``-``. An empty table has no leaves and no root.
Other columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dyadspark.operators.ranking import ranked
from dyadspark.session import materialise

BITS = 12
_TOGETHER = 6  # log2 of the partitions whose requests for one node share a key
SIBLINGS = "array<struct<left: boolean, digest: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def told(value: Column) -> Column:
    """Byte length, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return digest(*map(told, fields))


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, int(n) - 1).bit_length()


def place_leaves(rows: DataFrame, group: str, key: str, leaf: str = "leaf") -> DataFrame:
    """``rows`` with tree (string, in the order of groups), pos (place in its tree) and n (leaves of its tree).

    ``rows`` is sorted with all its columns, so give only those to carry, and none of these names.
    """
    tree = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))
    written = materialise(rows.withColumns({"tree": tree, "_row": F.monotonically_increasing_id()}))
    placed = ranked(written, "tree", F.col(key).asc_nulls_first(), leaf, "_row", rank="_rank").drop("_row")
    trees = placed.groupBy("tree").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    return materialise(placed.join(trees, "tree").withColumn("pos", F.col("_rank") - F.col("_first")).drop("_rank", "_first"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _parents(indices: np.ndarray, digests: list[str]) -> tuple[np.ndarray, list[str]]:
    """The nodes above consecutive nodes that begin with a left child."""
    whole = [_hash(a + b) for a, b in zip(digests[::2], digests[1::2])]
    if len(digests) % 2:
        whole.append(_hash(digests[-1]))
    return indices[::2] >> 1, whole


def tree_nodes(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """tree, n, level (1..), idx, digest of all nodes above ``leaves`` (tree, n, pos, digest)."""

    def climb(base: int):
        def hash_block(table: pa.Table) -> pa.Table:
            n = table.column("n")[0].as_py()
            order = np.argsort(table.column("idx").to_numpy())
            indices, digests = table.column("idx").to_numpy()[order], table.column("digest").take(pa.array(order)).to_pylist()
            levels, all_indices, all_digests = [], [], []
            for level in range(base + 1, min(base + bits, height(n)) + 1):
                indices, digests = _parents(indices, digests)
                levels.append(np.full(len(indices), level, dtype=np.int32))
                all_indices.append(indices)
                all_digests += digests
            size = len(all_digests)
            return pa.table({
                "tree": pa.repeat(table.column("tree")[0], size), "n": pa.repeat(table.column("n")[0], size),
                "level": pa.array(np.concatenate(levels)), "idx": pa.array(np.concatenate(all_indices)),
                "digest": pa.array(all_digests, pa.string())})

        return hash_block

    nodes, level = leaves.select("tree", "n", F.col("pos").alias("idx"), "digest"), 0
    most = leaves.agg(F.max("n")).first()[0] or 0
    made = []
    while level < height(most):
        below = nodes.where(F.col("n") > (1 << level)).withColumn("_block", F.shiftright("idx", bits))
        made.append(materialise(
            below.groupBy("tree", "_block").applyInArrow(climb(level), "tree string, n long, level int, idx long, digest string")))
        level += bits
        nodes = made[-1].where(F.col("level") == level)
    if not made:
        return leaves.select("tree", "n", F.lit(1).alias("level"), F.col("pos").alias("idx"), "digest").where("false")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree and digest of the root of each tree."""
    tops = nodes.where((F.col("idx") == 0) & F.expr("shiftleft(1L, level) >= n"))
    return leaves.where(F.col("n") == 1).select("tree", "digest").unionByName(tops.select("tree", "digest"))


def missing_nodes(positions: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The octopus of some leaves of a tree of n: per level the indices of nodes that their proofs need and they do not give."""
    known, out = np.unique(positions), []
    for level in range(height(n)):
        beside = known ^ 1
        beside = beside[beside <= (n - 1) >> level]
        out.append((level, np.setdiff1d(beside, known)))
        known = np.unique(known >> 1)
    return out


def _request_key(level: Column, block: Column, bits: int) -> Column:
    return F.when(level >= bits + _TOGETHER, F.shiftright(block, _TOGETHER)).otherwise(F.lit(-1))


def prove(asked: DataFrame, leaves: DataFrame, nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``asked`` (rows of ``leaves``: tree, n, pos, digest and any others) with siblings, from the leaf's level up to its tree's root.

    An element says whether the sibling stands on the left, and its digest; both are null where a node is hashed alone.
    """
    blocks = asked.withColumn("_block", F.shiftright("pos", bits))

    def octopus(table: pa.Table) -> pa.Table:
        found = missing_nodes(table.column("pos").to_numpy(), table.column("n")[0].as_py())
        levels = np.concatenate([np.full(len(i), level, dtype=np.int32) for level, i in found] or [np.zeros(0, np.int32)])
        indices = np.concatenate([i for _, i in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({
            "tree": pa.repeat(table.column("tree")[0], len(levels)), "_block": pa.repeat(table.column("_block")[0], len(levels)),
            "level": pa.array(levels), "idx": pa.array(indices)})

    requests = materialise(
        blocks.select("tree", "_block", "n", "pos").groupBy("tree", "_block")
        .applyInArrow(octopus, "tree string, _block long, level int, idx long")
        .withColumn("_key", _request_key(F.col("level"), F.col("_block"), bits)))
    lowest = requests.agg(F.min("level")).first()[0]
    # a node of a level above the partitions serves all partitions below its sibling
    up = bits + _TOGETHER
    served = F.expr(
        f"CASE WHEN level >= {up} THEN sequence(shiftleft(idx ^ 1, level - {up}), shiftleft((idx ^ 1) + 1, level - {up}) - 1)"
        " ELSE array(-1L) END")
    stored = nodes.select("tree", "level", "idx", "digest").where(F.col("level") >= F.lit(lowest if lowest is not None else 0))
    if lowest == 0:
        stored = stored.unionByName(leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest"))
    # a stretch beyond the tree's end is asked for by nobody
    fetched = materialise(requests.join(
        stored.withColumn("_key", F.explode(served)), ["tree", "level", "idx", "_key"]
    ).select("tree", "_block", "level", "idx", "digest"))

    names = asked.columns

    def expand(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        n, positions = mine.column("n")[0].as_py(), mine.column("pos").to_numpy()
        levels, indices = theirs.column("level").to_numpy(), theirs.column("idx").to_numpy()
        given = theirs.column("digest").to_pylist()
        known = dict(zip(positions.tolist(), mine.column("digest").to_pylist()))
        pool: list = [None]
        picks, lefts = [], []
        at = positions
        for level in range(height(n)):
            for i in np.flatnonzero(levels == level).tolist():
                known[int(indices[i])] = given[i]
            slots = {}
            for i, d in known.items():
                slots[i] = len(pool)
                pool.append(d)
            beside = at ^ 1
            picks.append(np.array([slots.get(i, 0) for i in beside.tolist()], dtype=np.int64))
            lefts.append((at & 1).astype(bool))
            above = {}
            for i in known:
                if i >> 1 not in above:
                    a = known[i & ~1]
                    above[i >> 1] = _hash(a + known[i | 1]) if i | 1 in known else _hash(a)
            known, at = above, at >> 1
        rows, tall = len(positions), height(n)
        pick = np.stack(picks, axis=1).ravel() if tall else np.zeros(0, dtype=np.int64)
        left = np.stack(lefts, axis=1).ravel() if tall else np.zeros(0, dtype=bool)
        alone = pick == 0
        values = pa.StructArray.from_arrays(
            [pa.array(left, mask=alone), pa.array(pool, pa.string()).take(pa.array(pick))], names=["left", "digest"])
        siblings = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * tall, pa.int32()), values)
        return pa.table([*(mine.column(c) for c in names), siblings], names=[*names, "siblings"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return blocks.groupBy("tree", "_block").cogroup(fetched.groupBy("tree", "_block")).applyInArrow(
        expand, f"{types}, siblings {SIBLINGS}")


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(
        siblings, leaf,
        lambda node, s: F.when(s["digest"].isNull(), digest(node))
        .when(s["left"], digest(s["digest"], node)).otherwise(digest(node, s["digest"])))


def manifest(
    rows: DataFrame, group: str, key: str, bits: int = BITS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, trees) of ``rows``, which have a column ``leaf`` (its digest), the group and the key, and any to carry.

    ``leaves`` are the rows with tree, n, pos; ``trees`` has for each tree subroot, root and top_siblings, the path from subroot to root.
    """
    leaves = place_leaves(rows, group, key).withColumn("digest", F.col("leaf"))
    nodes = tree_nodes(leaves, bits)
    subroots = materialise(roots(leaves, nodes).withColumnRenamed("digest", "leaf").withColumn("_all", F.lit(None).cast("string")))
    top = place_leaves(subroots.withColumnRenamed("tree", "of"), "_all", "of").withColumn("digest", F.col("leaf"))
    top_nodes = tree_nodes(top, bits)
    proved = prove(top.select("of", "tree", "n", "pos", "digest"), top, top_nodes, bits)
    trees = materialise(proved.select(
        F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("siblings").alias("top_siblings"),
        fold(F.col("digest"), F.col("siblings")).alias("root")))
    return leaves, nodes, trees


def whole_proofs(asked: DataFrame, leaves: DataFrame, nodes: DataFrame, trees: DataFrame, bits: int = BITS) -> DataFrame:
    """``asked`` with subroot, root and siblings, the path from the leaf via its subroot to the root."""
    return prove(asked, leaves, nodes, bits).join(trees, "tree").withColumn(
        "siblings", F.concat("siblings", "top_siblings")).drop("top_siblings")
