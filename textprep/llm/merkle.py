"""Merkle dataset manifest as a persistent tree with path copying.

Leaves are digests of rows.  Each group's leaves, in order, are hashed together two by two
(an odd last one alone) until one subroot remains; the subroots, in order of the groups, are
hashed likewise into the root.

The tree is built in tiers of BLOCK_BITS levels.  A tier's nodes are dealt into aligned blocks
of 2**BLOCK_BITS consecutive nodes of a group; one task row holds a block, hashes its levels
and hands its top on as a node of the next tier.  Nothing larger than a block is ever in one
task, and each tier has 2**BLOCK_BITS times fewer nodes than the one below.

Nodes are never changed.  A tampered leaf makes a version: a copy of each of its ancestors and
nothing else, all other nodes are those of the base tree.  The versions of a block copy the
ancestors inside the block, then go on together, tier by tier, to copy those above, joined
with the siblings that each tier's nodes have in their own block.  The last copy is the
version's root.  The same climb collects each block's siblings, from which the proofs of all
its leaves are made.

Cases: a null column counts as ``-`` in a leaf, an empty text as ``0:``; null groups come first
and are a group; null keys come first in a group; rows equal in group and key are ordered by
their digest, equal rows are leaves each; a group of one leaf has that leaf as subroot, and one
group's subroot is the root; an empty table gives no rows; texts are hashed whole in the JVM
and never shuffled; other columns are ignored unless in ``keep``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import pinned, row_struct, schema_of
from textprep.operators.order import dense_index

BLOCK_BITS = 8
MAX_BROADCAST_ROWS = 50_000  # rows of a tier's siblings, about 600 bytes each, or of the groups
SALTS = 32
_SIBLINGS = pa.list_(pa.string())
_COPIES = pa.list_(pa.struct([("at", pa.int32()), ("nodes", pa.list_(pa.string()))]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each as its byte count, a colon and itself, or ``-`` if null."""
    def field(v: Column) -> Column:
        s = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


def levels(nodes: list[str], n_levels: int) -> list[list[str]]:
    """``nodes`` and the ``n_levels`` levels above them."""
    out = [nodes]
    for _ in range(n_levels):
        below = out[-1]
        out.append([digest("".join(below[k: k + 2])) for k in range(0, len(below), 2)])
    return out


def siblings(tree: list[list[str]], k: int) -> list[str]:
    """The sibling of each node from the ``k``-th of the lowest level to the top: ``<`` and the
    digest of a left one, ``>`` and that of a right one, or empty if there is none."""
    out = []
    for level in tree[:-1]:
        other = k ^ 1
        out.append("" if other >= len(level) else ("<" if k & 1 else ">") + level[other])
        k >>= 1
    return out


def copied_ancestors(node: str, path: list[str]) -> list[str]:
    """Path copying: the copies of the node's ancestors, given its siblings on the way up."""
    out = []
    for other in path:
        node = digest(other[1:] + node if other[:1] == "<" else node + other[1:])
        out.append(node)
    return out


@dataclass
class MerkleTree:
    blocks: DataFrame  # g, n, pos, items (at, leaf, changed, row): a block of leaves each
    tiers: list[DataFrame]  # g, pos, path: for each node of a tier above the leaves its siblings inside its block
    group_tiers: int  # tiers of the groups' trees; the later ones are those of the subroots' tree
    subroots: DataFrame  # g, subroot
    root: str | None


_NODE = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("node", pa.string())])
_PATH = pa.schema([("g", pa.int64()), ("pos", pa.int64()), ("path", _SIBLINGS)])
_NODE_SQL, _PATH_SQL = "g bigint, n bigint, pos bigint, node string", "g bigint, pos bigint, path array<string>"


def _mapped(blocks: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str, kind: pa.Schema) -> DataFrame:
    """``make`` over the blocks, a few at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([out for row in batch.slice(a, 16).to_pylist() for out in make(row)], schema=kind)

    return blocks.mapInArrow(run, schema)


def _top(bits: int) -> Callable[[dict], Iterator[dict]]:
    """A block (g, n, pos, nodes) -> its top as a node of the next tier."""
    def make(row: dict) -> Iterator[dict]:
        n_levels = min(bits, height(row["n"]))
        node, = levels(row["nodes"], n_levels)[-1]
        yield {"g": row["g"], "n": _above(row["n"], bits), "pos": row["pos"], "node": node}

    return make


def _above(n: int, bits: int) -> int:
    """Nodes of the next tier above ``n`` nodes."""
    return -(-n >> min(bits, height(n)))


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a scratch table of one row per key: broadcast if it is small, else
    shuffled with each key over SALTS tasks, as one group may hold most rows."""
    if table.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _tier(nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, n, pos, node) -> (siblings of each inside its block, the blocks' tops as nodes)."""
    held = F.sort_array(F.collect_list(F.struct("pos", "node")))
    blocks = pinned(nodes.groupBy("g", "n", F.shiftrightunsigned("pos", bits).alias("block")).agg(held.alias("held")).select(
        "g", "n", F.col("block").alias("pos"), F.col("held.node").alias("nodes")), "merkle-blocks")

    def paths(row: dict) -> Iterator[dict]:
        tree = levels(row["nodes"], min(bits, height(row["n"])))
        for k in range(len(row["nodes"])):
            yield {"g": row["g"], "pos": (row["pos"] << bits) + k, "path": siblings(tree, k)}

    return pinned(_mapped(blocks, paths, _PATH_SQL, _PATH), "merkle-paths"), pinned(_mapped(blocks, _top(bits), _NODE_SQL, _NODE), "merkle-nodes")


def build(rows: DataFrame, group: str, key: str, leaf: str = "leaf", changed: str = "changed", keep: list[str] | None = None, bits: int = BLOCK_BITS) -> MerkleTree:
    """The tree over ``rows``: a leaf each, grouped and ordered by ``group`` and ``key``.
    ``changed`` holds the digest of a tampered leaf, else null; ``keep`` are columns to carry."""
    narrow = pinned(rows.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("leaf"), F.col(changed).alias("changed"), row_struct(keep or [key]).alias("row")), "merkle-leaves")
    order = ["grp", "key", "leaf", "_tie"]  # the last so that rows repeated many times are dealt over partitions too
    placed = dense_index(narrow.withColumn("_tie", F.monotonically_increasing_id()), order, "idx")
    found = pinned(placed.groupBy("grp").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    n_groups, n_max = found.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = pinned(dense_index(found, ["start"], "g"), "merkle-numbers")
    named = lambda df: df.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("")))  # noqa: E731  a key without nulls
    numbered = _lookup(named(placed), named(groups), ["grp"])
    pos = F.col("idx") - F.col("start")
    blocks = pinned(
        numbered.groupBy("g", "n", F.shiftrightunsigned(pos, bits).alias("pos"))
        .agg(F.sort_array(F.collect_list(F.struct(pos.alias("at"), "leaf", "changed", "row"))).alias("items")), "merkle-leaf-blocks")

    nodes = pinned(_mapped(blocks.select("g", "n", "pos", F.col("items.leaf").alias("nodes")), _top(bits), _NODE_SQL, _NODE), "merkle-nodes")
    tiers: list[DataFrame] = []
    most = _above(n_max, bits) if n_max else 0
    while most > 1:  # all groups at once; one that has its subroot already hands it on
        found, nodes = _tier(nodes, bits)
        tiers.append(found)
        most = _above(most, bits)
    group_tiers = len(tiers)
    subroots = nodes.select("g", F.col("node").alias("subroot"))
    nodes = nodes.select(F.lit(0).cast("bigint").alias("g"), F.lit(n_groups).cast("bigint").alias("n"), F.col("g").alias("pos"), "node")
    while n_groups > 1:
        found, nodes = _tier(nodes, bits)
        tiers.append(found)
        n_groups = _above(n_groups, bits)
    root = nodes.first()  # one row
    return MerkleTree(blocks, tiers, group_tiers, subroots, root["node"] if root else None)


def climbed(tree: MerkleTree, bits: int = BLOCK_BITS) -> DataFrame:
    """Blocks of leaves with ``upper``, the siblings above the block up to the root, and ``copies``:
    for each version its leaf's place in the block and the copies of its nodes, from leaf to root."""
    names = ["leaf_g", "n", "g", "pos", "items", "upper", "copies"]
    number = tree.blocks.schema["g"].dataType
    schema = schema_of({**dict.fromkeys(names[:4], number), "items": tree.blocks.schema["items"].dataType},
                       "upper array<string>, copies array<struct<at:int,nodes:array<string>>>")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(a, 64) for batch in batches for a in range(0, batch.num_rows, 64))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            copies = []
            for n, items in zip(batch.column("n").to_pylist(), batch.column("items")):
                leaves, changed = (items.values.field(c).to_pylist() for c in ("leaf", "changed"))
                nodes = levels(leaves, min(bits, height(n)))
                copies.append([{"at": k, "nodes": [x, *copied_ancestors(x, siblings(nodes, k))]}
                               for k, x in enumerate(changed) if x is not None and x != leaves[k]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("n"), batch.column("g"), batch.column("pos"), batch.column("items"),
                 pa.array([[]] * batch.num_rows, _SIBLINGS), pa.array(copies, _COPIES)], names)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            upper, copies = [], []
            for row in batch.select(["upper", "copies", "path"]).to_pylist():
                upper.append(row["upper"] + row["path"])
                copies.append([{"at": c["at"], "nodes": c["nodes"] + copied_ancestors(c["nodes"][-1], row["path"])} for c in row["copies"]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(upper, _SIBLINGS), pa.array(copies, _COPIES)], names)

    out = tree.blocks.mapInArrow(start, schema)
    for t, siblings_of in enumerate(tree.tiers):
        if t == tree.group_tiers:  # the subroots' tree is one group
            out = out.withColumn("pos", F.col("g")).withColumn("g", F.lit(0).cast("bigint"))
        out = _lookup(out, siblings_of, ["g", "pos"]).mapInArrow(climb, schema).withColumn("pos", F.shiftrightunsigned("pos", bits))
    return out


def versions(tree: MerkleTree, bits: int = BLOCK_BITS) -> DataFrame:
    """The persistent tree's copied nodes: (row, leaf_g, level, at, node), one for each ancestor
    (level 0: the leaf itself) that a version does not share with the base tree; ``at`` is the
    node's place in its level of the group's tree, or of the subroots' tree above it."""
    out = climbed(tree, bits).select("leaf_g", "n", "items", F.explode("copies").alias("c"))
    out = out.select("leaf_g", F.length(F.bin(F.col("n") - 1)).alias("digits"), "n", F.col("items")[F.col("c.at")].alias("item"), F.posexplode("c.nodes").alias("level", "node"))
    out = out.withColumn("own", F.when(F.col("n") == 1, 0).otherwise(F.col("digits")))  # levels of the group's tree
    return out.select("item.row", "leaf_g", "level", F.expr("if(level <= own, shiftright(item.at, level), shiftright(leaf_g, level - own))").alias("at"), "node")


def verify(tree: MerkleTree, bits: int = BLOCK_BITS) -> DataFrame:
    """(row, leaf, subroot, root, proof, folded_root, verified, copied_nodes), one row per leaf:
    ``proof`` is the digest of the leaf's siblings up to the root; ``folded_root`` the root of the
    leaf's version if it was tampered, else of the leaf folded with its siblings; ``copied_nodes``
    how many ancestors its version copied."""
    root = tree.root
    blocks = climbed(tree, bits)
    row_type = tree.blocks.schema["items"].dataType.elementType["row"].dataType

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                one = batch.slice(b, 1)
                items = one.column("items").flatten()
                n, upper, copies = (one.column(c).to_pylist()[0] for c in ("n", "upper", "copies"))
                leaves = items.field("leaf").to_pylist()
                made = {c["at"]: c["nodes"] for c in copies}
                nodes = levels(leaves, min(bits, height(n)))
                proofs, folded, copied = [], [], []
                for k, leaf in enumerate(leaves):
                    path = siblings(nodes, k) + upper
                    proofs.append(digest("".join(x[1:] for x in path)))
                    chain = made[k] if k in made else [leaf, *copied_ancestors(leaf, path)]
                    folded.append(chain[-1])
                    copied.append(len(chain) - 1 if k in made else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.column("leaf_g")[0].as_py()] * len(leaves), pa.int64()), items.field("row"), items.field("leaf"), pa.array(proofs, pa.string()),
                     pa.array(folded, pa.string()), pa.array([x == root for x in folded], pa.bool_()), pa.array(copied, pa.int64())],
                    ["g", "row", "leaf", "proof", "folded_root", "verified", "copied_nodes"])

    done = blocks.mapInArrow(finish, schema_of(
        {"g": tree.blocks.schema["g"].dataType, "row": row_type}, "leaf string, proof string, folded_root string, verified boolean, copied_nodes bigint"))
    return _lookup(done, tree.subroots, ["g"]).select(
        "row", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", "folded_root", "verified", "copied_nodes")
