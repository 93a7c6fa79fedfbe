"""Merkle manifest of a dataset: cogrouped subtree exchange.

Every row is a leaf. Within a source the leaves ascend by id; while several nodes remain, every
``FANOUT`` consecutive ones (the last run may be shorter, even one) become their hash. What remains is the
source's subroot, and the subroots, by source, give the root in the same way.

Leaves get their position from ranges and counts of parts (``operators.ordered``), so a source with a
third of all rows is no task of its own. ``FANOUT ** LEVELS`` consecutive nodes of a source are a superblock.
On the way up each superblock becomes one node, round after round, until every source has one node; a round
has 1 / 729 of the nodes of the one before. On the way down the nodes of a round are cogrouped with the outer
nodes that their superblock needs - the siblings on its way to the root, a few for each level -
in ``applyInPandas``, which finishes the local reduction, joins the proofs and, for the leaves,
folds the given (perhaps tampered) leaf with its original siblings up to the root. A task holds one superblock;
the driver learns the number of leaves of the largest source, nothing else.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; null ids come first in their
source; rows with equal ids are ordered by leaf, and equal rows are leaves of their own (which of
them is which doesn't show); a null source is a source, the first; a lone leaf is its source's subroot, a lone
subroot is the root, and a proof without siblings is the hash of the empty text; an empty table gives no
rows. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from .common import cut

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields' lengths and values, as lower-case hex."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], whole: bool, levels: int = LEVELS) -> list[list[str]]:
    """The levels above ``nodes``, these first: up to one node if it is the whole tree, else ``levels`` of them."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        below = out[-1]
        out.append([h("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """For each level ``left:right``, the joined siblings of the node above leaf ``at``."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        out.append("".join(nodes[first:at]) + ":" + "".join(nodes[at + 1:first + FANOUT]))
        at //= FANOUT
    return out


def folded(leaf: str, path: list[str]) -> str:
    for step in path:
        left, right = step.split(":")
        leaf = h(left + leaf + right)
    return leaf


def _up(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("idx")
    m, size = int(block["m"].iloc[0]), FANOUT ** LEVELS
    top = reduced(block["hash"].tolist(), m <= size)[-1][0]
    return pd.DataFrame({"tree": block["tree"].iloc[:1], "idx": [int(block["idx"].iloc[0]) // size], "m": [-(-m // size)], "hash": [top]})


def _paths(block: pd.DataFrame, outer: pd.DataFrame):
    """The nodes of a superblock by position, and the way of each to the root."""
    block = block.sort_values("idx")
    size = FANOUT ** LEVELS
    levels = reduced(block["hash"].tolist(), int(block["m"].iloc[0]) <= size)
    up = list(outer["path"].iloc[0])
    first = int(block["idx"].iloc[0])
    return block, [siblings(levels, int(i) - first) + up for i in block["idx"]]


def _down(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    if not len(block):
        return pd.DataFrame({c: [] for c in ("tree", "idx", "path", "subroot", "root")})
    block, paths = _paths(block, outer)
    return pd.DataFrame({"tree": block["tree"], "idx": block["idx"], "path": paths,
                         "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})


def _prove(with_proofs: bool):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c: [] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof")})
        block, paths = _paths(block, outer)
        given = [t if isinstance(t, str) else leaf for t, leaf in zip(block["tampered"], block["hash"], strict=True)]
        return pd.DataFrame({
            "id": block["id"], "leaf": block["hash"], "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
            "proof_sha256": [h("".join(p).replace(":", "")) for p in paths],
            "folded_root": [folded(x, p) for x, p in zip(given, paths, strict=True)],
            "proof": paths if with_proofs else None})
    return run


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``(rounds, tops)`` of ``nodes (tree, idx, m, hash)``, ``m`` nodes in the tree: the tables of each round, and
    ``(tree, hash)`` with the top of each tree."""
    most = nodes.agg(F.max("m")).first()[0] or 0
    size, rounds = FANOUT ** LEVELS, [nodes]
    while most > 1:
        at = rounds[-1].select("tree", "idx", "m", "hash")
        up = at.where("m > 1").groupBy("tree", F.floor(F.col("idx") / size).alias("block")).applyInPandas(
            _up, "tree long, idx long, m long, hash string")
        rounds.append(cut(up.union(at.where("m = 1")), "merkle-up"))
        most = -(-most // size)
    return rounds, rounds[-1].select("tree", "hash")


OUTER = "tree long, idx long, path array<string>, subroot string, root string"


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The outer nodes of each block of the lowest round, ``(tree, idx, path, subroot, root)``, from those of each
    tree's top (without ``idx``)."""
    outer = top.select("tree", F.lit(0).cast("bigint").alias("idx"), "path", "subroot", "root")
    for nodes in reversed(rounds[1:-1]):
        outer = cut(_cogrouped(nodes, outer).applyInPandas(_down, OUTER), "merkle-down")
    return outer


def _cogrouped(nodes: DataFrame, outer: DataFrame):
    size = FANOUT ** LEVELS
    block = F.when(F.col("m") > 1, F.floor(F.col("idx") / size)).otherwise(F.lit(0)).alias("block")
    return nodes.groupBy("tree", block).cogroup(outer.groupBy("tree", F.col("idx").alias("block")))


def merkle_report(documents: DataFrame, tampered_text: Column | None = None, fields: tuple[str, ...] = FIELDS,
                  with_proofs: bool = False) -> DataFrame:
    """A row for each document: its leaf, its source's subroot, the root, the digest of its proof, and the root that
    its leaf folds to.

    ``fields`` name the id, the source and the other hashed columns, the text last. ``tampered_text`` is the text
    to verify instead (null: as it is); leaf, subroot, root and proof are always of the original. ``with_proofs``
    adds ``proof``, for each level the joined siblings to the left and right as ``left:right``.
    """
    id_, source, text = F.col(fields[0]), F.col(fields[1]), F.col(fields[-1])
    leaves = cut(documents.select(
        id_.alias("doc_id"), source.cast("string").alias("source"), leaf_hash(*map(F.col, fields)).alias("hash"),
        (F.lit(None).cast("string") if tampered_text is None else F.when(
            tampered_text.isNotNull(), leaf_hash(*map(F.col, fields[:-1]), tampered_text))).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    placed = positions(leaves, ["source"], [F.col("doc_id"), F.col("hash"), F.col("row")], "idx", "m", "merkle-order")
    sources = positions(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("size")), [], [F.col("source")],
                        "tree", "trees", "merkle-sources")
    sources = cut(sources.select(F.col("source").alias("of"), "tree", "trees"), "merkle-trees")
    nodes = cut(placed.join(sources, placed["source"].eqNullSafe(sources["of"])).select(
        F.col("doc_id").cast("string").alias("id"), "tree", "trees", "idx", "m", "hash", "tampered"), "merkle-nodes")
    rounds, tops = climb(nodes)
    over = cut(tops.join(sources.select("tree", "trees"), "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("m"), "hash"), "merkle-subroots")
    over_rounds, root = climb(over)
    root = root.select("tree", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    ways = _cogrouped(over, descend(over_rounds, root)).applyInPandas(_down, OUTER)
    subroots = over.select(F.col("idx").alias("tree"), F.col("hash").alias("subroot"))
    ways = cut(ways.select(F.col("idx").alias("tree"), "path", "root").join(subroots, "tree"), "merkle-ways")
    out = _cogrouped(nodes, descend(rounds, ways)).applyInPandas(
        _prove(with_proofs), "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof array<string>")
    kind = dict(documents.select(id_.alias("doc_id")).dtypes)["doc_id"]
    return out.select(F.col("id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), *(["proof"] if with_proofs else []))
