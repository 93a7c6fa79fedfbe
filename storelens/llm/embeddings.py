"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Equal vectors of one label are one class, compared once. A tree halves the space at each level by a random
direction at the median of a bounded sample; a vector within ``SPILL`` of the split (in units of
the typical projected distance of a pair at the threshold) goes to both sides. Classes that share
a leaf of any tree and a label are compared by cosine in double precision, in the leaf.

Trees overlap, so a pair may meet in several leaves; it is counted in the least leaf that both are
in, which each of them knows, so no pairs are written: a leaf gives each class the number of
its partners and an edge to the least class that its links reach there. The union of all leaves' edges
gives the components. A leaf and label with more than ``BLOCK`` classes is cut into blocks, and
pairs of blocks go to different tasks.

The trees (directions and thresholds) come from ``SAMPLE`` classes at most, chosen by hash; their depth
follows the number of classes. Every vector is routed. Below the resolution of the sample a split
takes the last median above it.

Defined results: a null label, a null or zero vector or one with null or non-finite components links
with nothing (0 links, its own component, kept); vectors of different lengths don't link; rows that repeat a vec_id
are vectors of their own and link if equal; a null vec_id is greater than any other; an empty table gives no
rows. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .simhash import spanning

THRESHOLD, TREES, LEAF, SPILL, SAMPLE, BLOCK, SEED = 0.93, 5, 1024, 0.5, 8192, 4096, 5
#: Rows compared at a time, and linked pairs looked at together.
ROWS, PAIRS = 1024, 20_000


def directions(dim: int, tree: int, depth: int) -> np.ndarray:
    x = np.random.default_rng([SEED, dim, tree]).normal(size=(dim, depth))
    return x / np.linalg.norm(x, axis=0, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_tree(sample: np.ndarray, tree: int, depth: int) -> list[np.ndarray]:
    """Thresholds of the nodes of each level."""
    p = sample @ directions(sample.shape[1], tree, depth)
    at, levels, above = np.zeros(len(sample), np.int64), [], np.zeros(1)
    for level in range(depth):
        cuts = np.empty(1 << level)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange((1 << level) + 1))
        for node in range(1 << level):
            own = p[order[bounds[node]:bounds[node + 1]], level]
            cuts[node] = np.median(own) if len(own) > 1 else above[node]
        levels.append(cuts)
        at = at * 2 + (p[:, level] > cuts[at])
        above = np.repeat(cuts, 2)
    return levels


def route(x: np.ndarray, tree: int, levels: list[np.ndarray], spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each unit vector goes to."""
    row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    if levels:
        p = x @ directions(x.shape[1], tree, len(levels))
    for level, cuts in enumerate(levels):
        d = p[row, level] - cuts[at]
        both = np.abs(d) <= spill
        side = (d > 0).astype(np.int64)
        row, at = np.concatenate([row, row[both]]), np.concatenate([at * 2 + side, at[both] * 2 + 1 - side[both]])
    return row, at


def spill_of(threshold: float, dim: int, spill: float = SPILL) -> float:
    return spill * ((2 - 2 * threshold) / dim) ** 0.5


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _leaf_codes(forests: dict[int, list[list[np.ndarray]]], threshold: float, trees: int):
    def run(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column("vec")])
            codes = [None] * b.num_rows
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = _vectors(b.column("vec").take(pa.array(rows)))
                found = []
                for t in range(trees):
                    row, leaf = route(x, t, forests.get(int(dim), [[]] * trees)[t], spill_of(threshold, int(dim)))
                    found.append(np.stack([rows[row], leaf + (t << 40)], axis=1))
                found = np.concatenate(found)
                found = found[np.lexsort((found[:, 1], found[:, 0]))]
                for part in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
                    codes[part[0, 0]] = part[:, 1].tolist()
            yield pa.record_batch([*b.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*b.schema.names, "codes"])
    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        code = table.column("code")[0].as_py()
        cid, size, chunk = (table.column(k).to_numpy() for k in ("cid", "size", "chunk"))
        ci, cj = table.column("ci")[0].as_py(), table.column("cj")[0].as_py()
        x = _vectors(table.column("vec"))
        lists = table.column("codes").to_pylist()
        codes = np.full((n, max(map(len, lists))), -1, np.int64)
        for k, c in enumerate(lists):
            codes[k, :len(c)] = c
        codes[codes >= code] = -1  # leaves before this one
        links, pi, pj = np.zeros(n, np.int64), [], []
        right = np.flatnonzero(chunk == cj)
        for a in range(0, n, ROWS):
            left = np.flatnonzero(chunk[a:a + ROWS] == ci) + a
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            keep = i < j if ci == cj else slice(None)
            i, j = i[keep], j[keep]
            if len(i):
                star = np.array(spanning(n, i, j), np.int64)  # connects what these pairs connect
                pi.append(star[:, 0])
                pj.append(star[:, 1])
                for k in range(0, len(i), PAIRS):
                    u, v = codes[i[k:k + PAIRS]], codes[j[k:k + PAIRS]]
                    met = ((u[:, :, None] == v[:, None, :]) & (u[:, :, None] >= 0)).any(axis=(1, 2))
                    np.add.at(links, i[k:k + PAIRS][~met], size[j[k:k + PAIRS][~met]])
                    np.add.at(links, j[k:k + PAIRS][~met], size[i[k:k + PAIRS][~met]])
        to = {}
        if pi:
            order = np.argsort(cid, kind="stable")  # the least class of a component is its root
            place = np.argsort(order, kind="stable")
            to = {int(order[m]): int(cid[order[r]]) for m, r in spanning(n, place[np.concatenate(pi)], place[np.concatenate(pj)])}
        rows = sorted({*np.flatnonzero(links).tolist(), *to})
        return pa.table({"cid": pa.array(cid[rows], pa.int64()), "links": pa.array(links[rows], pa.int64()),
                         "root": pa.array([to.get(r) for r in rows], pa.int64())})
    return run


def _sound(v):
    """Whether a vector can link: finite, complete and not zero."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF,
                 vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    sound = F.coalesce(_sound(F.col("vec")) & F.col("label").isNotNull(), F.lit(False))
    classes = cut(rows.where(sound).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
                  .withColumn("cid", F.monotonically_increasing_id()), "classes")
    counts = {r[0]: r[1] for r in classes.groupBy(F.size("vec").alias("dim")).count().collect()}
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(SEED), "vec"), F.lit(1_000_000)) < share * 1_000_000).select("vec").limit(
        2 * SAMPLE).toArrow().column("vec")  # bounded, to fit the trees
    lengths = np.array([len(v) for v in sample])
    forests = {}
    for dim, n in counts.items():
        if (lengths == dim).any() and n > leaf:
            x, depth = _vectors(sample.take(pa.array(np.flatnonzero(lengths == dim)))), int(np.ceil(np.log2(n / leaf)))
            forests[dim] = [fit_tree(x, t, depth) for t in range(trees)]
    model = spark.sparkContext.broadcast(forests)  # 2 ** depth thresholds for each tree: classes / leaf

    def routed(batches):
        yield from _leaf_codes(model.value, threshold, trees)(batches)

    label_type = rows.schema["label"].dataType.simpleString()
    placed = cut(classes.select("cid", "size", "label", F.size("vec").alias("dim"), "vec").mapInArrow(
        routed, f"cid long, size long, label {label_type}, dim int, vec array<double>, codes array<long>"), "routed")
    place = ["code", "label", "dim"]
    hot = cut(placed.select(F.explode("codes").alias("code"), "label", "dim").groupBy(*place).count().where(
        F.col("count") > BLOCK).select(*place, F.ceil(F.col("count") / BLOCK).cast("int").alias("n_chunks")), "hot-leaves")
    each = placed.select("*", F.explode("codes").alias("code")).join(hot, place, "left")
    each = each.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1))).withColumn(
        "chunk", F.pmod(F.xxhash64("cid"), F.col("n_chunks")).cast("int"))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).withColumns(
        {"ci": F.least("chunk", "k"), "cj": F.greatest("chunk", "k")})
    found = cut(each.select(*place, "ci", "cj", "chunk", "cid", "size", "vec", "codes").groupBy(*place, "ci", "cj").applyInArrow(
        _compare(threshold), "cid long, links long, root long"), "leaf-links")
    links = cut(found.groupBy("cid").agg(F.sum("links").alias("links")), "links")
    groups = connected_components(found.where("root IS NOT NULL").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "cid", "left").join(groups, classes["cid"] == groups["node"], "left").select(
        "cid", "label", "vec", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    known = cut(known, "known")
    low = cut(known.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    known = cut(known.join(low, "root").select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"),
                                               (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"), "class-results")
    good = rows.where(sound).join(known, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec"))).select(
        "vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
