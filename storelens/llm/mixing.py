"""Mixing sources to target weights by blocks.

The words of each source, its documents in a pseudorandom order, are packed end to end into blocks
of ``block_words``. A source's target becomes a whole number of slots. Output shards are drawn one
after the other, each a multinomial draw of source counts whose probabilities are the slots that
the sources still have to give, so every shard looks like the mix and the totals come out
exactly. Slot k of a source with n blocks is block P_e(k mod n), with P_e a pseudorandom permutation
of 0..n-1 (a Feistel network, cycle-walked) keyed by the source and the epoch e = k div n; blocks are
then joined by index. No block is used more than ceil(slots / n) times.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the sizes of all
documents; a target stops at ``max_epochs`` times its source's size, the excess is shared again by
weight until none is above.

To the driver come one row for each source; it draws at most ``GROUPS`` groups of shards, one count for each source and
group, whatever the size of the mix, and a task draws a group's shards from its counts in the same way. Offsets come from
two-level sums over hashed buckets, so no task sees a whole source.

Defined results: null, empty and wordless texts have size 0 and are never taken; a null source is a
source of its own, the last; repeated rows are documents of their own; with no words at all every
target is 0; an empty table gives no rows. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut

BLOCK_WORDS, SHARD_SLOTS, MAX_EPOCHS, SEED = 64, 1 << 16, 3, 7
WEIGHTS = (1, 2, 3)
#: Groups of shards that the driver draws at most; the shards of a group are drawn in a task.
GROUPS = 1024
#: Rows that a bucket of the offset sums holds on average.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(sid, source, n_docs, source_size, target)`` from ``(source, size)``; a row for each source.

    The sources below the water level are those whose cap per weight is reached: sorted by it, a
    source is full if the level without the sources before it is no lower than its own.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    all_ = Window.partitionBy()
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("*", sid.alias("sid"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)).withColumn(
        "cap", F.col("source_size") * max_epochs)
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("*", F.sum("source_size").over(all_).alias("total"), F.sum("w").over(all_).alias("w_all"),
                     F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
                     F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    full = F.col("cap") / F.col("w") <= (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    per = per.withColumn("full", full)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(all_)
    return per.select("sid", "source", "n_docs", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        left * F.col("w") / open_w).alias("target"))


def draw_shards(slots: np.ndarray, shard_slots: int, seed: int | list[int]):
    """Rows (source position, shard, count, first slot); the counts of a source sum to its slots."""
    seed = seed if isinstance(seed, list) else [seed]
    rest, first, shard, out = slots.astype(np.int64).copy(), np.zeros(len(slots), np.int64), 0, []
    while rest.sum():
        rng = np.random.default_rng([*seed, shard])
        want, got = min(shard_slots, int(rest.sum())), np.zeros(len(slots), np.int64)
        while want:  # what a nearly spent source can't give is drawn again from the others
            room = rest - got
            more = np.minimum(rng.multinomial(want, room / room.sum()), room)
            got += more
            want -= int(more.sum())
        out += [(int(i), shard, int(got[i]), int(first[i])) for i in np.flatnonzero(got)]
        first += got
        rest -= got
        shard += 1
    return out


def _shards_of_groups(per_group: int, shard_slots: int, seed: int):
    """The draws of each group of shards, a row of sources' counts, down to its shards."""
    def run(batches):
        for b in batches:
            for group in b.to_pylist():
                drawn = draw_shards(np.array(group["n"], np.int64), shard_slots, [seed, 1, group["shard"]])
                rows = [(group["sid"][i], group["shard"] * per_group + shard, n, group["first"][i] + first, group["n_blocks"][i])
                        for i, shard, n, first in drawn]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["sid", "shard", "n", "first", "n_blocks"])
    return run


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P_key(index) for each row: a permutation of 0..n-1 by a four-round Feistel network."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (x ^ x >> np.uint64(31)) & m
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _blocks_of_slots(seed: int):
    def run(batches):
        for b in batches:
            sid, shard, slot, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("sid", "shard", "slot", "n_blocks"))
            key = (sid.astype(np.int64) << 32) + slot // n + (seed << 20)
            block = permuted(slot % n, n, key)
            yield pa.record_batch([pa.array(x) for x in (sid, shard, slot, block)], names=["sid", "shard", "slot", "block"])
    return run


def packed_sources(documents: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                   seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
    """``(targets, docs)``: the targets of the sources; the documents with size and word offset
    ``start`` within their source (null for documents without words)."""
    sizes = cut(documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
    targets = cut(source_targets(sizes, weights, max_epochs), "targets")
    t = targets.select("sid", F.col("source").alias("t_source"), "n_docs", "source_size", "target")
    docs = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).drop("t_source")
    order = F.xxhash64(F.lit(seed), "sid", F.col("doc_id").cast("string"), "size")
    docs = docs.withColumn("h", order).withColumn("bucket", F.pmod("h", 1 + F.floor(F.col("n_docs") / BUCKET_ROWS)))
    docs = cut(docs, "hashed")
    some = docs.where("size > 0")
    sums = some.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")), "bases")
    inner = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = some.select("*", F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("at"))
    placed = placed.join(sums, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("at"))
    cols = ["doc_id", "source", "sid", "size", "source_size", "target", "start"]
    return targets, placed.select(cols).union(docs.where("size = 0").withColumn(
        "start", F.lit(None).cast("bigint")).select(cols))


def drawn_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                seed: int = SEED, groups: int = GROUPS) -> DataFrame:
    """``(sid, shard, slot, block)``: the block index that each slot of the mix takes."""
    spark = targets.sparkSession
    rows = targets.where("source_size > 0").select("sid", "source_size", "target").orderBy("sid").collect()  # one for each source
    n_blocks = [-(-r["source_size"] // block_words) for r in rows]
    slots = np.array([round(r["target"] * n / r["source_size"]) for r, n in zip(rows, n_blocks, strict=True)], np.int64)
    shards = -(-int(slots.sum()) // shard_slots)
    per_group = max(1, -(-shards // groups))
    drawn = draw_shards(slots, shard_slots * per_group, seed)
    if per_group == 1:
        plan = spark.createDataFrame([(rows[i]["sid"], shard, n, first, n_blocks[i]) for i, shard, n, first in drawn],
                                     "sid int, shard int, n long, first long, n_blocks long")
    else:
        by: dict[int, list] = {}
        for i, group, n, first in drawn:
            by.setdefault(group, []).append((rows[i]["sid"], n, first, n_blocks[i]))
        plan = spark.createDataFrame([(g, *(list(x) for x in zip(*v, strict=True))) for g, v in by.items()],
                                     "shard int, sid array<int>, n array<long>, first array<long>, n_blocks array<long>")
        plan = plan.repartition(len(by)).mapInArrow(_shards_of_groups(per_group, shard_slots, seed), "sid int, shard int, n long, first long, n_blocks long")
    each = plan.select("sid", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "n_blocks")
    return each.mapInArrow(_blocks_of_slots(seed), "sid int, shard int, slot long, block long")


def block_pieces(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a document reaches into, with the words of it there."""
    end = F.col("start") + F.col("size")
    out = docs.where("size > 0").select("*", F.explode(F.sequence(
        F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    low = F.greatest("start", F.col("block") * block_words)
    return out.select("*", (low - F.col("start")).alias("first_word"),
                      (F.least(end, (F.col("block") + 1) * block_words) - low).alias("n_words"))


def mixture(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights=WEIGHTS,
            max_epochs: int = MAX_EPOCHS, seed: int = SEED, **columns) -> DataFrame:
    """The mix itself: for each slot of each shard the runs of words that fill it
    ``(shard, slot, source, block, doc_id, first_word, n_words)``."""
    targets, docs = packed_sources(documents, block_words, weights, max_epochs, seed, **columns)
    pieces = block_pieces(docs, block_words).select("sid", "source", "block", "doc_id", "first_word", "n_words")
    return drawn_slots(targets, block_words, shard_slots, seed).join(pieces, ["sid", "block"]).select(
        "shard", "slot", "source", "block", "doc_id", "first_word", "n_words")


def mix_report(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights=WEIGHTS,
               max_epochs: int = MAX_EPOCHS, seed: int = SEED, **columns) -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words that the mix takes."""
    targets, docs = packed_sources(documents, block_words, weights, max_epochs, seed, **columns)
    docs = cut(docs, "placed")
    uses = drawn_slots(targets, block_words, shard_slots, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    keys = ["sid", "start", "doc_id", "source", "size", "source_size", "target"]
    taken = block_pieces(docs, block_words).join(uses, ["sid", "block"], "left").groupBy(keys).agg(
        F.coalesce(F.sum(F.col("n_words") * F.col("uses")), F.lit(0)).alias("taken"))
    rest = docs.where("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return taken.union(rest).select("doc_id", "source", "size", "source_size", "target", "taken")
