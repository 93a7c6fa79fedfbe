"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 64-bit fingerprint has a bit set where over half of its shingles' XXH64 (seed 42)
have it. Fingerprints at ``max_bits`` = 2 or fewer differing bits are linked.

Candidates: the fingerprint is cut into segments A (23 bits), B (23 bits) and C (18 bits). The
binary Golay code [23, 12, 7] is perfect: every 23-bit word has exactly one codeword within 3
bits. The indices of the codewords that a segment or any word one bit away decodes to form its
fuzzy keys; two segments that differ in at most one bit share one. Two errors fall on the
segments as (A, B, C) = (0, <=1, .), (<=1, 0, .), (<=1, ., 0) or (2, 0, 0), so these keys miss none:

    A exact + B fuzzy,   B exact + A fuzzy,   C exact + A fuzzy,   B exact + C exact
    ((0, 2, 0) is caught by C exact + A fuzzy).

Only distinct fingerprints are compared, in runs of equal keys; a run gives the edges of a
spanning forest, never all its pairs, and a long run looks up the 2,080 patterns of up to two
bits instead of comparing all pairs, so its cost stays linear in its length.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any other;
fewer words than a shingle are one shingle; repeated rows share a fingerprint; a null doc_id is
smaller than none (a component of null ids alone has a null component_id). Other columns are not
looked at and may have any name.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, private
from .components import connected_components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
#: Runs of equal keys above this length are compared by pattern look-up.
LONG_RUN = 2048

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = _WORD.findall(text.encode("utf-8").translate(_UPPER)) if text else []
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts, stops = [0, *ends[:n - 1].tolist()], (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * bits > n))


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("t")), np.uint64, batch.num_rows)
            yield pa.record_batch([*[c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "t"],
                                   pa.array(fps.view(np.int64))],
                                  names=[*[n for n in batch.schema.names if n != "t"], "fp"])
    return run


class Golay:
    """Decoder of the [23, 12, 7] code with generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1."""

    GENERATOR = 0b110001110101

    def __init__(self):
        m = np.arange(1 << 12, dtype=np.int64)
        rest = m << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ self.GENERATOR << (bit - 11), rest)
        self.parity = rest
        self.leader = np.zeros(1 << 11, np.int64)  # the error pattern of each syndrome
        for weight in (1, 2, 3):
            for at in itertools.combinations(range(23), weight):
                e = sum(1 << b for b in at)
                self.leader[self.syndrome(np.int64(e))] = e

    def syndrome(self, x):
        return self.parity[x >> 11] ^ x & 0x7FF

    def index(self, x):
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        return (x ^ self.leader[self.syndrome(x)]) >> 11

    def fuzzy(self, x):
        """Indices of the codewords of x and of every word one bit away: (position in x, index)."""
        all_ = np.sort(np.stack([self.index(x), *[self.index(x ^ (1 << b)) for b in range(23)]], axis=1), axis=1)
        first = np.ones(all_.shape, bool)
        first[:, 1:] = all_[:, 1:] != all_[:, :-1]
        rows, cols = np.nonzero(first)
        return rows, all_[rows, cols]


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of 64-bit fingerprints given as int64."""
    u = fps.view(np.uint64)
    a = (u & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (u >> np.uint64(46)).astype(np.int64)
    (ra, ka), (rb, kb) = golay.fuzzy(a), golay.fuzzy(b)
    rows = [rb, ra, ra, np.arange(len(u))]
    keys = [a[rb] << 12 | kb, b[ra] << 12 | ka, c[ra] << 12 | ka, b << 18 | c]
    return np.concatenate(rows), np.concatenate([k | kind << 60 for kind, k in enumerate(keys)])


def _key_rows(max_bits: int):
    def run(batches):
        golay = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, keys = golay_keys(fps, golay)
            yield pa.record_batch([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])
    return run


def near_pairs(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of sorted distinct fingerprints at ``max_bits`` or fewer differing bits."""
    n = len(fps)
    if n <= LONG_RUN:
        d = np.bitwise_count(fps[:, None] ^ fps[None, :])
        i, j = np.nonzero(d <= max_bits)
        return i[i < j], j[i < j]
    found = []
    for weight in range(1, max_bits + 1):
        for at in itertools.combinations(range(64), weight):
            other = fps ^ np.uint64(sum(1 << b for b in at))
            k = np.minimum(np.searchsorted(fps, other), n - 1)
            i = np.flatnonzero((fps[k] == other) & (fps < other))
            found.append((i, k[i]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) for every node that a path of pairs joins to a smaller one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return [(x, int(r)) for x, r in enumerate(label) if r != x]
        label = new


def _edges(max_bits: int):
    def of_run(fps):
        u = np.unique(fps.view(np.uint64))
        if len(u) < 2:
            return []
        s = u.view(np.int64)
        return [(int(s[x]), int(s[r])) for x, r in spanning(len(u), *near_pairs(u, max_bits))]

    def run(batches):
        held_key, held = None, []  # the run that may go on in the next batch
        for batch in batches:
            keys, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "fp"))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            stops = [*starts[1:], len(keys)]
            out = []
            if len(starts) and keys[0] != held_key:
                out += of_run(np.concatenate(held)) if held else []
                held = []
            for k, (a, b) in enumerate(zip(starts, stops, strict=True)):
                if k == len(starts) - 1:
                    held_key = keys[a]
                    held.append(fps[a:b].copy())
                elif k == 0 and held:
                    out += of_run(np.concatenate([*held, fps[a:b]]))
                    held = []
                elif b - a > 1:
                    out += of_run(fps[a:b])
            if out:
                x = np.array(out, np.int64)
                yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
        if held and (out := of_run(np.concatenate(held))):
            x = np.array(out, np.int64)
            yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
    return run


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(node, root)`` of the distinct ``fp`` that have a link to another."""
    if not 0 < max_bits <= 2:
        raise ValueError("the keys are complete for one or two differing bits")
    keys = fps.select("fp").distinct().mapInArrow(_key_rows(max_bits), "key long, fp long")
    edges = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_edges(max_bits), "a long, b long")
    return connected_components(edges)


def simhash_groups(documents: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``documents``."""
    kind = documents.schema[doc_id].dataType.simpleString()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    prints = cut(docs.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long"), "fingerprints")
    return _with_component(prints, "doc_id", "component_id", max_bits)


def _with_component(prints: DataFrame, least: str, name: str, max_bits: int) -> DataFrame:
    """``prints`` with the least value of column ``least`` over the linked fingerprints."""
    each = cut(prints.groupBy("fp").agg(F.min(least).alias("low")), "distinct-fp")
    groups = fingerprint_components(each, max_bits)
    rooted = each.join(groups, each["fp"] == groups["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted-fp")
    low = cut(rooted.groupBy("root").agg(F.min("low").alias("g_low")), "group-low")
    ids = cut(rooted.join(low, "root").select(F.col("fp").alias("g_fp"), F.col("g_low").alias(name)), "group-ids")
    return prints.join(ids, prints["fp"] == ids["g_fp"], "left").drop("g_fp")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(documents: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each group: the row of the least doc_id (nulls last), and of
    rows that share it one of the least text. All columns as they were.

    Texts are neither written nor aggregated: fingerprints are kept by (doc_id, two hashes of the text), and
    the documents meet only the places of the rows that go, which Spark broadcasts where they are few.
    """
    i, h1, h2, n = private(documents, "simhash_id", "simhash_h1", "simhash_h2", "simhash_n")
    kind, t = documents.schema[doc_id].dataType.simpleString(), F.col(text)
    hashes = (F.xxhash64(t), F.xxhash64(F.lit(1), t))
    prints = cut(documents.select(F.col(doc_id).alias("id"), hashes[0].alias("h1"), hashes[1].alias("h2"), t.alias("t")).mapInArrow(
        _fingerprints(shingle), f"id {kind}, h1 long, h2 long, fp long"), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2").alias("rank")
    places = cut(prints.groupBy("id", "h1", "h2", "fp").agg(F.count(F.lit(1)).alias("uses")).select(rank, "fp", "uses"), "places")
    ids = _with_component(places.groupBy("fp").agg(F.min("rank").alias("rank")), "rank", "best", max_bits)
    best = ids.where(F.col("rank") == F.col("best")).select(F.col("best").alias("stays"))
    judged = places.join(best, F.col("rank") == F.col("stays"), "left").where("stays IS NULL OR uses > 1")
    judged = cut(judged.select("rank.*", F.col("stays").isNotNull().alias("stays")), "judged-places")

    def meet(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
        p = places.select(F.col("id").alias(i), F.col("h1").alias(h1), F.col("h2").alias(h2))
        on = rows[doc_id].eqNullSafe(p[i]) & (F.xxhash64(rows[text]) == p[h1]) & (F.xxhash64(F.lit(1), rows[text]) == p[h2])
        return rows.join(p, on, how)

    alone = meet(documents, judged, "left_anti")
    w = Window.partitionBy(doc_id, *hashes).orderBy(doc_id)
    repeated = meet(documents, judged.where("stays"), "left_semi").withColumn(n, F.row_number().over(w))
    return alone.union(repeated.where(F.col(n) == 1).drop(n))
