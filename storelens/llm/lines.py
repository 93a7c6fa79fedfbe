"""Line dedup by a segment-partition edit join (DataFrame functions only).

A line (trimmed) is dropped where the same line, or one at ``threshold`` or fewer edits, occurs earlier
in the corpus; earlier is by (doc_id, nulls last, text hash, line number). All occurrences of a line
go if a near line's first occurrence is before its own first. Lines below ``min_chars`` code points have no
near lines; as exact copies they go from ``exact_chars`` code points on. The registered query and the pipeline
pass ``EXACT_CHARS``, so every line that isn't blank takes part there.

Edit join: a line of length l is split into threshold + 1 segments, and every line within the threshold holds
one of them unchanged, close to its place. Segments are indexed by (l, number, content); a line
of length L probes the substrings that can match the index of lengths L - threshold ... L, by the
multi-match-aware choice of start positions (a segment's shift is bounded by the edits that can lie
on its left and on its right). Each different line is keyed once, however often it occurs. Lines that share a key and
differ by no more bigram parities than the threshold allows are verified by banded
bit-parallel edit distance: 2 * threshold + 1 diagonals as the bits of one number.

Defined results: null and empty texts have no line to drop and stay as they are; rows that repeat doc_id and text
are one document with one decision, none is a copy of the other; an empty table gives no rows. A text
without drops is returned unchanged. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, private

THRESHOLD, MIN_CHARS = 2, 20
#: Exact copies need no distance, so the shortest line that isn't blank can be one.
EXACT_CHARS = 1


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` (from 0): the longer ones come last."""
    short, n_long = F.floor(length / parts).cast("int"), length % parts
    before_long = F.greatest(F.lit(i) - (parts - n_long), F.lit(0))
    return short * i + before_long + 1, short + F.when(n_long >= parts - i, 1).otherwise(0)


def segment_keys(line: Column, length: Column, threshold: int) -> list[tuple[Column, bool]]:
    """Keys of all substrings that may equal a segment of a line that is no longer, and whether
    the substring is a segment of the line itself."""
    out = []
    for delta in range(threshold + 1):
        other = length - delta
        for i in range(threshold + 1):
            start, size = _segment(other, i, threshold + 1)
            low, high = max(-i, delta - (threshold - i)), min(i, delta + (threshold - i))
            for shift in range(low, high + 1):
                at = start + shift
                key = F.when((other > threshold) & (at >= 1) & (at + size - 1 <= length),
                             F.xxhash64(other, F.lit(i), F.substr(line, at, size)))
                out.append((key, delta == 0 and shift == 0))
    return out


def bigram_parity(line: Column) -> Column:
    """64 parities of the numbers of bigrams, by hash; an edit changes four at most."""
    def body(p: Column) -> Column:
        bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                        F.pmod(F.xxhash64(F.get(p, j - 1), F.get(p, j)), F.lit(64)).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p)), F.lit(0).cast("bigint"), lambda x, j: x.bitwiseXOR(bit(j)))

    return let(F.split(line, ""), body)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of strings if it is at most ``threshold``, else a larger number.

    ``a`` is the shorter. Column j of the dynamic program is kept for rows j - threshold ... j + threshold as the
    bits of its vertical differences (+1: ``vp``, -1: ``vn``); the score runs down the lowest diagonal
    and then along the last row.
    """
    t, width = threshold, 2 * threshold + 1
    mask = (1 << width) - 1

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(mask).cast("bigint"))

    def bit(x: Column, at: Column) -> Column:
        return F.when(at >= 0, F.getbit(x, F.greatest(at, F.lit(0))).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    def run(p: Column, s: Column) -> Column:
        m, n = F.size(p), F.size(s)

        def column(state: Column, j: Column) -> Column:
            c, vp, vn = F.get(s, j - 1), state["vp"], state["vn"]
            x0 = sum((F.when(F.get(p, j - t + r - 1) == c, 1 << r).otherwise(0) for r in range(width)), F.lit(0)).cast("bigint")

            def after(x: Column) -> Column:
                d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask).cast("bigint"))
                return let(d0, lambda d: let(vn.bitwiseOR(flip(d.bitwiseOR(vp))), lambda hp: let(d.bitwiseAND(vp), lambda hn: F.struct(
                    hn.bitwiseOR(flip(F.shiftright(d, 1).bitwiseOR(hp))).alias("vp"),
                    F.shiftright(d, 1).bitwiseAND(hp).alias("vn"),
                    (state["score"] + F.when(j + t <= m, 1 - F.getbit(d, F.lit(2 * t)).cast("bigint")).otherwise(
                        bit(hp, m - j + t) - bit(hn, m - j + t))).alias("score")))))

            # the lowest diagonal never falls, and the last row can win back no more than threshold + n - m
            return F.when(state["score"] > 2 * t + n - m, state).otherwise(let(x0, after))

        first = sum(1 << r for r in range(t, width))
        start = F.struct(F.lit(first).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"),
                         F.least(F.lit(t), m).cast("bigint").alias("score"))
        return F.aggregate(F.sequence(F.lit(1), n), start, column)["score"]

    return F.when(a == b, F.lit(0).cast("bigint")).otherwise(
        let(F.split(a, ""), lambda p: let(F.split(b, ""), lambda s: run(p, s))))


def _documents(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(id, h, raw)``: id, hash of the text and its lines."""
    t = F.col(text)
    return documents.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("h"), F.split(t, "\n").alias("raw"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(id, h, n, line, len, l1, l2)`` of every line that takes part; l1 and l2 are its identity."""
    rows = docs.select("id", "h", F.posexplode("raw").alias("n", "raw"))
    rows = rows.select("id", "h", "n", F.trim("raw").alias("line")).where(F.char_length("line") >= min_chars)
    return rows.select("*", F.char_length("line").alias("len"), F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")


def _keyed(lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """``(key, l1)`` of the index and ``(p_key, p1, own)`` of the probes, a row for each different line."""
    keys = segment_keys(F.col("line"), F.col("len"), threshold)
    each = lines.select("l1", "l2", *[k.alias(f"k{j}") for j, (k, _) in enumerate(keys)])
    different = each.groupBy("l1", "l2").agg(*[F.min(f"k{j}").alias(f"k{j}") for j in range(len(keys))])
    different = cut(different, "line-segments")
    rows = different.select("l1", F.explode(F.array(*[
        F.struct(F.col(f"k{j}").alias("key"), F.lit(own).alias("own")) for j, (_, own) in enumerate(keys)])).alias("k"))
    rows = rows.select("k.key", "k.own", "l1").where("key IS NOT NULL")
    return rows.where("own").select("key", "l1"), rows.select(F.col("key").alias("p_key"), F.col("l1").alias("p1"), "own")


def _texts(docs: DataFrame, firsts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(l1, l2, place, line)`` of the lines ``ids (i)``, read from the document of the first occurrence."""
    wanted = firsts.join(ids, F.col("l1") == F.col("i"), "left_semi").groupBy(F.col("first.id").alias("at"), F.col("first.h").alias("at_h")).agg(
        F.collect_list(F.struct("first", "l1", "l2")).alias("wanted"))  # lines of one document
    rows = docs.join(wanted, F.col("id").eqNullSafe(F.col("at")) & (F.col("h") == F.col("at_h")))
    each = let(F.col("raw"), lambda raw: F.transform("wanted", lambda x: F.struct(
        x["l1"].alias("l1"), x["l2"].alias("l2"), x["first"].alias("place"), F.trim(F.get(raw, x["first"]["n"])).alias("line"))))
    return rows.select(F.inline(each)).dropDuplicates(["l1", "l2"])  # a repeated document gives its lines again


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame, threshold: int) -> DataFrame:
    """``(l1, l2)`` of the lines that have a near line whose first occurrence is earlier.

    Every join is a semi-join, so a key that many lines share gives a row for each line and never their pairs.
    """
    index, probe = _keyed(lines, threshold)
    # keys that a line has as a segment and another line probes, from an aggregate that copes with hot keys
    shared = probe.groupBy("p_key").agg(F.min("p1").alias("low"), F.max("p1").alias("high"), F.bool_or("own").alias("owned"))
    shared = cut(shared.where("owned AND low != high").select(F.col("p_key").alias("s_key")), "shared-keys")
    index = cut(index.join(shared, F.col("key") == F.col("s_key"), "left_semi"), "line-index")
    probe = cut(probe.drop("own").join(shared, F.col("p_key") == F.col("s_key"), "left_semi"), "line-probes")
    ids = index.select(F.col("l1").alias("i")).union(probe.select("p1")).distinct()
    texts = cut(_texts(docs, firsts, ids).withColumn("parity", bigram_parity(F.col("line"))), "line-texts")
    sides = {}
    for side, keys, key, own in (("a", index, "key", "l1"), ("b", probe, "p_key", "p1")):
        t = texts.select(*[F.col(c).alias(f"{side}_{c}") for c in texts.columns])
        sides[side] = keys.join(t, F.col(own) == F.col(f"{side}_l1")).drop(own).withColumnRenamed(key, f"{side}_key")
    a, b = sides["a"], sides["b"]
    n = F.char_length("b_line") - F.char_length("a_line")
    near = (F.col("a_key") == F.col("b_key")) & n.between(0, threshold) & (
        F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity"))) <= 4 * threshold) & (
        banded_distance(F.col("a_line"), F.col("b_line"), threshold) <= threshold)
    later_a = a.join(b, (F.col("a_place") > F.col("b_place")) & near, "left_semi").select("a_l1", "a_l2")
    later_b = b.join(a, (F.col("b_place") > F.col("a_place")) & near, "left_semi").select("b_l1", "b_l2")
    return cut(later_a.union(later_b).distinct().toDF("l1", "l2"), "near-lines")


def dropped_lines(documents: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, doc_id: str = "doc_id",
                  text: str = "text", exact_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, h, n_exact, gone)`` of the documents that lose lines; ``gone`` are their line numbers."""
    docs = _documents(documents, doc_id, text)
    lines = _lines(docs, min(exact_chars, min_chars))
    each = cut(lines.select("l1", "l2", "id", "h", "n"), "lines")  # read twice below, without the texts
    firsts = cut(each.groupBy("l1", "l2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("uses")), "line-firsts")
    near = near_lines(docs, lines.where(F.col("len") >= min_chars), firsts, threshold)
    repeated = firsts.where("uses > 1").select("l1", "l2", "first")
    rules = cut(repeated.join(near.withColumn("near", F.lit(True)), ["l1", "l2"], "full").select("l1", "l2", "first", "near"), "line-rules")
    hit = each.join(rules, ["l1", "l2"]).withColumn("near", F.coalesce("near", F.lit(False))).where(F.col("near") | (F.col("first") != _place()))
    return cut(hit.groupBy("id", "h").agg(F.count_if(~F.col("near")).alias("n_exact"), F.collect_set("n").alias("gone")), "dropped-lines")


def without_lines(documents: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, doc_id: str = "doc_id",
                  text: str = "text", exact_chars: int = MIN_CHARS) -> tuple[DataFrame, str, str]:
    """``documents`` with the lines dropped from ``text``, and the names of two columns more: the exact
    copies among the dropped lines, and all of them (null where none are)."""
    gone = dropped_lines(documents, threshold, min_chars, doc_id, text, exact_chars)
    exact, all_, g_id, g_h, at = private(documents, "n_exact", "n_gone", "g_id", "g_h", "g_at")
    g = gone.select(F.col("id").alias(g_id), F.col("h").alias(g_h), F.col("n_exact").alias(exact), F.col("gone").alias(at))
    on = documents[doc_id].eqNullSafe(g[g_id]) & (F.xxhash64(documents[text]) == g[g_h])
    kept = let(F.col(at), lambda x: F.filter(F.split(documents[text], "\n"), lambda _, i: ~F.array_contains(x, i)))
    cleaned = F.when(F.col(at).isNull(), documents[text]).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(text) if c == text else documents[c] for c in documents.columns]
    return documents.join(g, on, "left").select(*columns, exact, F.size(at).cast("bigint").alias(all_)), exact, all_


def line_report(documents: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_exact, n_near, text)``: lines dropped as copies and as near copies, and the text without them."""
    docs = documents.select("doc_id", "text")
    out, exact, all_ = without_lines(docs, threshold, min_chars, exact_chars=exact_chars)
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", F.coalesce(exact, zero).alias("n_exact"),
                      F.coalesce(F.when(F.col(all_).isNotNull(), F.col(all_) - F.col(exact)), zero).alias("n_near"), "text")


def drop_lines(documents: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, doc_id: str = "doc_id",
               text: str = "text", exact_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with the lines dropped; a document that loses all its text goes."""
    out, _, all_ = without_lines(documents, threshold, min_chars, doc_id, text, exact_chars)
    return out.where(F.col(all_).isNull() | (F.trim(text) != "")).select(*documents.columns)
