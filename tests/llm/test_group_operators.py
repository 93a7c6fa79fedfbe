"""Embedding and SimHash near-dedup, line dedup, mixing and the components against brute force."""

import collections
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from storelens.llm import embeddings as E
from storelens.llm import lines as N
from storelens.llm import mixing as M
from storelens.llm import simhash as S
from storelens.llm.components import connected_components
from storelens.llm.queries import op4_line_dedup


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.p[b] = a


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (301, 300)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    vecs = [base[i % 60] + rng.normal(size=16) * 0.05 * (i % 5) for i in range(400)]
    rows = [(i, v.tolist(), int(i % 60 % 3)) for i, v in enumerate(vecs)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(50)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1),
             (2004, rows[3][1], None), (2005, rows[3][1][:8], rows[3][2]), (7, rows[7][1], rows[7][2]), (None, rows[9][1], rows[9][2])]
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, u = collections.Counter(), Union(len(rows))
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    u.join(a, b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        r = u.find(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    want = sorted(((i, n[k], low[u.find(k)], i == low[u.find(k)]) for k, (i, _, _) in enumerate(rows)), key=repr)
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, cid int")
    assert sorted((tuple(r) for r in E.near_vectors(d, leaf=32, trees=6).collect()), key=repr) == want
    assert E.near_vectors(d.limit(0)).count() == 0


def test_forest_recall_on_borderline_pairs():
    rng = np.random.default_rng(1)
    x = E.unit(rng.normal(size=(3000, 64)))
    d = rng.normal(size=x.shape)
    d -= (d * x).sum(1, keepdims=True) * x
    y = 0.931 * x + (1 - 0.931 ** 2) ** 0.5 * E.unit(d)
    met = np.zeros(len(x), bool)
    for t in range(E.TREES):
        levels = E.fit_tree(np.concatenate([x, y]), t, 6)
        rows = [{(int(r), int(leaf)) for r, leaf in zip(*E.route(v, t, levels, E.spill_of(0.93, 64)), strict=True)} for v in (x, y)]
        met[[r for r, _ in rows[0] & rows[1]]] = True
    assert met.mean() > 0.99


def _fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(2)
    golay = S.Golay()
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    y = x.copy()
    for k in range(2):
        y ^= np.where(rng.random(4000) < 0.9, np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64), np.uint64(0))
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for side, v in zip(keys, (x, y), strict=True):
        for r, k in zip(*S.golay_keys(v.view(np.int64), golay), strict=True):
            side[int(r)].add(int(k))
    assert all(keys[0][i] & keys[1][i] for i in range(4000))


def test_long_runs_give_the_same_pairs():
    rng = np.random.default_rng(3)
    u = np.unique((rng.integers(0, 1 << 12, 2600).astype(np.uint64) << np.uint64(20)) | rng.integers(0, 4, 2600).astype(np.uint64))
    assert len(u) > S.LONG_RUN
    i, j = S.near_pairs(u, 2)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(a.tolist(), b.tolist()))


def _simhash_docs():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 80)))) for i in range(80)]
    docs += [(100 + i, t.replace("ax", "AX", 1) + (" zz" if i % 2 else "")) for i, t in docs[:40]]
    return docs + [(300, None), (301, ""), (302, "one"), (303, "one two"), (303, "one two"), (None, "one two"), (None, "w " * 400)]


def test_simhash_groups_equal_brute_force(spark):
    docs = _simhash_docs()
    fps, u = [_fingerprint(t) for _, t in docs], Union(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                u.join(a, b)
    low = {}
    for k, (i, _) in enumerate(docs):
        r = u.find(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.hex, r.component_id) for r in S.simhash_groups(d).select("*", S.fingerprint_hex(F.col("fp")).alias("hex")).collect()]
    assert sorted(got, key=repr) == sorted(((i, f"{f:016x}", low[u.find(k)]) for k, ((i, _), f) in enumerate(zip(docs, fps))), key=repr)
    kept = S.keep_one_per_group(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(low.values(), key=repr)
    assert S.simhash_groups(d.limit(0)).count() == 0
    single = {r.doc_id: r.fp for r in S.simhash_groups(d.where("doc_id < 100").drop("fp"), shingle=1).collect()}
    assert single == {i: x - (x >> 63 << 64) for i, t in docs if i is not None and i < 100 for x in [S.fingerprint(t, 1)]}


def test_of_repeated_rows_one_stays_with_its_columns(spark):
    rows = [(5, "a b c d", 1, "p"), (5, "a b c d", 2, "q"), (5, "other words than these here", 3, "r"), (6, "a b c d", 4, "s"),
            (None, None, 5, "t"), (None, "", 6, "u"), (None, None, 7, "v")]
    d = spark.createDataFrame(rows, "doc_id long, text string, simhash_id int, FP string")
    kept = S.keep_one_per_group(d)
    assert kept.columns == d.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == 3 and set(got) < set(rows) and sum(r[0] == 5 for r in got) == 2 and rows[2] in got
    assert S.keep_one_per_group(d.limit(0)).count() == 0


def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def _mutated(rng, s, most):
    b = list(s)
    for _ in range(rng.randint(0, most)):
        o, i = rng.randint(0, 2), rng.randint(0, len(b) - 1)
        if o == 0:
            b[i] = rng.choice("abé😀")
        elif o == 1:
            b.insert(i, rng.choice("abé😀"))
        elif len(b) > 1:
            del b[i]
    return "".join(b)


def test_banded_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 25)))
        a, b = sorted((a, _mutated(rng, a, 4)), key=len)
        pairs.append((a, b, _distance(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for t in (1, 2, 3):
        rows = df.where(f"char_length(b) - char_length(a) <= {t}").select("d", N.banded_distance(F.col("a"), F.col("b"), t).alias("x")).collect()
        assert all(r.x == r.d if r.d <= t else r.x > t for r in rows)


def test_an_edit_changes_four_bigram_parities_at_most(spark):
    rng = random.Random(8)
    pairs = [(a, _mutated(rng, a, 1)) for a in ("".join(rng.choice("abé😀") for _ in range(rng.randint(1, 25))) for _ in range(800))] + [("", "a"), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    flips = F.bit_count(N.bigram_parity(F.col("a")).bitwiseXOR(N.bigram_parity(F.col("b"))))
    assert df.where(flips > 4).count() == 0 and df.where(flips > 0).count() > 0


def test_lines_that_share_segments_are_joined_without_their_pairs(spark):
    rng = random.Random(9)
    body = ["".join(rng.choices("abcdefgh", k=30)) for _ in range(120)]
    d = spark.createDataFrame([(i, "the same long beginning of them all, " * 2 + x) for i, x in enumerate(body)] + [
        (1000 + i, "the same long beginning of them all, " * 2 + body[0]) for i in range(200)], "doc_id long, text string")
    lines = N._lines(N._documents(d, "doc_id", "text"), N.MIN_CHARS)
    index, probe = N._keyed(lines, N.THRESHOLD)
    assert index.count() == 3 * 120 and probe.count() <= 12 * 120  # copies are keyed once
    assert N.line_report(d).agg(F.sum("n_exact"), F.sum("n_near")).first() == (200, 0)


def _line_docs():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(22, 34))).strip() + "x" for _ in range(20)]
    docs = [(i if i % 17 else None, "\n".join(rng.choice((_mutated(rng, rng.choice(base), 3), "short", "")) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    return docs + docs[3:6] + [(5, None), (7, "same id, other text that is long enough"), (8, "y" * 3000), (9, "y" * 2999 + "z")]


def test_line_dedup_equals_brute_force(spark):
    docs = _line_docs()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, gone int")
    h = {(r.doc_id, r.text): r.h for r in d.select("*", F.xxhash64("text").alias("h")).collect()}
    place = lambda i, t, n: (i is None, i or 0, h[i, t], n)
    first = {}
    for p, line in sorted({(place(i, t, n), x.strip(" ")) for i, t in docs if t is not None for n, x in enumerate(t.split("\n"))}):
        if len(line) >= N.MIN_CHARS:
            first.setdefault(line, p)
    near = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2}

    def cleaned(i, t):
        return t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if len(s := x.strip(" ")) < N.MIN_CHARS or s not in near and first[s] == place(i, t, n))

    got = N.line_report(d).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, cleaned(i, t)) for i, t in docs), key=repr)
    assert sum(r.n_near for r in got) and sum(r.n_exact for r in got)
    kept = N.drop_lines(d)
    assert kept.columns == d.columns
    want = [(i, cleaned(i, t)) for i, t in docs if t is None or cleaned(i, t) == t or cleaned(i, t).strip(" ")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert N.line_report(d.limit(0)).count() == 0


def test_exact_copies_of_short_lines_go_in_the_query_and_the_pipeline(spark, tmp_path):
    rows = [(1, "Les.\nfirst long line of the first document\n\nAh"), (2, " Les. \nLez.\n\nAh\nLes."), (3, "Les."), (None, "Lez.\nnew"), (4, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_exact, r.n_near, r.text) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0, rows[0][1]), 2: (3, 0, "Lez.\n"), 3: (1, 0, ""), None: (1, 0, "new"), 4: (0, 0, None)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.dedupe_lines(spark, d, str(tmp_path)).collect()}
    assert kept == {1: rows[0][1], 2: "Lez.\n", None: "new", 4: None}


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        full |= over


def _mix_docs():
    rng = random.Random(7)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "c", "d", None])) for i in range(150)]
    return docs + [(500, "w " * 9000, "a"), (501, None, "a"), (502, " ", "z"), (503, "x y", "tiny"), (503, "x y", "tiny"), (None, "q w e", "b")]


def test_mixing_meets_targets_and_repeats(spark):
    docs = _mix_docs()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    target = _targets(sizes)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, sid int")
    rows = M.mix_report(d).collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in rows if r.doc_id is not None) == sorted((i, size(t), sizes[s]) for i, t, s in docs if i is not None)
    taken = collections.Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * M.BLOCK_WORDS for s in target)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, M.mix_report(d.repartition(5)).collect()), key=repr)
    pieces = M.mixture(d, shard_slots=64).groupBy("source").agg(F.sum("n_words")).collect()
    assert all(abs((n or 0) - target[s]) <= 2 * M.BLOCK_WORDS for s, n in pieces)
    assert M.mix_report(d.limit(0)).count() == 0
    assert {r.taken for r in M.mix_report(d.where("text = ' '")).collect()} == {0}


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        i = np.arange(n)
        assert sorted(M.permuted(i, np.full(n, n), np.full(n, 99)).tolist()) == i.tolist()


def test_shards_look_like_the_mix():
    slots = np.array([500, 3000, 0, 1500])
    rows = M.draw_shards(slots, 1000, 1)
    count = np.zeros((5, 4), int)
    for s, shard, n, first in rows:
        assert first == count[:shard, s].sum()
        count[shard, s] = n
    assert (count.sum(0) == slots).all() and (count.sum(1) == 1000).all() and abs(count[0, 1] - 600) < 80


def test_groups_of_shards_are_drawn_in_tasks_to_the_same_totals(spark):
    targets = spark.createDataFrame([(0, 64 * 500, 64.0 * 700), (1, 64 * 3000, 64.0 * 3000), (2, 64, 64.0), (3, 0, 0.0)],
                                    "sid int, source_size long, target double")
    got = M.drawn_slots(targets, shard_slots=100, groups=7).collect()
    assert sorted((r.sid, r.slot) for r in got) == [(s, k) for s, n in ((0, 700), (1, 3000), (2, 1)) for k in range(n)]
    count = collections.Counter(r.shard for r in got)
    assert sorted(count) == list(range(38)) and all(count[k] == 100 for k in range(37)) and count[37] == 1
    share = collections.Counter((r.shard, r.sid) for r in got)
    assert all(2 < share[k, 0] < 45 for k in range(37))  # 18.9 of 100 on average
    assert max(collections.Counter((r.sid, r.block) for r in got).values()) == 2
    again = M.drawn_slots(targets, shard_slots=100, groups=7).collect()
    assert sorted(got) == sorted(again)
    one = M.drawn_slots(targets, shard_slots=100).collect()  # few shards: drawn at once
    assert sorted((r.sid, r.slot, r.block) for r in one) == sorted((r.sid, r.slot, r.block) for r in got)
