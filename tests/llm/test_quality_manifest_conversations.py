"""Quality rules, Merkle manifest and conversation repair against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from storelens.llm import conversations as C
from storelens.llm import manifest as M
from storelens.llm import quality as Q

WHITE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------------ quality rules
def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(lines)


def cell(v):
    s = max(v.bit_length() - 7, 0)
    return v >> s << s


def brute_quality(rows):
    """rows (doc_id, text, lang, source) -> doc_id, five counts, base_failed, kept"""
    got = [counts(t) for _, t, _, _ in rows]
    rates = [None if not n else {"word_length": c * 100 // n, "symbols": s * 1000 // n, "repeated_lines": d * 1000 // k, "repeated_words": r * 1000 // n}
             for n, c, s, d, r, k in got]
    groups = collections.defaultdict(lambda: collections.defaultdict(list))
    for (_, _, lang, source), x in zip(rows, rates, strict=True):
        for rate, v in (x or {}).items():
            for level in ((lang, source), (lang,), ()):
                groups[level][rate].append(cell(v))
    out = []
    for (i, _, lang, source), x, c in zip(rows, rates, got, strict=True):
        base = c[0] < 50 or 100 * c[4] > 50 * c[0]
        far = False
        for rate, v in (x or {}).items():
            values = next(sorted(groups[k][rate]) for k in ((lang, source), (lang,), ()) if len(groups[k][rate]) >= Q.LEAST_DOCS or not k)
            lo, hi = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            spread = max(hi - lo, Q.LEAST_SPREAD[rate])
            far |= v > hi + Q.FENCE * spread or rate == "word_length" and v < lo - Q.FENCE * spread
        out.append((i, *c[:5], base, not base and not far))
    return out


def documents(seed, n=400):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "to", "of", "és", "日本", "x" * 40, "a|b", "##", "\U0001f600"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 3, 5, 49, 50, 51, 80, 300])
        vocab = words if rng.random() < 0.3 else [rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(rng.choice([9, 900]))) for _ in range(60)]
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n", "\x0b", " \n\n"]) for _ in range(k))
        rows.append((i, rng.choice([text, text, text, " " + text, None]), rng.choice([None, "de", "en", "en"]), rng.choice([None, "a", "a", "a", "b", ""])))
    return rows + [rows[7], rows[7], (None, "word " * 60, "en", "a"), (9999, "ab cd " * 4000 + "end", "en", "a"),
                   (10000, " ".join(f"w{i}" for i in range(30000)), "en", "a")]


DOC = "doc_id long, text string, lang string, source string"


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_quality_equals_brute_force_with_clashing_columns(spark):
    rows = documents(1)
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("n_words", "kept", "q_text", "lim_lang", "rate", "cell", "W", "n")})
    got = Q.quality_report(df)
    assert got.columns == ["doc_id", *Q.COUNTS, "base_failed", "kept", "out_of_line"]
    want = brute_quality(rows)
    assert key(got.drop("out_of_line").collect()) == key(want)
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert key(r[:1] for r in kept.collect()) == key((w[0],) for w in want if w[-1])
    assert 0 < sum(w[-1] for w in want) < len(want)


def test_quality_of_empty_tables_and_small_groups(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], DOC)
    assert key(r[1:8] for r in Q.quality_report(df).collect()) == [(0, 0, 0, 0, 0, True, False)] * 2
    assert Q.quality_report(df.limit(0)).count() == 0


def test_quality_sketches_merge_in_any_order(spark):
    table, names = Q.measured(spark.createDataFrame(documents(2), DOC))
    cols = {r: names[r] for r in Q.RATES}
    whole = Q.sketches(table, names["lang"], names["source"], cols)
    parts = Q.sketches(table.where("doc_id % 3 = 0"), names["lang"], names["source"], cols).union(
        Q.sketches(table.where("doc_id % 3 <> 0 or doc_id is null"), names["lang"], names["source"], cols))
    assert key(Q.merged(parts, ["lang", "source"]).collect()) == key(whole.collect())
    for v in (0, 1, 63, 64, 127, 128, 129, 1000, 123456, 10**12):
        assert spark.range(1).select(Q.cell(F.lit(v).cast("bigint"))).first()[0] == cell(v) and 0 <= v - cell(v) <= v / 64


def test_quality_finds_junk_of_a_language_and_leaves_prose(spark):
    rng = random.Random(3)
    prose = lambda k: " ".join(rng.choice(["the", "of", "house", "river", "walking"]) + str(rng.randrange(9999)) for _ in range(k))
    rows = [(i, prose(120), "en", "hot" if i % 3 else "a") for i in range(300)]
    rows += [(1000 + i, " | ".join(prose(1) for _ in range(80)), "en", "hot") for i in range(10)]
    rows += [(2000 + i, " ".join("x" * 30 for _ in range(2)) + " " + " ".join(f"{j:030d}" for j in range(80)), "en", "a") for i in range(10)]
    kept = {r.doc_id for r in Q.quality_report(spark.createDataFrame(rows, DOC)).where("kept").collect()}
    assert kept == set(range(300))


# ------------------------------------------------------------------ Merkle manifest
def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def sides(levels, j):
    out = []
    for nodes in levels[:-1]:
        a = j - j % 3
        out.append(("".join(nodes[a:j]), "".join(nodes[j + 1:a + 3])))
        j //= 3
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(field, (*r[:4], text))))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = [levels_of([leaf(r, r[4]) for r in by[s]]) for s in names]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for j, r in enumerate(by[s]):
            way = sides(trees[k], j) + sides(top, k)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            x = leaf(r, text)
            for left, right in way:
                x = H(left + x + right)
            out.append((r[0], trees[k][0][j], trees[k][-1][0], top[-1][0], H("".join(a + b for a, b in way)), x, x == top[-1][0]))
    return out


LEAF = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(df):
    return M.merkle_report(df, F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))))


def test_manifest_equals_brute_force_with_a_hot_source(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(900), 2**62 + i]), rng.choice([None, "a", "é", "z", "", "Ω", "one"[i % 3:]] + ["hot"] * 8), None if i % 5 else "x",
             i % 7 or None, rng.choice([None, "", "a\nb", "x", "日本\n"])) for i in range(3000)]
    rows += [(1, "hot", "x", 1, "same")] * 40 + [(5, "alone", None, None, None)]
    df = spark.createDataFrame(rows, LEAF).withColumns({c: F.lit(1) for c in ("leaf", "hash", "tree", "idx", "m", "row", "pos", "n", "__part", "id")})
    got = manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert key(got.collect()) == key(brute_manifest(rows))


def test_manifest_with_many_sources(spark):
    rows = [(i, f"s{i % 800}", "en", i, f"text\n{i}") for i in range(1700)]
    assert key(manifest(spark.createDataFrame(rows, LEAF)).collect()) == key(brute_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 729, 730])
def test_manifest_of_small_sizes(spark, n):
    rows = [(i, "s", None, None, "a\nb") for i in range(n)]
    got = manifest(spark.createDataFrame(rows, LEAF)).collect()
    assert key(got) == key(brute_manifest(rows) if n else [])
    if n == 1:
        assert got[0].root == got[0].leaf and got[0].proof_sha256 == H("")


def test_proofs_fold_to_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "t") for i in range(50)]
    got = M.merkle_report(spark.createDataFrame(rows, LEAF), with_proofs=True).collect()
    assert all(r.verified and M.folded(r.leaf, r.proof) == r.root for r in got)


# ------------------------------------------------------------------ conversation repair
def brute_repair(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs[c] += [] if k == 0 else [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    out = []
    for c, rs in convs.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).digest()))
        seen, fault = set(), []
        for _, r, x in rs:
            y = x.strip(WHITE)
            fault.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        ts = [t for t, _, _ in rs if t is not None]
        # forward table: for each state the least (cost, edits) and its rows
        best = {"": (0, "", [])}

        def better(table, s, new):
            if s not in table or new[:2] < table[s][:2]:
                table[s] = new

        def inserted(table):
            for _ in range(3):
                for s, (cost, edits, done) in list(table.items()):
                    better(table, turn[s], (cost + 2, edits + "I", [*done, name[turn[s]] + ":"]))

        for (_, r, x), f in zip(rs, fault, strict=True):
            inserted(best)
            new, i, extra = {}, r[:1], int(f == "truncated")
            for s, (cost, edits, done) in best.items():
                better(new, s, (cost + 3, edits + "D", done))
                if f in ("", "truncated"):
                    if i == "s" and s == "" or i == "u" and s != "u" or i == "a" and s == "u":
                        better(new, i, (cost + extra, edits + "K", [*done, f"{r}:{x}"]))
                    better(new, turn[s], (cost + 2 + extra, edits + "R", [*done, f"{name[turn[s]]}:{x}"]))
            best = new
        inserted(best)
        cost, edits, done = min((best[s] for s in ("", "a") if s in best), key=lambda n: n[:2])
        out.append((c, max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:])), cost, edits, H("\n".join(done))))
    return out


TURN = "conv_id long, turn long, role string, text string"


def talk(seed, n, ids):
    rng = random.Random(seed)
    return [(rng.choice(ids), rng.choice([None, *range(900)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User", "u"]),
             rng.choice([None, "", "a.", "b", "c!  ", ".\n", "x y z?", "é. ", "hm", "v.", f"{rng.random()}."])) for _ in range(n)]


def test_repair_equals_brute_force_with_a_hot_conversation(spark):
    rows = talk(2, 3000, [None, 1, 2, 3, 4, 5] + [9] * 12) + [(7, 3, "user", "same.")] * 30
    df = spark.createDataFrame(rows, TURN).withColumns({c: F.lit(1) for c in ("key", "n", "pos", "block", "letter", "k", "th", "row", "edits", "what")})
    assert key(C.repair_report(df).collect()) == key(brute_repair(rows))


def test_repair_of_many_short_conversations(spark):
    rows = talk(3, 3000, list(range(900)))
    assert key(C.repair_report(spark.createDataFrame(rows, TURN)).collect()) == key(brute_repair(rows))


def test_repair_of_none_and_of_dropped_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "hello.")], TURN)
    assert [tuple(r) for r in C.repair_report(df).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", H(""))]
    assert C.repair_report(df.limit(0)).count() == 0


def test_blocks_give_the_same_edits_as_the_whole():
    rng = random.Random(5)
    for _ in range(60):
        letters = "".join(rng.choice("suaxSUAX0123uuaa") for _ in range(rng.randrange(1, 40)))
        _, whole = C.walk(letters, C.LAST, C.START, True)
        size = rng.randrange(1, 9)
        parts = [letters[i:i + size] for i in range(0, len(letters), size)]
        ends = {p["block"]: p["ending"] for p in C._checkpoints(
            {"key": "k", "parts": [{"block": i, "matrix": C.block_matrix(p)} for i, p in enumerate(parts)]})}
        s, edits = C.START, ""
        for i, p in enumerate(parts):
            s, e = C.walk(p, tuple(ends[i]), s, i + 1 == len(parts))
            edits += e
        assert edits == whole
