"""Language ID by a bidirectional gated recurrent network over bytes.

Two GRUs, one in each direction, read windows of ``WINDOW`` bytes; each position gets a softmax over
the languages from both states, and a document's probabilities are the mean over the positions of its
letters (every window of the whole text is read). The network is trained in numpy by
backpropagation through time on windows of a bounded sample of labelled rows
(``sample_docs`` rows at most, about as many of each language, chosen by a hash of their id);
the labels of the rows to predict, their source and id are no input.

Training rows: text and lang not null, crc32(doc_id as text) mod 4 not 2. The driver holds one count for
each language and the sampled windows (``sample_docs`` x ``WINDOWS_PER_DOC`` x ``WINDOW`` bytes at most).

Defined results: a null text or one without a letter is ``und`` with score 0; a row with a null doc_id is
not held out and not learned from; repeated rows get equal results; with nothing to learn from every
row is ``und``; an empty table gives no rows. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private

WINDOW, HIDDEN, SAMPLE_DOCS, WINDOWS_PER_DOC = 64, 8, 2000, 6
STEPS, BATCH, RATE, SEED = 160, 160, 0.02, 11
UNKNOWN, PAD = "und", 0
#: A language is told if the score is this share of the way from chance (1 / languages) to 1, and the letter pairs are
#: ``MIN_FAMILIAR`` of the way from random letters to the median of learned-language windows kept out of the table.
MIN_SCORE, MIN_FAMILIAR = 0.05, 0.5
#: Added to each count of a pair of letters.
PAIR_PRIOR = 0.05
#: One in so many sampled rows is kept out of the pair table for its limit.
HELD = 5
#: Windows that are read at a time.
CHUNK = 2048


def init(n_lang: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"V": rng.normal(0, 0.3, (2 * hidden, n_lang)), "c": np.zeros(n_lang)}
    for d in "fb":
        p |= {f"X{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"U{d}": rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)),
              f"B{d}": np.zeros(3 * hidden)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def states(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: bool = False):
    """States of one direction for bytes ``x`` (time, row); with ``keep`` what the way back needs."""
    hidden = p[f"U{d}"].shape[0]
    rows, look, U = x.shape[1], p[f"X{d}"] + p[f"B{d}"], p[f"U{d}"]
    h, out, kept = np.zeros((rows, hidden), np.float32), np.empty((*x.shape, hidden), np.float32), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        a, g = look[x[t]], h @ U
        zr = np.tanh((a[:, :2 * hidden] + g[:, :2 * hidden]) * np.float32(0.5))  # a sigmoid through tanh
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r, gn = zr[:, :hidden], zr[:, hidden:], g[:, 2 * hidden:]
        n = r * gn
        n += a[:, 2 * hidden:]
        np.tanh(n, out=n)
        if keep:
            kept.append((t, h, z, r, n, gn))
        h = n + z * (h - n)
        out[t] = h
    return (out, kept) if keep else out


def soft(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def position_probabilities(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(time, row, language)"""
    hidden = p["Uf"].shape[0]
    return soft(states(p, "f", x) @ p["V"][:hidden] + states(p, "b", x) @ p["V"][hidden:] + p["c"])


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss over all positions but padding, and its gradients by backpropagation through time."""
    hidden = p["Uf"].shape[0]
    runs = {d: states(p, d, x, keep=True) for d in "fb"}
    h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    prob = soft(h @ p["V"] + p["c"])
    real = (x != PAD).astype(np.float32)
    weight = real / max(1.0, real.sum())
    rows = np.arange(x.shape[1])
    loss = -float((np.log(prob[:, rows, y] + 1e-9) * weight).sum())
    prob[:, rows, y] -= 1
    dl = prob * weight[:, :, None]
    g = {"V": np.tensordot(h, dl, ([0, 1], [0, 1])), "c": dl.sum(axis=(0, 1))}
    for d, at in (("f", slice(None, hidden)), ("b", slice(hidden, None))):
        dh_out, U = dl @ p["V"][at].T, p[f"U{d}"]
        gx, gu, dh = np.zeros_like(p[f"X{d}"]), np.zeros_like(U), np.zeros((x.shape[1], hidden), np.float32)
        for t, before, z, r, n, gn in reversed(runs[d][1]):
            dh = dh + dh_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(gx, x[t], da)
            gu += before.T @ dg
            dh = dh * z + dg @ U.T
        g |= {f"X{d}": gx, f"U{d}": gu, f"B{d}": gx.sum(axis=0)}
    return loss, g


def train(x: np.ndarray, y: np.ndarray, n_lang: int, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam over random batches of windows ``x`` (row, time) with languages ``y``."""
    rng, p = np.random.default_rng(seed), init(n_lang, seed=seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    by = [np.flatnonzero(y == k) for k in range(n_lang)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, -(-BATCH // n_lang)) for i in by])
        _, g = gradients(p, np.ascontiguousarray(x[pick].T), y[pick])
        rate = RATE * (1 - step / (steps + 1))
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return p


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (row, time), padded at each end of text, and the text of each."""
    n = [-(-len(t) // WINDOW) for t in texts]
    flat = b"".join(t + bytes(k * WINDOW - len(t)) for t, k in zip(texts, n, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), n)


_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)], np.float32)


def pooled(p: dict[str, np.ndarray], texts: list[bytes], n_lang: int) -> np.ndarray:
    """Mean probabilities over the letters of each text."""
    total = np.zeros((len(texts), n_lang + 1))
    x, owner = windows(texts)
    for a in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[a:a + CHUNK].T)
        w = _LETTER[part]
        sums = np.einsum("trl,tr->rl", position_probabilities(p, part), w)
        np.add.at(total, owner[a:a + CHUNK], np.concatenate([sums, w.sum(axis=0)[:, None]], axis=1))
    return total[:, :-1] / np.maximum(total[:, -1:], 1)


def pair_table(x: np.ndarray, y: np.ndarray, n_lang: int) -> np.ndarray:
    """(language, byte, next byte): logarithm of the share that the next byte has among the letters after the byte."""
    out = np.empty((n_lang, 256, 256), np.float32)
    for k in range(n_lang):
        a, b = x[y == k, :-1].ravel(), x[y == k, 1:].ravel()
        both = (_LETTER[a] * _LETTER[b]).astype(bool)
        n = np.bincount(a[both].astype(int) * 256 + b[both], minlength=1 << 16).reshape(256, 256) + PAIR_PRIOR
        out[k] = np.log(n / n.sum(axis=1, keepdims=True))
    return out


def familiar(p: dict[str, np.ndarray], text: bytes, lang: int) -> float:
    """Mean of the language's pair table over the letter pairs of a text: how much it looks like what was learned."""
    t = np.frombuffer(text, np.uint8)
    both = (_LETTER[t[:-1]] * _LETTER[t[1:]]).astype(bool)
    return float(p["T"][lang, t[:-1][both], t[1:][both]].mean()) if both.any() else 0.0


def familiar_limits(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, out: np.ndarray, n_lang: int) -> np.ndarray:
    """For each language the least ``familiar`` of its texts, between random letters and the windows ``out`` of the table."""
    limits = np.zeros(n_lang)
    for k in range(n_lang):
        mine = x[(y == k) & out] if (out & (y == k)).any() else x[y == k]
        letters = np.flatnonzero(np.bincount(x[y == k].ravel(), minlength=256) * _LETTER)
        chance, usual = p["T"][k][np.ix_(letters, letters)].mean(), np.median([familiar(p, w.tobytes(), k) for w in mine])
        limits[k] = chance + MIN_FAMILIAR * (usual - chance)
    return limits


def _sampled_windows(batches):
    for b in batches:
        text, lang, h = b.column("t").to_pylist(), b.column("l").to_pylist(), b.column("h").to_pylist()
        out = []
        for t, name, seed in zip(text, lang, h, strict=True):
            x, _ = windows([t.encode("utf-8")])
            pick = np.random.default_rng(seed % (1 << 32)).permutation(len(x))[:WINDOWS_PER_DOC]
            out += [(x[k].tobytes(), name, seed) for k in sorted(pick)]
        yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.int64()))],
                              names=["x", "l", "h"])


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text",
        lang: str = "lang", pairs: bool = True) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """The languages and the network, learned from ``documents``; with ``pairs`` also the letter pairs of each language."""
    rows = documents.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(doc_id).cast("string").alias("i")).where(
        "t IS NOT NULL AND l IS NOT NULL AND crc32(i) % 4 <> 2").where(F.col("t").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # one for each language
    if not counts:
        return [], None
    langs = sorted(counts)
    # the share of each language stands in the filter of the scan: nothing but the sample is moved
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / len(langs) / n))])
    h = F.xxhash64(F.lit(SEED), "i", "t")
    picked = rows.withColumn("h", h).where(F.pmod("h", F.lit(1_000_000)) < share[F.col("l")] * 1_000_000).select("t", "l", "h")
    got = picked.mapInArrow(_sampled_windows, "x binary, l string, h long").orderBy("h", "x").limit(
        2 * sample_docs * WINDOWS_PER_DOC).collect()
    langs = sorted({r["l"] for r in got})
    if not langs:
        return [], None
    x, y = np.stack([np.frombuffer(r["x"], np.uint8) for r in got]), np.array([langs.index(r["l"]) for r in got])
    if not pairs:
        return langs, train(x, y, len(langs))
    out = np.array([r["h"] % HELD == 0 for r in got])
    out &= np.bincount(y)[y] >= 10 * HELD  # a language with few windows keeps them all in the table
    network = train(x, y, len(langs)) | {"T": pair_table(x[~out], y[~out], len(langs))}
    return langs, network | {"limit": familiar_limits(network, x, y, out, len(langs))}


def _predict(langs: list[str], p: dict[str, np.ndarray] | None, names: list[str], strict: bool):
    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            known = [k for k, t in enumerate(texts) if t is not None and langs]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                prob = pooled(p, [texts[k].encode("utf-8") for k in known], len(langs))
                best = prob.argmax(axis=1)
                score[known] = np.clip(prob[np.arange(len(known)), best], 0, 1)
                for k, i in zip(known, best, strict=True):
                    if not strict or familiar(p, texts[k].encode("utf-8"), i) >= p["limit"][i]:
                        pred[k] = langs[i]
            yield pa.record_batch([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=names)
    return run


def predict(documents: DataFrame, langs: list[str], network, text: str = "text", strict: bool = False) -> tuple[DataFrame, str, str]:
    """``documents`` with the predicted language and its score, and the names of these two columns.

    With ``strict`` a text whose letter pairs don't look like the language is ``und``."""
    pred, score, seen = private(documents, "lang_pred", "score", "letters")
    readable = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))  # null, and with it und, without a letter
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    names = [*documents.columns, pred, score]
    return documents.withColumn(seen, readable).mapInArrow(
        _predict(langs, network, names, strict), f"{fields}, `{pred}` string, `{score}` double"), pred, score


def language_report(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    langs, network = fit(documents, sample_docs, pairs=False)
    docs = documents.select("doc_id", F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 4 = 2"), F.lit(False)).alias("held_out"),
                            "text")
    out, _, _ = predict(docs, langs, network)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(documents: DataFrame, min_score: float = MIN_SCORE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents whose language is told, ``min_score`` of the way from chance to 1 at least; ``und`` goes."""
    langs, network = fit(documents, sample_docs)
    out, pred, score = predict(documents, langs, network, strict=True)
    chance = 1 / max(1, len(langs))
    least = chance + min_score * (1 - chance) - 1e-6
    return out.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*documents.columns)
