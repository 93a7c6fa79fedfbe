"""Token counts with an exact count at every prefix.

A text falls into pieces (the tokenizer's own split), and a piece's tokens depend on it alone. For each
distinct piece a dynamic program over its bytes finds the last token of every prefix: token t ends
the prefix of length i if it is a suffix of it and the tokens before it, those of the prefix of length
i - len(t), end in one that stays apart from t when both are encoded together; exactly one t does. So
count(i) = count(i - len(t)) + 1, kept for every i. One automaton of all tokens names those that end at
each byte. A text's count at a prefix is the sum over the
pieces before plus one look-up; totals, truncation and budget questions never encode a text again.

A prefix that ends inside a piece is split as that prefix alone would be: a contraction that is cut off
and white space at the end split differently, so its last pieces are split again (a few characters).

Strings of special tokens inside a text are one token each, as the library handles them by default.

Defined results: a null text is empty and has 0 tokens; repeated rows get equal results; an empty table
gives no rows. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 1024
#: Distinct pieces whose counts a worker keeps; beyond it those go that were not met for the longest time.
KEPT_PIECES = 1_000_000
#: Longer pieces are counted in arrays and not kept, so memory is in proportion to the piece.
KEPT_BYTES = 64
#: The tokenizer's split (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts of one byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        text = {t: bytes(letter[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
        self.tokens = sorted(set(text.values()))
        self.ends = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.ends.add_word(t.decode("latin-1"), (len(t), k))
        self.ends.make_automaton()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(text[a], text[b]): k for k, (a, b) in enumerate(pairs)}
        pattern = regex.compile(PATTERN)
        self.findall, self.finditer, self.beyond = pattern.findall, pattern.finditer, regex.compile(r"[^\x00-\u052f]").search
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.total, self.older = {}, {}  # pieces met lately, and those met last before them
        self.states: dict[bytes, array] = {b"": array("q", [0])}  # counts at the prefixes of pieces that were asked for
        self.stays: dict[int, bool] = {}  # by pair of tokens, see apart

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes by the merges in order of rank."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether token ``b`` after token ``a`` (-1: none) stays as it is when both are encoded together."""
        first, then = self.tokens[a] if a >= 0 else b"", self.tokens[b]
        if len(self.stays) >= KEPT_PIECES:
            self.stays.clear()
        found = self.stays[a * len(self.tokens) + b] = self.merge(first + then) == ([first, then] if first else [then])
        return found

    def split(self, text: str) -> list[str]:
        """The library's pieces; letters beyond those that all versions of Unicode agree on are left to it."""
        if text.isascii() or not self.beyond(text):
            return self.findall(text)
        return [text[a:b] for _, (a, b) in self.pieces(text)]

    def program(self, data: bytes) -> Sequence[int]:
        """Tokens of the prefixes of 0, 1, ..., len(data) bytes of a piece."""
        counts, last = ([0], [-1]) if len(data) <= KEPT_BYTES else (array("q", [0]), array("q", [-1]))
        width, stays, done = len(self.tokens), self.stays.get, 0
        for end, (size, t) in self.ends.iter(data.decode("latin-1")):
            if end < done:
                continue  # the last token of this prefix is known
            before = last[end + 1 - size]
            apart = stays(before * width + t)
            if self.apart(before, t) if apart is None else apart:
                counts.append(counts[end + 1 - size] + 1)
                last.append(t)
                done = end + 1
        return counts

    def piece_counts(self, piece: bytes) -> Sequence[int]:
        """Token counts of the prefixes of 0, 1, ..., len(piece) bytes."""
        found = self.states.get(piece)
        if found is None:
            found = self.program(piece)
            if len(piece) <= KEPT_BYTES:
                if len(self.states) >= KEPT_PIECES // 10:
                    self.states.clear()
                self.states[piece] = array("q", found)
        return found

    def piece_total(self, piece: str) -> int:
        found = self.total.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                found = self.program(piece.encode("utf-8"))[-1]
            if len(piece) <= KEPT_BYTES:
                if len(self.total) >= KEPT_PIECES // 2:
                    self.older = self.total.copy()
                    self.total.clear()
                self.total[piece] = found
        return found

    def spans(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and these (True)."""
        if self.special is None:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at:m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def count(self, text: str) -> int:
        total, get, n = self.total, self.total.get, 0
        for part, special in self.spans(text):
            if special:
                n += 1
                continue
            for piece in self.split(part):
                found = get(piece)
                n += self.piece_total(piece) if found is None else found
        return n

    def each_piece(self, text: str) -> Iterator[str]:
        """The pieces of ``split``, found as they are asked for where that is possible."""
        if text.isascii() or not self.beyond(text):
            return (m[0] for m in self.finditer(text))
        return iter(self.split(text))

    def boundaries(self, text: str, budget: int | None = None) -> tuple[list[int], list[int]]:
        """Code point offsets of the pieces' ends, from 0, and the tokens up to each; with a budget only
        up to the first piece that ends above it."""
        at, n, ends, counts = 0, 0, [0], [0]
        for part, special in self.spans(text):
            for piece in [part] if special else self.each_piece(part):
                at += len(piece)
                n += 1 if special else self.piece_total(piece)
                ends.append(at)
                counts.append(n)
                if budget is not None and n > budget:
                    return ends, counts
        return ends, counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ..., len(text) code points, each as if encoded alone."""
        out = np.zeros(len(text) + 1, np.int64)
        ends, counts = self.boundaries(text)
        for k in range(1, len(ends)):
            out[ends[k - 1] + 1:ends[k] + 1] = self._inside(text, ends, counts, k)
        return out

    def _inside(self, text: str, ends: list[int], counts: list[int], k: int) -> np.ndarray:
        """Token counts of the prefixes that end in piece ``k`` (from 1), each as if encoded alone."""
        a, b = ends[k - 1], ends[k]
        offset = np.cumsum([len(c.encode("utf-8")) for c in text[a:b]])
        out = counts[k - 1] + np.asarray(self.piece_counts(text[a:b].encode("utf-8")))[offset]
        special = self.special is not None and self.special.fullmatch(text[a:b])
        after_space = k > 1 and text[ends[k - 2]:a].isspace()
        if special or after_space or not self._splits_alike(text[a:b]):
            back = k > 1 and (after_space or bool(special))
            first, base = (ends[k - 2], counts[k - 2]) if back else (a, counts[k - 1])
            # the end of this prefix is split anew; only the first characters of a piece can split differently
            for i in range(a + 1, (b if special else min(b, a + 4)) + 1):
                out[i - a - 1] = base + self.count(text[first:i])
        return out

    @staticmethod
    def _splits_alike(piece: str) -> bool:
        """Whether every prefix of the piece is one piece: not so for contractions or a lone space before a word."""
        return piece[0] not in "' " and not piece[0].isspace() or len(piece) == 1

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        ends, counts = self.boundaries(text, budget)
        if counts[-1] <= budget:
            return len(text)
        # a prefix over the budget by more than a piece can give back never fits: look back from the last that fits
        k = max(i for i, c in enumerate(counts) if c <= budget)
        for j in (k + 1, k):
            fits = np.flatnonzero(self._inside(text, ends, counts, j) <= budget) if 0 < j < len(ends) else ()
            if len(fits):
                return ends[j - 1] + int(fits[-1]) + 1
        return ends[k]


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counts(name: str, limit: int):
    def run(batches):
        import public_tokenizers  # the worker's own copy of the vocabulary

        c = counter(public_tokenizers.path(name))
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            n = [c.count(t) for t in texts]
            size = [len(t.encode("utf-8")) for t in texts]
            kept = [len(t) if k <= limit else c.longest_prefix(t, limit) for t, k in zip(texts, n, strict=True)]
            yield pa.record_batch([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, n, kept)]],
                                  names=["doc_id", "n_bytes", "n_tokens", "limit_chars"])
    return run


def token_report(documents: DataFrame, name: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """Tokens of each whole text; ``limit_chars`` is the longest prefix (code points) within ``limit`` tokens."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").alias("t"))
    return docs.mapInArrow(_counts(name, limit), f"doc_id {kind}, n_bytes long, n_tokens long, limit_chars long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")
