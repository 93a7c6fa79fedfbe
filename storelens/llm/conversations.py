"""Repair of conversation structure by a square-root checkpointed dynamic program.

A conversation is a sequence of rows whose role initials should read ``(s?(ua)+)?``. Rows that are blank
or repeat an earlier one must go; every other row may be kept, given the other role, or deleted, and empty
turns may be inserted. The cheapest edits are wanted, of equally cheap ones those with the
ASCII-least string of initials (D, I, K, R).

What a row allows depends on one letter, so a conversation is a string of letters. It is cut into
blocks of about the square root of its length (:data:`LEAST_BLOCK` letters at least). Each block becomes a
(min, +) matrix of the four states - nothing yet, after system, after user, after assistant. From the
matrices, a square root of them for a conversation, follow the backward cost vectors at the block ends: the
checkpoints, the only vectors that are kept. Each block then recomputes its own vectors from its
checkpoint and walks forward on tight edits, from each state that it could be entered in; the chain of these
small maps gives the state that each block is entered in, and with it its edits. No task but the last sees
more than a block or a block's summary for each block. The last one streams a conversation's rows in order and hashes
the repaired text as it goes: a SHA-256 of a whole conversation can't be divided, but it holds one row
and the edits, which are part of the result.

Order: rows go by turn, nulls first, then role, then the text's hash, so equal rows are adjacent.

Defined results: null roles and texts are one space (so blank, or of no known role); a null
conversation id is a conversation; an unknown role can't be kept; a conversation without rows, or all of
whose rows go, has empty edits and the hash of the empty text; an empty table gives no rows. Other columns
are not looked at and may have any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from .common import cut

LEAST_BLOCK = 64
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Role classes of a row; with what may be done to it they make its letter: lower case for a sound row, upper case
#: for one that breaks off, a digit for one that must go.
CLASSES, LETTERS = "suax", {"sound": "suax", "broken": "SUAX", "gone": "0123"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after an inserted or rerolled row: a user's turn unless a user spoke last.
TURN = (USER, USER, ASSISTANT, USER)
#: Costs from each state when all rows are read: whole conversations end with nothing or with the assistant.
LAST = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
WHITE, WHITE_CLASS = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]"


def _kept(cls: str) -> tuple:
    """The state after keeping a row of the class, by state; None where it can't be kept."""
    return {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}.get(cls, (None,) * 4)


#: letter -> (may stay, extra cost of staying, state after keeping by state)
RULES = {letter: (kind != "gone", CUT_OFF * (kind == "broken"), _kept(cls))
         for kind, letters in LETTERS.items() for letter, cls in zip(letters, CLASSES, strict=True)}
CLASS_OF = {letter: cls for letters in LETTERS.values() for letter, cls in zip(letters, CLASSES, strict=True)}
LEGAL = {"su", "ua", "au"}


def before(letter: str, after: tuple) -> tuple:
    """Costs from each state before a row, from those after it: the row's edit, with turns inserted first if cheaper."""
    stays, extra, kept = RULES[letter]
    v = []
    for s in STATES:
        best = DELETE + after[s]
        if stays:
            best = min(best, REROLE + extra + after[TURN[s]])
            if kept[s] is not None:
                best = min(best, KEEP + extra + after[kept[s]])
        v.append(best)
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


def block_matrix(letters: str) -> list[int]:
    """Costs from each state before the block to each state after it, row by row."""
    columns = []
    for t in STATES:
        v = tuple(0 if s == t else FAR for s in STATES)
        for x in reversed(letters):
            v = before(x, v)
        columns.append(v)
    return [min(columns[t][s], FAR) for s in STATES for t in STATES]


def walk(letters: str, end: tuple, start: int, last: bool) -> tuple[int, str]:
    """``(state after, edits)`` of the ASCII-least tight edits of a block; ``end`` is the checkpoint behind it."""
    costs = [end]
    for x in reversed(letters):
        costs.append(before(x, costs[-1]))
    costs.reverse()
    s, out = start, []
    for i, x in enumerate(letters):
        stays, extra, kept = RULES[x]
        now, then = costs[i], costs[i + 1]
        while True:
            if now[s] == DELETE + then[s]:
                out.append("D")
                break
            if now[s] == INSERT + now[TURN[s]]:
                out.append("I")
                s = TURN[s]
                continue
            if stays and kept[s] is not None and now[s] == KEEP + extra + then[kept[s]]:
                out.append("K")
                s = kept[s]
                break
            out.append("R")
            s = TURN[s]
            break
    while last and end[s]:
        out.append("I")
        s = TURN[s]
    return s, "".join(out)


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """``(key, turn, role, text)`` after the fixed damage by ``crc32(conv_id:turn) % 20``."""
    space = F.lit(" ")
    d = conversations.select(
        conversation_key(F.col(conv_id)).alias("key"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        (F.crc32(F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"),
                          F.coalesce(F.col(turn).cast("string"), space))) % 20).alias("k"))
    return d.where("k <> 0").select(
        "key", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def conversation_key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _text_hash() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("th")


def faults(rows: DataFrame) -> DataFrame:
    """``(key, turn, role, th, row, fault, letter)`` for rows ``(key, turn, role, text)``; the first fault counts."""
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    slim = cut(rows.select(
        "key", "turn", "role", _text_hash(), F.monotonically_increasing_id().alias("row"),
        (~F.rlike("text", F.lit(WHITE_CLASS))).alias("blank"), (~end.isin(".", "!", "?")).alias("broken")), "conv-rows")
    # of equal (role, text) the first is found by an aggregate; its row id brings it back, no key is joined on itself
    first = slim.groupBy("key", "role", "th").agg(F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("first"))
    cls = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, F.lit(i + 1)) for i, c in enumerate(CLASSES[:3])], F.lit(4))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("broken"), "truncated")
    letter = F.when(fault.isNull(), F.substring(F.lit(LETTERS["sound"]), cls, F.lit(1))).when(
        fault == "truncated", F.substring(F.lit(LETTERS["broken"]), cls, F.lit(1))).otherwise(
        F.substring(F.lit(LETTERS["gone"]), cls, F.lit(1)))
    return slim.join(first, slim["row"] == first["first"], "left").select(
        "key", "turn", "role", "th", "row", fault.alias("fault"), letter.alias("letter"))


def _over(rows_of, schema: str):
    """A mapInArrow function that makes the rows of ``schema`` from each row (a dict)."""
    def run(batches):
        kind = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])
        for b in batches:
            out = [x for row in b.to_pylist() for x in rows_of(row)]
            yield pa.RecordBatch.from_pylist(out, schema=kind)
    return run


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _matrix(row):
    yield {"key": row["key"], "block": row["block"], "matrix": block_matrix(row["letters"])}


def _checkpoints(row):
    """Costs at the end of each block of a conversation, last block first."""
    v = LAST
    for part in sorted(row["parts"], key=lambda p: -p["block"]):
        yield {"key": row["key"], "block": part["block"], "ending": list(v)}
        m = part["matrix"]
        v = tuple(min(m[4 * s + t] + v[t] for t in STATES) for s in STATES)


def _walks(row):
    letters, end = row["letters"], tuple(row["ending"])
    starts = STATES if row["block"] else (START,)
    ways = [walk(letters, end, s, row["block"] + 1 == row["blocks"]) for s in starts]
    cls = "".join(map(CLASS_OF.__getitem__, letters))
    cost = end
    if not row["block"]:
        for x in reversed(letters):
            cost = before(x, cost)
    yield {"key": row["key"], "block": row["block"], "blocks": row["blocks"], "states": [w[0] for w in ways],
           "edits": [w[1] for w in ways], "cost": None if row["block"] else cost[START], "first": cls[0], "last": cls[-1],
           "illegal": sum(a + b not in LEGAL for a, b in zip(cls, cls[1:]))}


def _entered(row):
    """The state that each block of a conversation is entered in, and whether its seam is an illegal pair."""
    s, last = START, None
    for part in sorted(row["parts"], key=lambda p: p["block"]):
        yield {"key": row["key"], "block": part["block"], "entry": s, "seam": int(last is not None and last + part["first"] not in LEGAL)}
        s, last = part["states"][s if part["block"] else 0], part["last"]


def cheapest_edits(lettered: DataFrame) -> DataFrame:
    """``(key, block, edits, cost, illegal)`` from ``(key, turn, role, th, row, letter)``: the edits of each block in order;
    ``cost`` is the conversation's (in block 0, else null), ``illegal`` counts the pairs that end in the block."""
    placed = positions(lettered, ["key"], [F.col("turn"), F.col("role"), F.col("th"), F.col("row")], name="conv-order")
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("n")))
    placed = placed.select("key", "pos", "letter", F.floor(F.col("pos") / size).alias("block"), F.ceil(F.col("n") / size).alias("blocks"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    blocks = cut(placed.groupBy("key", "block").agg(F.first("blocks").alias("blocks"), letters.alias("letters")), "conv-blocks")
    long = blocks.where("blocks > 1")
    schema = "key string, block long, matrix array<long>"
    parts = long.mapInArrow(_over(_matrix, schema), schema).groupBy("key").agg(F.collect_list(F.struct("block", "matrix")).alias("parts"))
    schema = "key string, block long, ending array<long>"
    ends = parts.mapInArrow(_over(_checkpoints, schema), schema)
    known = blocks.join(ends, ["key", "block"], "left").select(
        "key", "block", "blocks", "letters", F.coalesce("ending", F.array(*map(F.lit, LAST)).cast("array<long>")).alias("ending"))
    schema = "key string, block long, blocks long, states array<int>, edits array<string>, cost long, first string, last string, illegal long"
    ways = cut(known.mapInArrow(_over(_walks, schema), schema), "conv-ways")
    parts = ways.where("blocks > 1").groupBy("key").agg(F.collect_list(F.struct("block", "states", "first", "last")).alias("parts"))
    schema = "key string, block long, entry int, seam long"
    entries = parts.mapInArrow(_over(_entered, schema), schema)
    at = F.when(F.col("block") == 0, 0).otherwise(F.col("entry"))
    return ways.join(entries, ["key", "block"], "left").select(
        "key", "block", F.get("edits", at).alias("edits"), "cost", (F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"))


ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


class _Repair:
    """One conversation's repaired rows, hashed as they come."""

    def __init__(self, key: str):
        self.key, self.edits, self.at, self.state, self.rows, self.sha = key, [], 0, START, 0, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def insert(self, edits: str) -> None:
        while edits[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = TURN[self.state]
            self.put(ROLE_OF[self.state], "")

    def take(self, role: str, text: str) -> None:
        edits = self.audit
        self.insert(edits)
        edit, self.at = edits[self.at], self.at + 1
        if edit == "K":
            self.state = _kept(role[0])[self.state]
            self.put(role, text)
        elif edit == "R":
            self.state = TURN[self.state]
            self.put(ROLE_OF[self.state], text)

    @property
    def audit(self) -> str:
        if len(self.edits) > 1:
            self.edits = ["".join(self.edits)]
        return self.edits[0] if self.edits else ""

    def done(self) -> dict:
        self.insert(self.audit)
        return {"key": self.key, "audit": self.audit, "repaired_sha256": self.sha.hexdigest()}


_REPAIRED = "key string, audit string, repaired_sha256 string"


def _stream(batches):
    """Rows sorted by conversation, its edits (by block) before its rows (by turn)."""
    kind = pa.schema([(c.split()[0], pa.string()) for c in _REPAIRED.split(", ")])
    now = None
    for b in batches:
        out = []
        for key, edits, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "edits", "role", "text")), strict=True):
            if now is None or now.key != key:
                if now:
                    out.append(now.done())
                now = _Repair(key)
            if edits is not None:
                now.edits.append(edits)
            else:
                now.take(role, text)
        yield pa.RecordBatch.from_pylist(out, schema=kind)
    if now:
        yield pa.RecordBatch.from_pylist([now.done()], schema=kind)


def repair_report(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", damage=damaged) -> DataFrame:
    """A row for each conversation: its gaps, faults and illegal pairs, and the cost, edits and digest of its repair.

    ``damage`` makes the rows ``(key, turn, role, text)`` to repair.
    """
    rows = damage(conversations, conv_id, turn, role, text)
    faulty = cut(faults(rows), "conv-faults")
    blocks = cut(cheapest_edits(faulty), "conv-edits")
    # the edits of a conversation and then its rows, in one sorted stream; texts are shuffled here alone
    no = F.lit(None)
    stream = blocks.select("key", F.lit(0).alias("what"), F.col("block").alias("turn"), no.cast("string").alias("role"),
                           no.cast("binary").alias("th"), no.cast("string").alias("text"), "edits").unionByName(
        rows.select("key", F.lit(1).alias("what"), F.col("turn").cast("bigint").alias("turn"), "role", _text_hash(), "text",
                    no.cast("string").alias("edits")))
    repaired = stream.repartition("key").sortWithinPartitions("key", "what", "turn", "role", "th").mapInArrow(_stream, _REPAIRED)
    turns = faulty.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    costs = blocks.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    given = conversations.groupBy(F.col(conv_id).alias("conv_id")).agg(F.lit(1).alias("one")).select(
        "conv_id", conversation_key(F.col("conv_id")).alias("key"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return given.join(counts, "key", "left").join(costs, "key", "left").join(repaired, "key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
