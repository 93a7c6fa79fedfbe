"""CSV records from byte ranges: a file is read by as many tasks as it has splits.

A quoted field may hold line breaks, so whether a line begins a record depends on everything before it in its
file - but only through one bit: inside quotes or not.

1. Every split reports, for either bit at its beginning, the bit at its end and the number of records that begin in it.
2. Following the bits along each file, and adding up the counts over all splits in file order, gives each split's
   true first bit and the number of its first record. This table has a row for each input split.
3. The splits are read again and cut into records, numbered in file order. A record that crosses splits comes out as
   pieces, at most two for a split and the only rows that are shuffled, and is put together again.

A quote opens a field only at the field's beginning; inside, two quotes are one. Fields are then parsed by Spark's own
``from_csv``. Blank lines are no records to the parser and are dropped; numbers follow the files' paths and their bytes,
headers and blank lines included.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from ..session import cut_lineage

C = F.col
#: From inside a quoted field up to its closing quote (possessive: a doubled quote is never split).
TO_CLOSING = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes (or at a record's beginning) ends inside quotes."""
    if '"' not in line:
        return inside
    at = 0
    if not inside:
        if line[0] != '"':
            at = line.find(',"') + 1
            if not at:
                return False
        at += 1
    while True:
        closing = TO_CLOSING.match(line, at)
        if not closing:
            return True
        at = line.find(',"', closing.end())
        if at < 0:
            return False
        at += 2


def _lines(batches):
    """``(place, line)`` for each line; ``place`` are the other columns."""
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        value = cols.pop("value")
        yield from zip(zip(*cols.values(), strict=True), value, strict=True)


def _summaries(batches):
    """For each split the bit at its end and the records that begin in it, for either bit at its beginning."""
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), *((c, pa.int64()) for c in ("end0", "end1", "n0", "n1"))])
    out, now, ends, n = [], None, [0, 0], [0, 0]

    def closed():
        return {"file": now[0], "block": now[1], "end0": ends[0], "end1": ends[1], "n0": n[0], "n1": n[1]}

    for place, line in _lines(batches):
        if place != now:
            if now:
                out.append(closed())
            now, ends, n = place, [0, 1], [0, 0]
        for s in (0, 1):
            n[s] += not ends[s]
        if '"' in line:
            ends = [int(ends_inside(line, bool(e))) for e in ends]
    if now:
        out.append(closed())
    yield pa.RecordBatch.from_pylist(out, schema=kind)


def _followed(splits: pd.DataFrame) -> pd.DataFrame:
    """The true first bit and number of records of each split of a file."""
    splits, bit, rows = splits.sort_values("block"), 0, []
    for r in splits.itertuples():
        rows.append((r.file, r.block, bit, r.n1 if bit else r.n0))
        bit = r.end1 if bit else r.end0
    return pd.DataFrame(rows, columns=["file", "block", "inside", "records"])


_CUT = "number long, block long, whole boolean, header boolean, value string"


def _cut(batches):
    """Records of each split, and the pieces of those that it holds in part."""
    kind = pa.schema([("number", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("header", pa.bool_()), ("value", pa.string())])
    now, held, number, whole, header, inside = None, [], 0, True, False, False
    out, size = [], 0

    def piece(ended: bool):
        return {"number": number, "block": now[0], "whole": whole and ended, "header": header, "value": "\n".join(held)}

    for place, line in _lines(batches):
        if place != now:
            if held:
                out.append(piece(not inside))
            now, held = place, []
            _, inside, first = place
            # what comes before the first record of the split belongs to the last record before it
            number, whole, header, inside = first - 1, False, False, bool(inside)
            fresh = place[0] == 0
        if not inside:
            if held:
                out.append(piece(True))
            held, number, whole, header, fresh = [], number + 1, True, fresh, False
        held.append(line)
        inside = ends_inside(line, inside)
        size += len(line)
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(out, schema=kind)
            out, size = [], 0
    if held:
        out.append(piece(not inside))
    yield pa.RecordBatch.from_pylist(out, schema=kind)


def lines_of(reader) -> DataFrame:
    """``(value, file, block)`` of a text reader (batch or stream), for its lines in order."""
    def read(path: str) -> DataFrame:
        return reader.option("lineSep", "\n").text(path).select(
            "value", C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"))
    return read


def records_of(lines: DataFrame, header: bool = True) -> DataFrame:
    """``(number, value)``: the records of ``lines``, numbered in file order, without the files' first ones."""
    splits = cut_lineage(lines.select("file", "block", "value").mapInArrow(
        _summaries, "file string, block long, end0 long, end1 long, n0 long, n1 long"), "splits")
    followed = splits.groupBy("file").applyInPandas(_followed, "file string, block long, inside long, records long")
    numbered = cut_lineage(running_sums(followed, [], [C("file"), C("block")], {"first": "records"}, name="split-order").select(
        C("file").alias("of"), C("block").alias("at"), "inside", "first"), "split-numbers")
    # a row for each input split, of which the driver keeps a list anyway; the lines stay in order
    placed = lines.join(F.broadcast(numbered), (C("file") == C("of")) & (C("block") == C("at"))).select("block", "inside", "first", "value")
    pieces = placed.mapInArrow(_cut, _CUT)
    joined = pieces.where("not whole").groupBy("number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "\n").alias("value"),
        F.bool_or("header").alias("header"))
    out = pieces.where("whole").select("number", "value", "header").unionByName(joined)
    out = out.withColumn("value", F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, char_length(value) - 1)")).otherwise(C("value")))
    return out.where(F.length("value") > 0).where(~C("header") if header else F.lit(True)).select("number", "value")


def parsed(records: DataFrame, columns: list[str], number: str) -> DataFrame:
    """``records`` as all-string ``columns``, and their numbers as ``number``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    row = F.from_csv(C("value"), F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(C("number").alias(number), row.alias("__row")).select(number, *[C("__row")[c].alias(c) for c in columns])


def read_records(spark: SparkSession, path: str, columns: list[str], number: str = "number") -> DataFrame:
    return parsed(records_of(lines_of(spark.read)(path)), columns, number)
