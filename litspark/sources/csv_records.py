"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks per file.

Spark splits such a file only where it is told that no record spans lines. Here physical lines are read, which any
split allows, and what a line does is a function of one bit: whether it starts inside quotes. A first pass composes
that function over each block of lines; a running composition over the blocks of a file says for each block whether it starts
inside quotes. In the second pass each block puts its lines together into records. Only the piece of a record that
a block leaves open, and the pieces that following blocks add to it, travel to be put together.

``from_csv`` then parses each record, as the CSV reader would. Cells are separated by commas, quotes are doubled inside
quotes, records end with \\n or \\r\\n.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.sources.staging import stage

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, given whether its start is."""
    at = 0
    if not inside:
        if not line.startswith(b'"'):
            at = line.find(b',"')  # a quote within an unquoted cell means nothing
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == b'"':
            at += 2
            continue
        at = line.find(b',"', at + 1)
        if at < 0:
            return False
        at += 2


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((file, block), lines): the lines of each batch, cut where another block begins; a block comes in one or more parts."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        lines, at = batch.column("line").to_pylist(), 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or blocks[k] != blocks[at] or files[k] != files[at]:
                yield (files[at], blocks[at]), lines[at:k]
                at = k


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block makes of a start outside and of a start inside quotes, and whether its first line ends with \\r."""
    found: dict[tuple[str, int], list[bool]] = {}
    for key, lines in _by_block(batches):
        state = found.setdefault(key, [False, True, lines[0].endswith(b"\r")])
        for line in lines:
            if b'"' not in line:
                continue
            if state[0] == state[1]:
                state[0] = state[1] = inside_after(line, state[0])
            else:
                state[:2] = [inside_after(line, s) for s in state[:2]]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield _batch([(f, b, *s) for (f, b), s in found.items()], kinds, ["file", "block", "outside", "inside", "crlf"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def block_states(lines: DataFrame) -> tuple[frozenset[tuple[str, int]], frozenset[str]]:
    """The blocks (file, block) that start inside quotes, and the files whose lines end with \\r\\n.

    One row per block is gathered by file; what reaches the driver is part of the list of blocks it plans reads with.
    """
    effects = lines.mapInArrow(_effects, "file string, block bigint, outside boolean, inside boolean, crlf boolean")
    per_file = effects.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "outside", "inside", "crlf"))).alias("blocks"))
    start = F.struct(F.lit(False).alias("state"), F.array().cast("array<bigint>").alias("found"))

    def step(acc, block):
        found = F.when(acc["state"], F.concat(acc["found"], F.array(block["block"]))).otherwise(acc["found"])
        return F.struct(F.when(acc["state"], block["inside"]).otherwise(block["outside"]).alias("state"), found.alias("found"))

    inside = F.aggregate("blocks", start, step, lambda acc: acc["found"])
    rows = per_file.select("file", inside.alias("inside"), F.col("blocks")[0]["crlf"].alias("crlf"))
    rows = rows.filter(F.col("crlf") | (F.size("inside") > 0)).collect()
    return frozenset((r.file, b) for r in rows for b in r.inside), frozenset(r.file for r in rows if r.crlf)


def _assembled(inside: frozenset[tuple[str, int]], crlf: frozenset[str]):
    """(file, block, line, piece, text): records, and pieces of records that other blocks share.

    ``line`` numbers the records of a block, 0 being the file's first, or what an earlier block began; ``piece`` says
    open, middle or end of a shared record, null a whole one.
    """
    names = ["file", "block", "line", "piece", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, ahead, number = ("", -1), False, False, 0
        record: list[bytes] = []
        rows: list[tuple] = []

        def put(piece: str | None) -> None:
            rows.append((*key, number, piece, b"\n".join(record).decode(errors="replace")))

        for at, lines in _by_block(batches):
            if at != key:
                if record:
                    put("middle" if ahead else "open")
                    record.clear()
                key = at
                state = ahead = at in inside
                number = 0 if ahead or not at[1] else 1
                if not at[1]:
                    lines[0] = lines[0].removeprefix(b"\xef\xbb\xbf")
            returns = at[0] in crlf
            for line in lines:
                record.append(line[:-1] if returns and line.endswith(b"\r") else line)
                if b'"' in line:
                    state = inside_after(line, state)
                if state:
                    continue
                if ahead or record != [b""]:  # blank lines between records are none
                    put("end" if ahead else None)
                    number += 1
                record.clear()
                ahead = False
            if len(rows) > 1000:
                yield _batch(rows, kinds, names)
                rows.clear()
        if record:
            put("middle" if ahead else "open")
        yield _batch(rows, kinds, names)

    return run


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, text) of every record, headers (block 0, line 0) included; file, block and line give the order.

    A record that nothing closes ends with its file.
    """
    lines = _lines(spark, path)
    inside, crlf = block_states(lines)
    found = lines.mapInArrow(_assembled(inside, crlf), "file string, block bigint, line bigint, piece string, text string")
    whole = found.filter(F.col("piece").isNull()).select("file", "block", "line", "text")
    pieces = stage(found.filter(F.col("piece").isNotNull()))  # at most two of a block
    order = Window.partitionBy("file").orderBy("block", "line")
    chain = pieces.withColumn("chain", F.sum((F.col("piece") == "open").cast("int")).over(order))
    joined = chain.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return whole.unionByName(joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"), text.alias("text")))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file under a path."""
    return spark.read.option("header", True).option("multiLine", True).options(**OPTIONS).csv(path).columns


def first_bytes(spark: SparkSession, path: str, n: int = 1 << 16) -> bytes:
    """The start of one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def header_cells(start: bytes) -> list[str]:
    """Column names in the first record of a file, none where it does not end in the bytes given."""
    record, inside = [], False
    lines = start.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    for line in lines:
        record.append(line.removesuffix(b"\r"))
        inside = inside_after(line, inside)
        if not inside and record != [b""]:
            return next(csv.reader(["\n".join(x.decode(errors="replace") for x in record)]), [])
        if not inside:
            record.clear()
    return []


def read_csv_records(spark: SparkSession, path: str | list[str], header: list[str] | None = None) -> DataFrame:
    """(file, block, line, cells): the records of all files under a path, ``cells`` a struct of the header's columns, all texts.

    The header is the first file's unless given; the read fails where a file has another.
    """
    header = header or header_of(spark, path)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    found = records(spark, path).withColumn("cells", F.from_csv("text", schema, OPTIONS))
    is_header = (F.col("block") == 0) & (F.col("line") == 0)
    named = F.array(*[F.col("cells")[c] for c in header]) == F.array(*[F.lit(c) for c in header])
    other = F.raise_error(F.concat(F.col("file"), F.lit(f": not the header {header}, but "), F.col("text"))).cast("boolean")
    kept = F.when(~is_header, True).when(F.coalesce(named, F.lit(False)), False).otherwise(other)
    return found.filter(kept).select("file", "block", "line", "cells")
