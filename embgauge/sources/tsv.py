"""Quoted tab-separated files, read in blocks: a file of any size is as many tasks as it has blocks.

A quoted value may hold line ends, so a block alone does not know whether it begins inside a value. One scan says for
both cases where a block ends and how many records begin in it: a row per block. Put together in file order these rows
give every block its true state and the number of its first record, and a second scan cuts the records out. Only records
that cross a block border are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from embgauge.functions import kernels
from embgauge.session import keep

FORMAT = {"sep": "\t", "quote": '"', "escape": '"'}

_REST = r'(?:[^"]++|"")*+'
#: A field that opens with a quote and is still open at the end of the line, after any closed fields.
_OPENS = re.compile(rf'(?:(?:"{_REST}"[^\t]*+|[^"\t][^\t]*+|)\t)*+"{_REST}\Z')
#: What is left of a quoted value, its closing quote, and what follows up to the next field.
_CLOSES = re.compile(rf'{_REST}"[^\t]*+\t?')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line lies in a quoted value, given whether its start does.

    A quote opens a value only as the first character of a field; doubled, it is part of the value. A value that goes on
    after its closing quote lasts up to the next tab or line end.
    """
    if inside:
        close = _CLOSES.match(line)
        if close is None:
            return True
        line = line[close.end() :]
    return _OPENS.match(line) is not None


def _line_states(lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line starts outside quoted values, and the state after the last one."""
    outside = np.ones(len(lines), dtype=bool)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    at = 0
    for place, text in zip(quoted.tolist(), lines.take(pa.array(quoted)).to_pylist()):
        if inside:
            outside[at : place + 1] = False
        inside = ends_inside(text, inside)
        at = place + 1
    if inside:
        outside[at:] = False
    return outside, inside


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array(["", "\r"], lines.type)).to_numpy(zero_copy_only=False)


def _block_runs(batches, keys: int):
    """``(key values, lines)`` per run of rows of one block; the lines are the last column. The first two keys are the
    file and the block's start."""
    for batch in batches:
        if not len(batch):
            continue
        paths = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(paths) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
            yield tuple(batch.column(k)[a].as_py() for k in range(keys)), batch.column(keys).slice(a, b - a)


def _survey(batches):
    """Per block: the state at its end and the records begun in it, if it starts outside and if it starts inside."""
    found, current = [], None
    for key, lines in _block_runs(batches, 2):
        if key != current:
            current = key
            found.append([*key, False, 0, True, 0])
        filled = ~_blank(lines)
        row = found[-1]
        for at in (2, 4):
            outside, row[at] = _line_states(lines, row[at])
            row[at + 1] += int((outside & filled).sum())
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=_SURVEY_NAMES)


_SURVEY_NAMES = ["path", "start", "out_end", "out_begun", "in_end", "in_begun"]
_SURVEY = "path string, start long, out_end boolean, out_begun long, in_end boolean, in_begun long"


def _settle(file):
    """The blocks of one file, in order: the state at the start of each and the records begun before it."""
    file = file.sort_values("start", ignore_index=True)
    inside, before, rows = False, 0, []
    for b in file.itertuples():
        end, begun = (b.in_end, b.in_begun) if inside else (b.out_end, b.out_begun)
        rows.append((inside, bool(end), before, begun))
        inside, before = bool(end), before + int(begun)
    for name, values in zip(("inside", "ends_inside", "before", "begun"), zip(*rows)):
        file[name] = values
    return file[["path", "start", "inside", "ends_inside", "before", "begun"]]


def _cut(batches):
    """Records of each block as ``(first, n, start, whole, text)``: ``n`` counts the file's records from its header, 0. A
    record that crosses the block's border is not whole, here are its lines of this block."""
    state = None
    held: list[str] = []

    def finish():
        if held:
            key, n, whole, inside = state
            whole = whole and not inside
            yield _records(key, [n], [whole], pa.array(["\n".join(held)], pa.string()))
            held.clear()

    for key, lines in _block_runs(batches, 5):
        if state is None or state[0] != key:
            yield from finish()
            _, _, inside, before, _ = key
            state = (key, before - 1, False, inside)
        _, n, whole, inside = state
        outside, inside = _line_states(lines, inside)
        blank = _blank(lines)
        used = ~(outside & blank)
        lines = lines.filter(pa.array(used))
        begins = np.flatnonzero(outside[used])
        first = int(begins[0]) if len(begins) else len(lines)
        held.extend(lines.slice(0, first).to_pylist())
        if len(begins):
            state = (key, n, whole, False)
            yield from finish()
            last = int(begins[-1])
            if len(begins) > 1:
                cuts = pa.array((begins - first).astype(np.int32))
                several = pa.ListArray.from_arrays(cuts, lines.slice(first, last - first))
                count = len(begins) - 1
                yield _records(key, range(n + 1, n + 1 + count), [True] * count, pc.binary_join(several, "\n"))
            held.extend(lines.slice(last).to_pylist())
            n, whole = n + len(begins), True
        state = (key, n, whole, inside)
    yield from finish()


def _records(key: tuple, n, whole: list, texts: pa.Array) -> pa.RecordBatch:
    _, start, _, _, first = key
    count = len(texts)
    columns = [pa.array([first] * count, pa.int64()), pa.array(list(n), pa.int64()), pa.array([start] * count, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(whole), texts], names=["first", "n", "start", "whole", "text"])


_RECORDS = "first long, n long, start long, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.input_file_name().alias("path"), F.input_file_block_start().alias("start"), "value")


def read_records(spark: SparkSession, path: str, schema: str, row_id: str, first_id: int = 0) -> tuple[DataFrame, int]:
    """``(row_id, <schema columns>)`` of a file or folder of files with a header each, and the number of its rows.

    Rows are numbered from ``first_id`` by file name and position. Records end with a line feed, or a carriage return and
    a line feed; blank lines outside values are no records. A record that does not fit the schema is an error. Files
    without lines or with a header only have no rows. Blocks are as large as ``spark.sql.files.maxPartitionBytes`` says.
    The table of blocks is cached (a surrounding ``cache_scope`` releases it) and broadcast if its bytes allow.
    """
    lines = _lines(spark, path)
    settled = "path string, start long, inside boolean, ends_inside boolean, before long, begun long"
    blocks = keep(lines.mapInArrow(_survey, _SURVEY).groupBy("path").applyInPandas(_settle, settled))
    files = blocks.groupBy("path").agg(F.greatest(F.sum("begun") - 1, F.lit(0)).alias("rows"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    size = blocks.agg(F.sum(F.octet_length("path") + 40).alias("bytes"), F.max(F.col("inside") | F.col("ends_inside")).alias("crossed")).first()
    total = files.agg(F.sum("rows")).first()[0] or 0

    placed = blocks.join(files, "path")
    if (size["bytes"] or 0) <= kernels.MAX_BROADCAST_BYTES:
        cut = lambda some: lines.join(F.broadcast(some), ["path", "start"])
    else:
        # A join by block keeps the lines of a block together, but not in order.
        numbered = lines.withColumn("_line", F.monotonically_increasing_id())
        cut = lambda some: numbered.join(some, ["path", "start"]).sortWithinPartitions("path", "start", "_line")
    wanted = ["path", "start", "inside", "before", "first", "value"]
    whole = cut(placed).select(*wanted).mapInArrow(_cut, _RECORDS).where(F.col("whole"))
    records = whole.select("first", "n", "text")
    if size["crossed"]:
        open_blocks = placed.where(F.col("inside") | F.col("ends_inside"))
        pieces = cut(open_blocks).select(*wanted).mapInArrow(_cut, _RECORDS).where(~F.col("whole"))
        in_order = F.sort_array(F.collect_list(F.struct("start", "text")))
        joined = pieces.groupBy("first", "n").agg(F.array_join(in_order["text"], "\n").alias("text"))
        records = records.unionByName(joined)
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    options = {**FORMAT, "multiLine": "true", "lineSep": "\n", "mode": "FAILFAST"}
    rows = records.where(F.col("n") > 0).select(
        (F.col("first") + F.col("n") - 1 + first_id).alias(row_id), F.from_csv(text, schema, options).alias("_row")
    )
    return rows.select(row_id, "_row.*"), total
