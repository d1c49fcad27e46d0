"""Cutting text into pieces with character offsets.

Spark splits text on the JVM, but has no running sum inside an array: the
offsets would cost quadratic work per text or a shuffle of every piece.  Here
Arrow kernels do both in one pass over the column batches; nothing runs per
row in Python and no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROWS_PER_SLICE = 256


def _cut(column: pa.Array, blanks: str, sep: str):
    """(parent row, index in row, start, piece) of every piece of a string column."""
    if blanks:
        column = pc.replace_substring_regex(column, pattern=f"[{blanks}]", replacement=sep)
    lists = pc.split_pattern(column, pattern=sep)
    pieces = pc.list_flatten(lists)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    widths = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + len(sep)
    before = np.cumsum(widths) - widths
    first = np.cumsum(counts) - counts
    parent = np.repeat(np.arange(len(counts)), counts)
    head = first[parent]
    return parent, np.arange(len(before)) - head, before - before[head], pieces


def split_with_offsets(df: DataFrame, text: str, keep: Sequence[str], sep: str, blanks: str = "",
                       index: str | None = None, start: str = "start", piece: str = "piece",
                       skip_empty: bool = False) -> DataFrame:
    """One row per piece between ``sep``; ``blanks`` are characters that count as ``sep`` too.

    ``index`` names an optional column with the piece's place in its text.
    """
    schema = T.StructType([df.schema[k] for k in keep])
    if index:
        schema = schema.add(index, T.IntegerType())
    schema = schema.add(start, T.LongType()).add(piece, T.StringType())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = batch.slice(at, ROWS_PER_SLICE)
                parent, place, begin, pieces = _cut(part.column(len(keep)), blanks, sep)
                rows = pa.array(parent)
                columns = [part.column(i).take(rows) for i in range(len(keep))]
                if index:
                    columns.append(pa.array(place.astype(np.int32)))
                out = pa.RecordBatch.from_arrays([*columns, pa.array(begin), pieces], names=names)
                yield out.filter(pc.not_equal(pieces, "")) if skip_empty else out

    return df.select(*keep, text).mapInArrow(run, schema)
