"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word, and the pattern of a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN, BLANK_PATTERN = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def quoted(pattern: str) -> str:
    """A SQL string literal of the pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Bytes of strings in a slice, unless one row alone has more.
SLICE_BYTES = 4 << 20
OFFSETS = {"string": np.int32, "binary": np.int32, "large_string": np.int64, "large_binary": np.int64}


def slices(batch: pa.RecordBatch, rows: int, size: int = SLICE_BYTES):
    """The batch in slices of at most `rows` rows and `size` bytes of strings (one row at least)."""
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = OFFSETS.get(str(column.type))
        if kind and batch.num_rows:  # from the offsets alone: the compute kernels would cost every worker memory
            held += np.diff(np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + batch.num_rows + 1])
    ends, start = np.cumsum(held), 0
    while start < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        stop = min(start + rows, max(start + 1, most), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def arrow_map(df: DataFrame, columns: Sequence[str | Column], schema: str, per_slice: Callable, rows: int = 512) -> DataFrame:
    """mapInArrow over `columns` only, in slices of bounded rows and bytes so that Python
    holds a bounded part of the texts and results at once, or one very long text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows):
                yield per_slice(part)

    return df.select(*columns).mapInArrow(run, schema)


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null counts as 0. Every word is one run of non-blanks,
    so the words are the places where such a run begins."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


class Memory(dict):
    """Results of `make` by key, bounded to two generations of `limit` entries: a full
    generation becomes the old one, whose entries move back when they are asked for."""

    def __init__(self, make: Callable, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
