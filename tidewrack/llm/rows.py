"""Rows of any columns: an operator sees those it needs, the others travel in one struct, so no names can clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHERS = "others_"
#: Rows of an Arrow batch whose texts a Python function holds at once.
SLICE = 1024


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most so many rows; what Arrow keeps in reserve is given back at the end."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), most):
            yield batch.slice(at, most)
    pa.default_memory_pool().release_unused()


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` as the columns ``own`` and a struct OTHERS of all others, and what turns such rows into the input's columns
    again, in their order and with further columns after them. Columns of ``own`` that ``docs`` lacks are null."""
    there = set(docs.columns)
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in own}
    packed = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(name) for c, name in rest.items()]).alias(OTHERS)

    def restored(rows: DataFrame, *more: Column | str) -> DataFrame:
        return rows.select(*[F.col(OTHERS)[rest[c]].alias(c) if c in rest else F.col(c) for c in docs.columns], *more)

    return docs.select(*[F.col(c) if c in there else F.lit(None).alias(c) for c in own], packed), restored
