"""Streamed groups, beside the library's own DataFrame helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..frames import components, forget, fresh, written

__all__ = ["components", "forget", "fresh", "in_groups", "written"]


def in_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, by: list[str] | None = None) -> DataFrame:
    """fn over each group of equal keys, as one streamed pass per partition.

    Groups must be small by construction; a task holds one group at a time.
    by: keys of the exchange, if fewer than those of the groups.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names]
            ids = list(zip(*cols, strict=True))
            a = 0
            for i in range(len(ids)):
                if ids[i] != last:
                    if i > a:
                        held.append(batch.slice(a, i - a))
                    if held:
                        yield from fn(pa.Table.from_batches(held))
                    held, a, last = [], i, ids[i]
            held.append(batch.slice(a))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(*(by or names)).sortWithinPartitions(*names).mapInArrow(run, schema)
