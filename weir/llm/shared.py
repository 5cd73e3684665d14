"""Helpers that the operators share: tables, slices of bounded size, what workers hold; scratch tables of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weir.plans.scratch import BROADCAST_ROWS, scratch_path, small_or_not, written

__all__ = ["BROADCAST_ROWS", "held", "release", "scratch_path", "slices", "small_or_not", "table", "union_all", "unused", "written"]

#: Bytes of text that a task works on at once, or one text.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def slices(batches: Iterable[pa.RecordBatch], by: str | int, rows: int = 1024, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into shorter ones of at most ``rows`` rows and ``most`` bytes in the text column ``by``, or one row.

    What a task makes of one so stays small, however long texts are.
    """
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(by)).fill_null(0).to_pylist()):
            if i > start and (i - start >= rows or held + size > most):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, held by a Python worker for its next tasks; one thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Workers are used again by later operators: let go of what an earlier one holds."""
    _HELD.clear()
