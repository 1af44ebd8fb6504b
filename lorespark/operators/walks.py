"""Rows of a key walked in order with a small state: what a window can't say and a fold over one array does in quadratic time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def walk(rows: DataFrame, by: list[str], order: list[str], reads: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]], shape: str) -> DataFrame:
    """rows with the columns of shape, those left out for which step gives None.

    step takes a key's state, start() before its first row, and the values of
    ``reads``; it returns the next state and the new columns' values. Rows are
    shuffled by key and sorted by ``order``; a task holds a batch of them and
    one state, so a key may have any number. Null keys form one key.
    """
    fresh = rows.sparkSession.createDataFrame([], shape).schema if shape else StructType()
    arrow = to_arrow_schema(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys = zip(*[batch[c].to_pylist() for c in by], strict=True)
            keep, told = [], []
            for k, values in zip(keys, zip(*[batch[c].to_pylist() for c in reads], strict=True), strict=True):
                if key is None or k != key:
                    key, state = k, start()
                state, out = step(state, values)
                keep.append(out is not None)
                if out is not None:
                    told.append(out)
            if told:
                left = batch.filter(pa.array(keep))
                cols = [pa.array([x[i] for x in told], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*left.columns, *cols], names=[*left.schema.names, *arrow.names])

    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *fresh.fields]))


def fold(rows: DataFrame, by: list[str], order: list[str], reads: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], end: Callable[[object], tuple], shape: str) -> DataFrame:
    """A row for each key: by and the columns of shape, what end() tells of the state after the key's last row.

    As in walk(), step takes a key's state and the values of ``reads``; it
    returns the next state, which may be the same object. A task holds a batch
    of rows and one state.
    """
    fresh = rows.sparkSession.createDataFrame([], shape).schema
    kept = rows.select(*dict.fromkeys([*by, *order, *reads]))
    out = StructType([*[kept.schema[c] for c in by], *fresh.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, *end(state)), arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys = zip(*[batch[c].to_pylist() for c in by], strict=True)
            for k, values in zip(keys, zip(*[batch[c].to_pylist() for c in reads], strict=True), strict=True):
                if key is None or k != key:
                    if key is not None:
                        yield told()
                    key, state = k, start()
                state = step(state, values)
        if key is not None:
            yield told()

    return kept.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)


def each_text(rows: DataFrame, keep: list[str], text: str, tell: Callable[[str], list[tuple]], shape: str) -> DataFrame:
    """keep and the columns of shape: a row for each tuple that tell() gives of a text (null: empty)."""
    fresh = rows.sparkSession.createDataFrame([], shape).schema
    arrow = to_arrow_schema(fresh)
    kept = rows.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                told = [tell(t or "") for t in part[text].to_pylist()]
                at = pa.array([i for i, x in enumerate(told) for _ in x], pa.int64())
                flat = [r for x in told for r in x]
                if flat:
                    left = part.select(keep).take(at)
                    cols = [pa.array([r[i] for r in flat], f.type) for i, f in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays([*left.columns, *cols], names=[*left.schema.names, *arrow.names])

    return kept.mapInArrow(run, StructType([*[kept.schema[c] for c in keep], *fresh.fields]))
