"""Folds of a key's rows in order, with the state of one key in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {
    "string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
}
#: Result rows of an Arrow batch, at most.
ROWS = 10_000


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], object], step: Callable[[object, dict], Iterable[dict]], finish: Callable[[object], Iterable[dict]], schema: dict[str, str]) -> DataFrame:
    """The result rows of a fold over each key's rows in ``order``.

    ``start`` makes a key's state of its first row, ``step`` takes every row, the first included, and ``finish`` comes after the
    last; the latter two give result rows (``schema``: name to kind). Rows are dealt out and sorted by key and passed on
    batch by batch, so a task holds one state and one batch, however many rows a key has. Rows alike in ``order`` come in
    any order.
    """
    kinds = pa.schema([(c, KINDS[k]) for c, k in schema.items()])

    def run(batches):
        key, state, out = None, None, []

        def give():
            batch = pa.RecordBatch.from_pylist(out, kinds)
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    if key is not None:
                        out.extend(finish(state))
                    key, state = own, start(row)
                out.extend(step(state, row))
                if len(out) >= ROWS:
                    yield give()
        if key is not None:
            out.extend(finish(state))
        yield give()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in schema.items()))
