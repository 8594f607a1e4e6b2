"""Ordered fold: the one mechanism for rules whose next step depends on their own past.

Spark partitions and sorts the rows; each task then walks its sorted rows in Arrow batches and
carries the state of the current key from batch to batch.  A key is never collected: memory is one
batch plus the state, no matter how long the key's history is.  Parallelism is the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Folder(Protocol):
    """State machine of one key.  Both methods give output tuples *without* the key columns."""

    def row(self, r: Any) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Folder],
    emits: str | T.StructType,
) -> DataFrame:
    """Feed each key's rows, in ``order``, to a fresh ``start()``; collect what it emits.

    ``order`` must be total within a key.  The output holds the key columns followed by ``emits``.
    """
    keys, order = list(keys), list(order)
    emits = T.StructType.fromDDL(emits) if isinstance(emits, str) else emits
    schema = T.StructType([df.schema[k] for k in keys] + list(emits.fields))
    names = schema.fieldNames()
    n_keys = len(keys)
    nullable_ints = {
        f.name: "Int64" for f in schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType))
    }
    columns = keys + [c for c in df.columns if c not in keys]
    makes = start

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        state: Folder | None = None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name="Row"):
                k = r[:n_keys]
                if k != key:
                    if state is not None:
                        out.extend(key + o for o in state.end())
                    key, state = k, makes()
                out.extend(k + o for o in state.row(r))
            if out:
                yield _frame(out, names, nullable_ints)
        if state is not None:
            out = [key + o for o in state.end()]
            if out:
                yield _frame(out, names, nullable_ints)

    return (
        df.select(*columns)
        .repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(run, schema)
    )


def _frame(rows: list[tuple], names: list[str], ints: dict[str, str]) -> pd.DataFrame:
    frame = pd.DataFrame.from_records(rows, columns=names)
    return frame.astype(ints) if ints else frame
