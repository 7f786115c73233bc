"""Arrow batches whose ids and foreign columns pass through Python untouched.

Pandas turns a long column that holds a null into doubles, which changes ids above 2**53;
here only the columns made in Python are converted, and all others keep their buffers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of a batch that are worked on at a time.
SLICE = 1024


def fields(ddl: str) -> StructType:
    return StructType.fromDDL(ddl) if ddl else StructType([])


def batch(columns: dict[str, object], schema: StructType) -> pa.RecordBatch:
    """Lists, numpy arrays or Arrow arrays by name, as one batch of ``schema``'s columns."""
    arrays = []
    for f in schema:
        v, kind = columns[f.name], to_arrow_type(f.dataType)
        if not isinstance(v, pa.Array):
            v = pa.array(v, type=kind)
        arrays.append(v if v.type == kind else v.cast(kind))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy arrays."""
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, type=kind))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def extend(df: DataFrame, inputs: list[str], make: Callable[..., dict], made: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row of ``df`` as they are, then those of the DDL ``made``.

    ``make`` gets a list for each of ``inputs`` and gives a sequence for each column of
    ``made``.  The value ``__keep``, if given, says which rows stay.
    """
    new = fields(made)

    def run(batches):
        for b in slices(batches):
            out = make(*[b.column(c).to_pylist() for c in inputs])
            stay = out.pop("__keep", None)
            own = batch(out, new)
            whole = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *own.columns], names=[*keep, *new.names])
            yield whole if stay is None else whole.filter(pa.array(stay, pa.bool_()))

    return df.mapInArrow(run, StructType([df.schema[c] for c in keep] + new.fields))
