"""A function over the ordered rows of each key, for many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def by_group(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], f: Callable, added: str) -> DataFrame:
    """rows with the columns of added (a schema): f takes a list of each input over one group and returns a list of each new column.

    Rows are partitioned by keys, sorted by keys and order, and streamed as
    Arrow batches, so a task holds one batch and the group that is open at its
    end. Rows that tie in order come as they may. Null keys are one group.
    """
    fields = T._parse_datatype_string(added).fields
    schema = T.StructType([*rows.schema.fields, *fields])

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        marks = list(zip(*(t.column(k).to_pylist() for k in keys), strict=True))
        cols, new, at = [t.column(c).to_pylist() for c in inputs], [[] for _ in fields], 0
        for _, g in groupby(marks):
            end = at + sum(1 for _ in g)
            for out, part in zip(new, f(*(c[at:end] for c in cols)), strict=True):
                out.extend(part)
            at = end
        for field, values in zip(fields, new, strict=True):
            t = t.append_column(field.name, pa.array(values, {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[field.dataType.simpleString()]))
        yield from t.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            marks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            start = b.num_rows - 1
            while start and marks[start - 1] == marks[-1]:
                start -= 1
            if held and not start and tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys) == marks[0]:
                held.append(b)
                continue
            if start:
                held.append(b.slice(0, start))
            if held:
                yield from done(held)
            held = [b.slice(start)]
        if held:
            yield from done(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
