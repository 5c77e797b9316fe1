"""The nearest earlier row with a smaller value, by a monotonic stack, linear in the rows.

Rows are dealt to ranges of (keys, order), so one key may fill many tasks. Each
range keeps its stack: a row finds its answer there, or is smaller than all
before it in its range. Such rows go to the nearest range before whose least
value is smaller, which a list with one entry a range tells, and search what
that range's stack holds at its end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

FOUND, OPEN, STACK = 0, 1, 2


def nearest_smaller(rows: DataFrame, keys: list[str], order: str, value: str, name: str, result: str, equal: bool = False, later: bool = False) -> DataFrame:
    """rows with result: name of the nearest earlier row of the same keys whose value is smaller (equal: or as great), null where none is.

    later looks forward instead. order should tell rows of a key apart. A row
    without a value has no result and is none; null keys are one key. A task
    holds its range's stack: as many entries as its longest run of rising
    values left open, never the key. An empty table gives no rows.
    """
    key = F.col(order).desc() if later else F.col(order).asc()
    placed = rows.repartitionByRange(*keys, key).sortWithinPartitions(*keys, key).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*placed.schema.fields, T.StructField(result, rows.schema[name].dataType), T.StructField("_at", T.LongType()), T.StructField("_kind", T.IntegerType())])
    past, fields = bisect_right if equal else bisect_left, [f.name for f in placed.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, values, names, first, last, types = None, [], [], True, None, None
        for b in batches:
            if not b.num_rows:
                continue
            types = types or [f.type for f in b.schema]
            marks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            found, kinds = [], []
            for m, v, n in zip(marks, b.column(value).to_pylist(), b.column(name).to_pylist(), strict=True):
                if m != mark:
                    first = mark is None
                    mark, values, names = m, [], []
                if v is None:
                    found.append(None), kinds.append(FOUND)
                    continue
                at = past(values, v)  # the stack's values rise: all from here on are no smaller
                found.append(names[at - 1] if at else None)
                kinds.append(FOUND if at or not first else OPEN)
                if equal and at and values[at - 1] == v:
                    at -= 1
                del values[at:], names[at:]
                values.append(v), names.append(n)
            last = b.column("_range")[0].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, b.column(name).type), pa.nulls(b.num_rows, pa.int64()), pa.array(kinds, pa.int32())], names=[f.name for f in schema])
        if values:  # what the last key leaves for the ranges behind
            k, known = len(values), dict(zip(keys, mark, strict=True)) | {"_range": last}
            columns = [pa.array([known[f]] * k if f in known else values if f == value else names if f == name else [None] * k, t) for f, t in zip(fields, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(k, columns[fields.index(name)].type), pa.array(range(k), pa.int64()), pa.array([STACK] * k, pa.int32())], names=[f.name for f in schema])

    free = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    within = stored(placed.mapInArrow(run, free), "nearest", "_kind")
    least = within.where((F.col("_kind") == STACK) & (F.col("_at") == 0)).select("_range", *keys, value).collect()  # one row a range
    ends = {r["_range"]: (tuple(r[k] for k in keys), r[value]) for r in least}

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            target = []
            for m, v, r in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column(value).to_pylist(), b.column("_range").to_pylist(), strict=True):
                r -= 1
                while r in ends and ends[r][0] == m and not (ends[r][1] <= v if equal else ends[r][1] < v):
                    r -= 1
                target.append(r if r in ends and ends[r][0] == m else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(target, pa.int32())], names=[*b.schema.names, "_target"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, names = None, [], []
        for b in batches:
            found = []
            for target, kind, v, n in zip(*(b.column(c).to_pylist() for c in ("_target", "_kind", value, name)), strict=True):
                if target != at:
                    at, values, names = target, [], []
                if kind == STACK:
                    values.append(v), names.append(n)
                    found.append(None)
                else:
                    i = past(values, v)
                    found.append(names[i - 1] if i else None)
            at_result = b.schema.get_field_index(result)
            yield b.set_column(at_result, b.schema.field(at_result), pa.array(found, b.column(name).type))

    with_target = T.StructType([*within.schema.fields, T.StructField("_target", T.IntegerType())])
    open_ = within.where(F.col("_kind") == OPEN).mapInArrow(aimed, with_target)
    open_ = stored(open_, "open")
    stacks = within.where(F.col("_kind") == STACK).withColumn("_target", F.col("_range"))
    met = open_.where("_target is not null").unionByName(stacks).repartition("_target").sortWithinPartitions("_target", F.desc("_kind"), "_at").mapInArrow(searched, with_target)
    columns = [*rows.columns, result]
    done = within.where(F.col("_kind") == FOUND).select(*columns)
    return done.unionByName(open_.where("_target is null").select(*columns)).unionByName(met.where(F.col("_kind") == OPEN).select(*columns))
