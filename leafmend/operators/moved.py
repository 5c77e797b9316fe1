"""What moved between two texts: anchors that stand once in each, and the longest run of them that keeps its order.

Words that occur once in either text are anchors; an anchor grows to the
longest run of equal words around it. The anchors that keep their order are
the heaviest increasing run of their places, found in n log n; those outside it
have moved. No table of all pairs of words is made.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a fragment that are kept, and how many fragments a pair tells of.
SHOWN, MOST = 60, 5


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the runs of equal words around words that both have once, in order of a, none within another."""
    once_a, once_b = ({w for w, n in Counter(x).items() if n == 1} for x in (a, b))
    where = {w: j for j, w in enumerate(b) if w in once_a and w in once_b}
    out, end = [], 0
    for i, w in enumerate(a):
        j = where.get(w)
        if j is None or i < end:
            continue
        low = 0
        while i - low > end and j - low > 0 and a[i - low - 1] == b[j - low - 1]:
            low += 1
        high = 1
        while i + high < len(a) and j + high < len(b) and a[i + high] == b[j + high]:
            high += 1
        out.append((i - low, j - low, low + high))
        end = i + high
    return out


def in_order(runs: list[tuple[int, int, int]]) -> set[int]:
    """Numbers of the runs of the most words in all whose places in b rise with those in a; of equal ones the earliest end.

    ends holds the places in b at which more words than before are reached,
    both rising, so the best run to go on from is found by bisection.
    """
    ends: list[int] = []
    reached: list[tuple[int, int]] = []  # words, run
    before: list[int | None] = []
    best = (0, None)
    for n, (_, j, size) in enumerate(runs):
        at = bisect_left(ends, j)
        total = size + (reached[at - 1][0] if at else 0)
        before.append(reached[at - 1][1] if at else None)
        if total > best[0]:
            best = (total, n)
        if at and reached[at - 1][0] >= total:
            continue
        stop = at
        while stop < len(ends) and reached[stop][0] <= total:
            stop += 1
        ends[at:stop], reached[at:stop] = [j], [(total, n)]
    kept, n = set(), best[1]
    while n is not None:
        kept.add(n)
        n = before[n]
    return kept


def compared(a: list[str], b: list[str]) -> tuple[int, int, int, list[str]]:
    """(words that stay, words that moved, words of a that are in no run, the first moved fragments)."""
    runs = anchors(a, b)
    stay = in_order(runs)
    moved = [r for n, r in enumerate(runs) if n not in stay]
    staying = sum(runs[n][2] for n in stay)
    words = sum(r[2] for r in moved)
    return staying, words, len(a) - staying - words, [" ".join(a[i : i + size])[:SHOWN] for i, _, size in moved[:MOST]]


def moved_fragments(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with stayed, moved, lost (words of a) and fragments: a and b are arrays of words; a null one is empty.

    Equal texts and empty ones are told without looking at their words.
    """
    same = F.col(a).eqNullSafe(F.col(b)) | (F.size(F.coalesce(a, F.array())) == 0) | (F.size(F.coalesce(b, F.array())) == 0)
    asked = pairs.withColumn("_asked", ~same)
    fields = "stayed long, moved long, lost long, fragments array<string>"
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asked.schema)}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        for batch in batches:
            x, y, ask = batch.column(a), batch.column(b), batch.column("_asked")
            rows = [compared(x[i].as_py(), y[i].as_py()) if ask[i].as_py() else (None, None, None, None) for i in range(batch.num_rows)]  # one pair's words at a time as Python's objects
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "stayed", "moved", "lost", "fragments"])

    n = F.size(F.coalesce(a, F.array())).cast("long")
    equal = F.col(a).eqNullSafe(F.col(b))
    out = asked.mapInArrow(run, schema).drop("_asked")
    zero = F.lit(0).cast("long")
    filled = {"stayed": F.when(equal, n).otherwise(zero), "moved": zero, "lost": F.when(equal, zero).otherwise(n), "fragments": F.array().cast("array<string>")}
    return out.select(*pairs.columns, *(F.coalesce(c, v).alias(c) for c, v in filled.items()))
