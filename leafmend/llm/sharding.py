"""Sharding by global byte-size prefix sums.

The global order is that of the texts' 64-bit hashes, so equal texts are
neighbours. Totals of each part of the hash range are summed ahead of it, the
running sum within the part is added, and the sum is cut at equal targets.
Groups of equal texts larger than a set share of a shard (of which there can
only be a bounded number) are placed first, each into the emptiest shard, and
what they take is left out of that shard's stretch of the order. A group larger
than a whole shard cannot stay whole under equal sizes; it is cut by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

#: Shares of one shard: a group above LARGE is placed alone, one above WHOLE is cut.
LARGE, WHOLE = 1 / 1000, 0.9
#: Groups that a part of the hash range aims at, and parts that one group of equal texts is dealt out in.
PART, SPREAD = 1 << 16, 1024


def _running(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Exclusive prefix sums of columns over (by, order), as before_<column>, from totals of each by."""
    totals = rows.groupBy(by).agg(*(F.sum(c).alias(f"t_{c}") for c in columns))
    ahead = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(by, *(F.coalesce(F.sum(f"t_{c}").over(ahead), F.lit(0)).alias(f"s_{c}") for c in columns))
    within = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(starts), by)  # one row for each PART groups, and a few for each shard
    sums = [(F.col(f"s_{c}") + F.sum(c).over(within) - F.col(c)).alias(f"before_{c}") for c in columns]
    return out.select(*rows.columns, *sums)


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for each row of docs.

    docs: doc_id and text, other columns ignored. Size is the text's UTF-8
    bytes plus 1; a null text has no bytes and equals the empty text. Rows of
    equal text share a shard unless they fill over WHOLE of one. slot counts a
    shard's rows from 0 without gaps. Repeated rows are rows of their own;
    tables with fewer rows than shards leave shards empty; an empty table gives
    no rows; a null doc_id is a row like any other. Reruns agree. A shard is
    one stretch of the order of hashes and the large groups placed in it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    # Rows without a doc_id are alike in all that is returned, so their own numbers may spread them.
    spread = F.coalesce("doc_id", F.monotonically_increasing_id())
    rows = rows.withColumn("spread", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
    rows = kept(rows)
    groups = kept(rows.groupBy("h", "spread").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    found = groups.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    whole, bits = found["bytes"], max(6, (found["n"] // PART).bit_length())
    if not whole:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = whole / shards
    large = groups.groupBy("h").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > target * LARGE)
    fill, placed = [0.0] * shards, {}
    for r in large.orderBy(F.desc("bytes"), "h").collect():  # their bytes bound them: under shards / LARGE rows
        if r["bytes"] <= target * WHOLE:
            k = min(range(shards), key=fill.__getitem__)
            if fill[k] + r["bytes"] <= target * (1 + LARGE):
                placed[r["h"]] = k
                fill[k] += r["bytes"]
    spark = docs.sparkSession
    fixed = spark.createDataFrame(list(placed.items()) or [], "h long, fixed int")
    # The parts of a group of equal texts stay next to each other; one placed alone is left out of the order.
    part = F.floor(F.shiftrightunsigned("h", 64 - bits)).cast("int")
    groups = groups.join(F.broadcast(fixed), "h", "left").withColumn("part", part)
    free = _running(groups.where("fixed is null"), "part", ["h", "spread"], ["bytes"])
    first = free.groupBy("h").agg(F.min("before_bytes").alias("first"), F.sum("bytes").alias("all"))
    free = free.join(first, "h")
    cuts, total = [], 0.0
    for k in range(shards - 1):
        total += max(0.0, target - fill[k])
        cuts.append(total)
    at = F.when(F.col("all") > target * LARGE, F.col("before_bytes") + F.col("bytes") / 2).otherwise(F.col("first") + F.col("all") / 2)
    free = free.withColumn("shard", sum((at >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0))
    columns = ["h", "spread", "part", "rows", "shard"]
    dealt = free.select(*columns).unionByName(groups.where("fixed is not null").withColumn("shard", F.col("fixed")).select(*columns))
    dealt = dealt.withColumn("lane", F.shiftleft(F.col("shard").cast("long"), bits) + F.col("part"))
    dealt = kept(_running(dealt, "lane", ["h", "spread"], ["rows"]).select("h", "spread", "shard", "before_rows"))
    shard_start = dealt.groupBy("shard").agg(F.min("before_rows").alias("start"))
    nth = F.row_number().over(Window.partitionBy("h", "spread").orderBy("doc_id", "size"))
    numbered = rows.withColumn("nth", nth - 1)
    out = numbered.join(dealt, ["h", "spread"]).join(F.broadcast(shard_start), "shard")
    slot = F.col("before_rows") - F.col("start") + F.col("nth")
    return out.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
