"""Source divergence by systolic rotation.

Every source of a language is a vector of term counts, cut into blocks of terms
by their hash. The blocks lie in a table bucketed by (language, source, block) and stay
there; compressed copies circulate by the rounds of a round-robin tournament,
in which each source meets each other one of its language once. A meeting
evaluates both directions from the two blocks' present terms, and what neither
has at once by a product. Heaps within a block rank a source's own terms.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kept, new_path

#: Documents of a language that a kept term occurs in, at least; the ranks of the term part.
LEAST, TOP = 3, 200
UNIT = 10**9
#: Counts a block has, about, and more for each source of its language; rounds that circulate in one job; terms that a task counts before it hands them on.
ENTRIES, EACH, WAVE, HELD = 200_000, 50, 16, 400_000
#: Bytes of terms are non-ASCII ones and ASCII letters, these in lower case; all others end a term.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, total, first): occurrences of the kept terms in a source and in its language.

    A term is kept where at least `least` documents of the language have it;
    first marks one row of each. Each group also has a row with the empty term,
    so that one without terms is there too. Texts are counted whole; a task
    hands on at most HELD counts at a time. One exchange by (lang, term) serves
    the sums, the choice and the totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                k, have = len(terms) + 1, d[lang, source]
                columns = [pa.repeat(pa.scalar(lang, pa.binary()), k), pa.repeat(pa.scalar(source, pa.binary()), k), pa.array([b"", *terms], pa.binary())]
                columns += [pa.array([0, *terms.values()], pa.int64()), pa.array([0, *map(have.__getitem__, terms)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            n.clear(), d.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                terms = text.as_py().translate(TERM_BYTES).split()
                group = n.setdefault((lang, source), Counter())
                before = len(group)
                group.update(terms)
                d.setdefault((lang, source), Counter()).update(set(terms))
                held += len(group) - before
                if held >= HELD:
                    yield from out()
                    held = 0
        yield from out()

    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    each = docs.select(raw("lang"), raw("source"), raw("text")).mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    named = each.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "docs")
    sums = named.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = sums.withColumn("total", F.sum("n").over(term)).withColumn("have", F.sum("docs").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return sums.where((F.col("term") == "") | (F.col("have") >= least)).select("lang", "source", "term", "n", "total", "first")


def shares(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), exact for any count."""
    if len(count) and int(count.max()) >= (1 << 62) // UNIT:
        return np.array([1 + UNIT * (c + 1) // whole for c in count.tolist()], np.int64)
    return 1 + UNIT * (count + 1) // max(1, whole)


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def squeezed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids within a block and their counts, compressed for the way."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), n]).astype("<i8").tobytes(), 1)


def loosened(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(raw), "<i8")
    return np.cumsum(x[: len(x) // 2]), x[len(x) // 2 :]


def meeting(a: bytes, b: bytes, whole_a: int, whole_b: int, terms: int) -> tuple[int, int]:
    """The sums over a block of terms of the values of a against b and of b against a."""
    (ia, na), (ib, nb) = loosened(a), loosened(b)
    ids = np.union1d(ia, ib)
    count = np.zeros((2, len(ids) + 1), np.int64)  # the last place is a term that neither has
    count[0, np.searchsorted(ids, ia)], count[1, np.searchsorted(ids, ib)] = na, nb
    p, q = shares(count[0], whole_a), shares(count[1], whole_b)
    there, back, rest = squared(p, q), squared(q, p), terms - len(ids)
    return sum(there[:-1].tolist()) + rest * int(there[-1]), sum(back[:-1].tolist()) + rest * int(back[-1])


BLOCKS = "lang string, g long, block long, vec binary, terms long, source string, term string, value long"
BLOCK_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())


def _blocks(top: int):
    """Entries sorted by (lang, block, term) to the block's vector of each source of the language, empty ones too, and each source's top terms."""

    def vectors(at: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        lang, block, sources, whole_lang = at
        term, g, n, total, whole = (np.concatenate([h[i] for h in held]) for i in range(5))
        source = [x for h in held for x in h[5]]
        ids = np.cumsum(np.concatenate([[0], (term[1:] != term[:-1]).astype(np.int64)]))
        terms, order = int(ids[-1]) + 1, np.argsort(g, kind="stable")
        cuts = np.searchsorted(g[order], np.arange(sources + 1))
        rows: list[tuple] = []
        for k in range(sources):
            mine = order[cuts[k] : cuts[k + 1]]
            rows.append((lang, k, block, squeezed(ids[mine], n[mine]), terms, None, None, None))
            if not len(mine):
                continue
            p, q = shares(n[mine], int(whole[mine[0]])), shares(total[mine], whole_lang)
            over = np.flatnonzero(p > q)
            best = heapq.nsmallest(top, zip((-squared(p[over], q[over])).tolist(), term[mine[over]].tolist(), strict=True))
            rows += [(lang, k, block, None, None, source[mine[0]], t.decode(), -v) for v, t in best]
            if len(rows) >= 10_000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            marks = list(zip(*(b.column(c).to_pylist() for c in ("lang", "block", "sources", "whole_lang")), strict=True))
            g, n, total, whole = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "n", "total", "whole"))
            term, source = np.array([*b.column("term").to_pylist(), None], object)[:-1], b.column("source").to_pylist()
            i = 0
            while i < len(marks):
                j = i
                while j < len(marks) and marks[j] == marks[i]:
                    j += 1
                if marks[i] != at:
                    if held:
                        yield from vectors(at, held)
                    at, held = marks[i], []
                held.append((term[i:j], g[i:j], n[i:j], total[i:j], whole[i:j], source[i:j]))
                i = j
        if held:
            yield from vectors(at, held)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(BLOCK_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BLOCK_TYPES, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _opponent(g: Column, r: Column, seats: Column) -> Column:
    """Whom g meets in round r of seats - 1, seats even: the sum of both is r by the circle's size, the last seat takes who would meet itself."""
    circle = seats - 1
    other = F.pmod(r - g, circle)
    last = F.pmod(r * (seats / 2).cast("long"), circle)
    return F.when(g == circle, last).when(other == g, circle).otherwise(other)


def audited(docs: DataFrame, least: int = LEAST, top: int = TOP, entries: int = ENTRIES, wave: int = WAVE) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of docs.

    docs: text, lang and source, nulls read as ''; other columns are ignored. A
    language keeps the terms that at least `least` of its documents have; p of
    a kept term is 1 + floor(10**9 * (count + 1) / (N + V)), its value against
    q floor((p - q)**2 / q). Part `pair` has every other source of the language
    with the sum over all kept terms (0 where none is kept), part `term` the
    `top` best of the group's own terms with p over the language's q. Ranks go
    by value, then by the item's bytes. A language of one source has no pairs,
    a group without kept terms no terms; an empty table gives no rows.

    A block of terms has about `entries` counts of all the language's sources,
    so a source or language of any size is spread over blocks; `wave` rounds
    circulate at once, so a job sends at most half as many copies of each
    vector.
    """
    spark = docs.sparkSession
    counts = kept(counted(docs, least))
    own = counts.where("term <> ''")
    vocabulary = own.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("n_lang"), F.count("*").alias("nnz"))
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    seat = Window.partitionBy("lang").orderBy("source")
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")  # a row for each source
    sources = F.count("*").over(Window.partitionBy("lang"))
    groups = kept(groups.select(
        "lang", "source", (F.row_number().over(seat) - 1).cast("long").alias("g"), sources.alias("sources"), F.coalesce("v", F.lit(0)).alias("v"), F.ceil(F.col("nnz") / (entries + EACH * sources)).alias("blocks"),
        (F.coalesce("n_group", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("whole"), (F.coalesce("n_lang", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("whole_lang"),
    ))
    placed = own.join(groups.where("v > 0"), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    placed = placed.select("lang", "block", "g", "source", "sources", "whole", "whole_lang", F.col("term").cast("binary").alias("term"), "n", "total")
    found = kept(placed.repartition("lang", "block").sortWithinPartitions("lang", "block", "term").mapInArrow(_blocks(top), BLOCKS))

    ranked = found.where("value IS NOT NULL").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = _rotated(spark, found.where("vec IS NOT NULL").select("lang", "g", "block", "vec", "terms"), groups, wave)
    both = pairs.unionByName(_without_terms(groups)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))  # a group's sources, or its blocks' top terms
    return ranked.withColumn("rank", place).where(F.col("rank") <= top).unionByName(both.withColumn("rank", place))


def _without_terms(groups: DataFrame) -> DataFrame:
    """Pairs of a language that keeps no term, all of value 0."""
    a = groups.where("v = 0").select("lang", "source")
    return a.join(a.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))


def _rotated(spark: SparkSession, vectors: DataFrame, groups: DataFrame, wave: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language with kept terms, by rounds."""
    facts = groups.select("lang", "g", "source", "whole", (F.col("sources") + F.col("sources") % 2).alias("seats"))
    most = groups.agg(F.max(F.col("sources") + F.col("sources") % 2)).first()[0] or 0
    name, path = f"leafmend_residents_{uuid.uuid4().hex}", new_path(spark, "residents")
    known = vectors.join(facts, ["lang", "g"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lang", "g", "block"]
    known.repartition(buckets, *keys).write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    residents = spark.table(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(8)]
            sums = [meeting(a, p, x, y, terms) for _, _, _, a, p, x, y, terms in zip(*columns, strict=True)]
            there, back = (pa.array([s[i] for s in sums], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), there, back], names=["lang", "source", "item", "there", "back"])

    parts = []
    try:
        for first in range(0, max(0, most - 1), wave):
            rounds = F.explode(F.expr(f"sequence({first}L, least({first + wave}L, seats - 1) - 1)")).alias("r")
            on_the_way = residents.where(f"seats - 1 > {first}").select(*keys, "source", "whole", "vec", "seats", rounds)
            on_the_way = on_the_way.withColumn("host", _opponent(F.col("g"), F.col("r"), F.col("seats")))
            # Of two that meet one stays: the smaller seat if both are even or both odd, else the larger.
            travels = (F.col("g") < F.col("host")) == ((F.col("g") + F.col("host")) % 2 == 1)
            copies = on_the_way.where(travels).select("lang", F.col("host").alias("g"), "block", F.col("source").alias("item"), F.col("whole").alias("whole_item"), F.col("vec").alias("vec_item"))
            met = residents.join(copies.hint("merge"), keys).select("lang", "source", "item", "vec", "vec_item", "whole", "whole_item", "terms")
            sums = met.mapInArrow(run, "lang string, source string, item string, there long, back long")
            parts.append(kept(sums.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))))
    finally:
        spark.sql(f"DROP TABLE {name}")
        dropped(spark, path)
    schema = "lang string, source string, item string, value long"
    out = spark.createDataFrame([], schema)
    for p in parts:
        ways = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
        out = out.unionByName(p.select("lang", ways.alias("way")).select("lang", "way.*"))
    return out


#: The same in DuckDB's SQL, every source against every other term by term.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(n.n, 0) AS n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
s AS (SELECT lang, source, sum(n) AS whole, sum(total) AS whole_lang, count(*) AS v FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, (1 + 1000000000::HUGEINT * (c.n + 1) // (s.whole + s.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (c.total + 1) // (s.whole_lang + s.v))::HUGEINT AS q
  FROM c JOIN s ON s.lang = c.lang AND s.source = c.source),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
