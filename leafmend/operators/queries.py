"""Queries for the operators that aren't plans: whole tables in, SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, words
from ..plans.text import SPACES
from ..streaming import outcomes
from . import bands, copies, grid, order, trees, validate


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries: a customer's orders are siblings, months their pages."""
    month = F.expr("CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT)")
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.lit(None).cast("string").alias("parent"), F.col("o_orderkey").alias("pos"), month.alias("first"), "o_orderkey")
    return o.withColumn("last", F.col("first") + F.col("o_orderkey") % 3).drop("o_orderkey")


def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders outside their customer's heaviest run in date order."""
    return order.out_of_order(_entries(spark, sf_dir)).drop("parent")


def read_late_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in that run that come over five months late."""
    return order.read_late(_entries(spark, sf_dir)).drop("parent")


def language_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as tagged parts of their order: kept, or dropped with a reason."""
    line = _table(spark, sf_dir, "lineitem")
    first, pos = F.col("l_partkey") % 60, F.expr(LINE_POS)
    parts = line.select(pos.alias("pos"), F.lit(1).alias("page"), F.col("l_orderkey").alias("mcid"), first.alias("first"), (first + F.col("l_quantity").cast("long") - 3).alias("last"), F.col("l_returnflag").alias("lang"))
    tags = spark.createDataFrame([("A",), ("N",)], "lang string")
    return validate.language_parts(parts, 1, tags).select("pos", "mcid", "first", "last", "why")


#: A line's place in its order, the same text for the same line only.
LINE_POS = """concat(CAST(l_linenumber AS STRING), '-', lpad(CAST(l_partkey AS STRING), 12, '0'), '-', lpad(CAST(l_suppkey AS STRING), 12, '0'), '-', lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 15, '0'),
    '-', lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 6, '0'))"""
LANGUAGE_PARTS = f"""WITH RECURSIVE p AS (SELECT {LINE_POS} AS pos, l_orderkey AS mcid, l_partkey % 60 AS first, l_partkey % 60 + CAST(l_quantity AS BIGINT) - 3 AS last, l_returnflag AS lang FROM lineitem),
    w AS (SELECT *, CASE WHEN NOT (first >= 0 AND first <= last) THEN 'character indexes not in order' WHEN lang NOT IN ('A', 'N') THEN 'language tag not allowed' END AS why FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY mcid ORDER BY pos) AS rn FROM w),
    s(mcid, rn, pos, first, last, why, kept) AS (SELECT DISTINCT mcid, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::STRUCT(a BIGINT, b BIGINT)[] FROM r
      UNION ALL SELECT mcid, rn, pos, first, last, CASE WHEN why IS NULL AND met THEN 'overlaps another part in the same run' ELSE why END, CASE WHEN why IS NULL AND NOT met THEN list_append(kept, {{'a': first, 'b': last}}) ELSE kept END FROM (
        SELECT r.mcid, r.rn, r.pos, r.first, r.last, r.why, s.kept, coalesce(list_bool_or(list_transform(s.kept, lambda k: k.a <= r.last AND r.first <= k.b)), false) AS met FROM s JOIN r ON r.mcid = s.mcid AND r.rn = s.rn + 1))
    SELECT pos, mcid, first, last, why FROM s WHERE rn > 0"""
_ENTRIES = """(SELECT o_custkey AS book, o_orderkey AS pos, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS first, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) + o_orderkey % 3 AS last,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)"""
#: Each entry's heaviest run that ends in it, one entry after another, then back from the heaviest; of equal ones the earliest.
_BACKBONE = f"""WITH RECURSIVE e AS {_ENTRIES},
    s(book, rn, f, t, b) AS (SELECT DISTINCT book, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM e
      UNION ALL SELECT book, rn, list_append(f, first), list_append(t, w + coalesce(best.t, 0)), list_append(b, -best.j) FROM (SELECT e.book, e.rn, e.first, e.last - e.first + 1 AS w, s.f, s.t, s.b,
        list_max(list_filter(list_transform(s.t, lambda x, i: CASE WHEN s.f[i] <= e.first THEN {{'t': x, 'j': -i}} END), lambda y: y IS NOT NULL)) AS best FROM s JOIN e ON e.book = s.book AND e.rn = s.rn + 1)),
    u AS (SELECT book, t, b FROM s WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY book ORDER BY rn DESC) = 1),
    k(book, n, b) AS (SELECT book, -list_max(list_transform(t, lambda x, i: {{'t': x, 'j': -i}})).j, b FROM u UNION ALL SELECT book, b[n], b FROM k WHERE b[n] IS NOT NULL),
    o AS (SELECT e.book, e.pos, e.first, e.last, k.n IS NOT NULL AS in_order FROM e LEFT JOIN k ON k.book = e.book AND k.n = e.rn),"""
OUT_OF_ORDER = _BACKBONE + """
    x AS (SELECT *, last_value(CASE WHEN in_order THEN last END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
      first_value(CASE WHEN in_order THEN first END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM o)
    SELECT book, pos, first, last, prev, next FROM x WHERE NOT in_order"""
READ_LATE = _BACKBONE + """
    x AS (SELECT *, max(last) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM o)
    SELECT book, pos, first, last, after FROM x WHERE in_order AND last - first < 2 AND after - first > 5"""
OPTIONAL_STEPS = """WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
    s(o_custkey, rn, room, kept, left_out) AS (SELECT DISTINCT o_custkey, 0::BIGINT, 500000::DOUBLE, 0::BIGINT, 0::BIGINT FROM o
      UNION ALL SELECT s.o_custkey, o.rn, CASE WHEN c <= room + 1e-9 THEN room - c ELSE room END, kept + CASE WHEN c <= room + 1e-9 THEN 1 ELSE 0 END, left_out + CASE WHEN c <= room + 1e-9 THEN 0 ELSE 1 END
        FROM s JOIN o ON o.o_custkey = s.o_custkey AND o.rn = s.rn + 1)
    SELECT o_custkey, kept, left_out FROM s WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY rn DESC) = 1"""


def optional_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a customer's orders, in order, fit a room of half a million when misfits are skipped."""
    o = _table(spark, sf_dir, "orders").withColumn("room", F.lit(500000.0))
    return validate.fitting(o, ["o_custkey"], "o_orderkey", "o_totalprice", "room")


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cells of their order's table, one header row and one header column."""
    line = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").cast("long").alias("r0"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    cells = line.selectExpr(
        "tbl", "dense_rank() OVER (PARTITION BY tbl ORDER BY r0 DIV 3) - 1L AS r", "row_number() OVER (PARTITION BY tbl, r0 DIV 3 ORDER BY r0, l_partkey, l_suppkey, l_extendedprice) - 1L AS i",
        "l_partkey % 2 + 1 AS colspan", "l_suppkey % 2 + 1 AS rowspan", "l_quantity < 5 AS empty",
    )
    reading = cells.select("tbl").distinct().selectExpr("tbl", "0 AS title_rows", "0 AS note_rows", "1 AS header_rows", "1 AS header_cols", "CAST(array() AS array<int>) AS group_rows", "CAST(array() AS array<int>) AS repeat_rows")
    out = grid.headed(cells, reading)
    return out.select("tbl", "r", "i", "th", "scope", F.array_join(F.transform("headers", lambda h: F.concat_ws(".", h["r"], h["i"])), " ").alias("headers"))


def band_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and size within two of each other in price: how many are near each."""
    a = _table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", F.col("p_retailprice").alias("x"))
    b = a.select("p_brand", "p_size", F.col("p_partkey").alias("near_part"), F.col("x").alias("y"))
    pairs = bands.band_join(a, b, ["p_brand", "p_size"], "x", "y", 2.0).where("p_partkey <> near_part")
    return pairs.groupBy("p_partkey").agg(F.count("*").alias("near_n"), F.min("near_part").alias("first_near"))


BAND_NEAR = """SELECT a.p_partkey, count(*) AS near_n, min(b.p_partkey) AS first_near FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size
    AND abs(a.p_retailprice - b.p_retailprice) <= 2 AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey"""


def copied_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which documents repeat 20 characters or more in a row, white space and case aside."""
    found = copies.shared_runs(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum("shingles").alias("shingles"))


def _shingles(table: str, key: str) -> str:
    squashed = f"regexp_replace(replace(lower(text), 'ß', 'ss'), '[{SPACES}]+', '', 'g')"
    return f"(SELECT DISTINCT {key}, substr(k, i, 20) AS s FROM (SELECT {key}, {squashed} AS k FROM {table}), unnest(range(1, length(k) - 18)) AS e(i))"


COPIED_TEXT = f"""SELECT item_id, count(DISTINCT doc_id) AS documents, count(*) AS shingles
    FROM {_shingles("benchmark", "item_id")} b JOIN {_shingles("documents", "doc_id")} t ON b.s = t.s GROUP BY item_id"""


def suspect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that a scan likely misread: how often, in how many documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w"))
    # What every suspect word has; the few that have it are all that is exchanged.
    by_form = docs.where(F.col("w").rlike("ii|[;:¢£·|‘’'`]")).groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs_n"))
    return by_form.where(forms.suspect(F.col("w")))


SUSPECT_WORDS = r"""SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs_n FROM documents, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+', 0)) AS e(w)
    WHERE NOT regexp_matches(lower(w), '^[ivxlcdm]+$') AND NOT regexp_matches(w, '(?i)@|://|www[.]|[.](?:com|org|net|edu|gov)(?:[^\pL\pN_]|$)')
    AND (regexp_matches(w, '[A-Za-z]ii|ii[a-z]|[A-Za-z][;:¢£·|][A-Za-z¢£]|[¢£]')
      OR (regexp_matches(w, '[‘’''`]') AND regexp_matches(regexp_replace(lower(w), '[ʻ‘’''`]', '', 'g'), '^[aeiouāēīōūhklmnpw]+[aeiouāēīōū]$'))) GROUP BY w"""


def weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with symbols in them against the same forms without: edits, and whether the one may stand for the other."""
    w = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("form")).distinct()
    w = w.where(F.col("form").rlike("[A-Za-z][#*$%&|<>@=+_]")).withColumn("plain", F.regexp_replace("form", "[#*$%&|<>@=+_]", ""))
    return w.select("form", "plain", words.weighted_distance("form", "plain").alias("distance"), words.reading_refusal("form", "plain").alias("refusal"))


def aligned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next, word by word and character by character."""
    t = _table(spark, sf_dir, "conversations")
    t = t.selectExpr("conv_id", "turn", "text", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS later").where("text is not null and later is not null")
    split = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    out = t.select("conv_id", "turn", words.character_error_rate("text", "later").alias("cer"), words.aligned(split("text"), split("later")).alias("a"))
    return out.select("conv_id", "turn", "cer", "a.paired", "a.changed", "a.too_different", "a.unpaired")


_STEPS = "CASE event_type WHEN 'click' THEN 'saved' WHEN 'view' THEN 'not_run' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'cap' END"


def outcome_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's outcome from the events in order."""
    return outcomes.outcome(_table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{_STEPS} AS why"), ["user_id"], "event_id", "why")


def streamed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the events."""
    events = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    return outcomes.drained(spark, events.selectExpr("user_id", "event_id", f"{_STEPS} AS why"), lambda s: outcomes.outcome(s, ["user_id"], "event_id", "why"))


OUTCOMES = f"""SELECT user_id, CASE WHEN f.why = 'cap' OR (f.why IN ('done', 'error') AND NOT coalesce(n.seq > f.seq, false)) THEN f.why ELSE l.why END AS outcome FROM (
    SELECT user_id, max({{'seq': event_id, 'why': why}}) FILTER (why NOT IN ('saved', 'not_run')) AS f, max({{'seq': event_id, 'why': why}}) FILTER (why = 'not_run') AS n, max({{'seq': event_id, 'why': why}}) AS l
    FROM (SELECT user_id, event_id, {_STEPS} AS why FROM events) GROUP BY user_id)"""


def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a tree over events (the parent of n is n / 3) by depth and the nearest container above."""
    nodes = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id > 0 THEN event_id DIV 3 END AS parent", "CASE WHEN event_id = 0 THEN 'root' WHEN event_type IN ('view', 'signup') THEN event_type END AS container"
    )
    found = trees.inherited(nodes, "event_id", "parent", "container")
    return found.groupBy("depth", F.col("inherited").alias("above")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def table_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name any descendant of a branch (a node three below the root), attached to that branch."""
    nodes = _table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id > 0 THEN event_id DIV 3 END AS parent", "CASE WHEN event_id BETWEEN 9 AND 26 THEN event_id END AS branch")
    found = trees.inherited(nodes, "event_id", "parent", "branch").where("inherited is not null")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return lines.join(found, F.col("l_orderkey") == F.col("event_id")).groupBy(F.col("inherited").alias("branch")).agg(F.count("*").alias("elements"), F.countDistinct("l_returnflag").alias("rules"))


def _tree_sql(root: str, above: str) -> str:
    return f"""WITH RECURSIVE tree(id, depth, above) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), {root}
      UNION ALL SELECT e.event_id, t.depth + 1, {above} FROM tree t JOIN events e ON e.event_id // 3 = t.id AND e.event_id > 0)"""


TREE_LEVELS = _tree_sql("'root'", "CASE WHEN e.event_type IN ('view', 'signup') THEN e.event_type ELSE t.above END") + " SELECT depth, above, count(*) AS n, min(id) AS first_id FROM tree GROUP BY depth, above"
TABLE_DESCENDANTS = _tree_sql("CAST(NULL AS BIGINT)", "CASE WHEN e.event_id BETWEEN 9 AND 26 THEN e.event_id ELSE t.above END") + """
    SELECT above AS branch, count(*) AS elements, count(DISTINCT l_returnflag) AS rules FROM tree JOIN lineitem ON l_orderkey = id WHERE above IS NOT NULL GROUP BY above"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [out_of_order, read_late_entries, language_parts, optional_steps, table_grid, band_near, copied_text, suspect_words, weighted_distance, aligned_turns, outcome_states, streamed_outcomes, tree_levels, table_descendants]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"out_of_order": OUT_OF_ORDER, "read_late_entries": READ_LATE, "language_parts": LANGUAGE_PARTS, "optional_steps": OPTIONAL_STEPS, "band_near": BAND_NEAR, "copied_text": COPIED_TEXT, "suspect_words": SUSPECT_WORDS, "outcome_states": OUTCOMES, "streamed_outcomes": OUTCOMES, "tree_levels": TREE_LEVELS, "table_descendants": TABLE_DESCENDANTS}
