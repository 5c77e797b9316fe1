"""Windows: neighbours, running extremes, islands, chunks, budgets, sweep lines, latest rows."""

from __future__ import annotations


def skipped_levels(d) -> str:
    """Neighbouring levels where the next is more than one deeper."""
    return """
    SELECT user_id, event_id, level, before_level FROM (
      SELECT user_id, event_id, level, lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_level
      FROM (SELECT user_id, event_id, ts, CASE WHEN value < 10 THEN 1 WHEN value < 40 THEN 2 WHEN value < 80 THEN 3 ELSE 4 END AS level FROM events))
    WHERE level > before_level + 1"""


def repeated_neighbour(d) -> str:
    """Turns that repeat the one before, are empty, or are long."""
    return """
    SELECT conv_id, turn, coalesce(lower(text) = before_text, false) AS repeated, trim(text) = '' AS empty_text, length(text) > 200 AS long_text
    FROM (SELECT conv_id, turn, text, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before_text FROM conversations)"""


def jumps_up(d) -> str:
    """Pages (orders) with two jumps or more: a run that starts over twice the size of the one before, 6 at least, above it in the same column (72 across)."""
    by_page = "OVER (PARTITION BY page ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    return f"""
    SELECT page, CAST(sum(CASE WHEN top < before_top - 2 * greatest(before_size, 6) AND abs(x - before_x) < 72 THEN 1 ELSE 0 END) AS BIGINT) AS jumps, count(*) AS runs FROM (
      SELECT page, top, x, lag(top) {by_page} AS before_top, lag(x) {by_page} AS before_x, lag(size) {by_page} AS before_size FROM (
        SELECT l_orderkey AS page, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey % 700 AS top, l_quantity * 8 AS x, 4 + l_suppkey % 20 AS size FROM lineitem))
    GROUP BY page HAVING sum(CASE WHEN top < before_top - 2 * greatest(before_size, 6) AND abs(x - before_x) < 72 THEN 1 ELSE 0 END) >= 2"""


def read_late(d) -> str:
    """Entries that start more than five steps before the running greatest end of their siblings."""
    return """
    SELECT o_custkey, o_orderkey, reached FROM (
      SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM orders)
    WHERE o_totalprice < reached / 5"""


def hash_split(d) -> str:
    """The half of each document by the parity of its id's hash."""
    return f"""
    SELECT half, count(*) AS n, min(doc_id) AS first_doc FROM (
      SELECT doc_id, CASE WHEN substr({d.sha256("CAST(doc_id AS STRING)")}, 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'tune' ELSE 'score' END AS half FROM documents)
    GROUP BY half"""


def smallest_fit(d) -> str:
    """How many of a customer's orders fit a limit, smallest first."""
    return """
    SELECT o_custkey, count(*) AS fit, round(max(so_far), 2) AS spent FROM (
      SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far FROM orders)
    WHERE so_far <= 500000 GROUP BY o_custkey"""


def request_stats(d) -> str:
    """Calls, failures, median and slowest."""
    return f"""
    SELECT user_id, count(*) AS calls, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round({d.median("value")}, 6) AS median_s, max(value) AS slowest
    FROM events GROUP BY user_id"""


def latest_per_key(d) -> str:
    """The latest check of each (user, kind)."""
    return """
    SELECT user_id, event_type, event_id, value FROM (
      SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def interval_merge(d) -> str:
    """Touching or overlapping intervals of a user as one."""
    t = d.seconds("ts")
    return f"""
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS merged, round(min(a), 3) AS first_s, round(max(b), 3) AS last_s FROM (
      SELECT user_id, a, b, sum(CASE WHEN a <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT user_id, event_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
        FROM (SELECT user_id, event_id, {t} AS a, {t} + value * 600 AS b FROM events)))
    GROUP BY user_id, island"""


def shape_rows(d) -> str:
    """The rows that tell a table's shape, 14 at most: the top four, the bottom two, then rows that hold one thing, in order. A supplier's lines are a table, small quantities rows of one thing."""
    order = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
    return f"""
    WITH placed AS (SELECT l_suppkey, {order}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
    marked AS (SELECT *, i <= 4 OR i > n - 2 AS edge, l_quantity <= 3 AS lone FROM placed)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(i AS BIGINT) AS place FROM (
      SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS edges, sum(CASE WHEN lone AND NOT edge THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS lone_so_far FROM marked)
    WHERE edge OR lone AND lone_so_far <= 14 - edges"""
