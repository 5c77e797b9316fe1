"""Joins: differences, validators, repeats, gaps, boxes, as-of predictions."""

from __future__ import annotations


def ledger_dedupe(d) -> str:
    """Seed and ledger as one: the first row of a key, without ledger rows that the seed has; every other ledger row has a number of its own."""
    return """
    WITH seed AS (SELECT user_id, event_type, floor(value) AS value, event_id FROM events),
    ledger AS (SELECT user_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -1 - event_id END AS event_id FROM events)
    SELECT user_id, event_type, event_id FROM (
      SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY event_id) AS rn FROM (
        SELECT * FROM seed UNION ALL SELECT l.* FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.event_id = l.event_id)))
    WHERE rn = 1"""


def resend_pairs(d) -> str:
    """Each request with the turn that answers it."""
    return """
    SELECT q.conv_id, q.turn, a.turn AS answered, a.role AS answerer FROM conversations q
    LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user'"""


def unfinished_anti(d) -> str:
    """Numbers up to the last that nothing finished."""
    return f"""
    SELECT e.user_id, e.n FROM (SELECT user_id, CAST(n AS BIGINT) AS n FROM (SELECT user_id, count(*) AS most FROM events GROUP BY user_id) {d.each(d.numbers("1", "most"), "n")}) e
    LEFT JOIN (SELECT DISTINCT user_id, event_id % 97 AS n FROM events) f ON f.user_id = e.user_id AND f.n = e.n WHERE f.n IS NULL"""


def diff_full_outer(d) -> str:
    """Fields that differ between two snapshots, missing on one side included."""
    return """
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_mktsegment AS baseline, b.c_mktsegment AS newer
    FROM customer a FULL OUTER JOIN (
      SELECT CASE WHEN c_custkey % 5 = 0 THEN -1 - c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer) b ON a.c_custkey = b.c_custkey
    WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment"""


def newly_failing(d) -> str:
    """Rules that fail more after than before."""
    return """
    SELECT coalesce(a.rule, b.rule) AS rule, coalesce(b.failed, 0) AS before_n, coalesce(a.failed, 0) AS after_n
    FROM (SELECT l_suppkey AS rule, count(*) AS failed FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 2 GROUP BY l_suppkey) a
    FULL OUTER JOIN (SELECT l_suppkey AS rule, count(*) AS failed FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 2 GROUP BY l_suppkey) b ON a.rule = b.rule
    WHERE coalesce(a.failed, 0) > coalesce(b.failed, 0)"""


def order_validator(d) -> str:
    """Decisions kept or dropped with the first reason against them."""
    return """
    SELECT why, count(*) AS n, min(l.l_orderkey) AS first_order FROM (
      SELECT l.l_orderkey, CASE WHEN p.p_partkey IS NULL THEN 'unknown object' WHEN s.s_suppkey IS NULL THEN 'unknown style' WHEN l.l_quantity > 45 THEN 'out of range'
        WHEN l.l_returnflag = 'R' THEN 'type not allowed' WHEN row_number() OVER (PARTITION BY l.l_orderkey, l.l_partkey ORDER BY l.l_linenumber, l.l_suppkey, l.l_extendedprice, l.l_returnflag) > 1 THEN 'repeated' ELSE 'kept' END AS why
      FROM lineitem l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) p ON p.p_partkey = l.l_partkey
      LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = l.l_suppkey) l GROUP BY why"""


def point_in_box(d) -> str:
    """Parts by the box that holds their (size, price) point."""
    return """
    SELECT box, count(*) AS n, min(p_partkey) AS first_part FROM part
    JOIN (VALUES (1, 0, 10, 900.0, 1200.0), (2, 10, 30, 1000.0, 1500.0), (3, 20, 50, 1400.0, 2100.0)) AS b(box, x0, x1, y0, y1)
    ON p_size >= x0 AND p_size < x1 AND p_retailprice >= y0 AND p_retailprice < y1 GROUP BY box"""


def asof_backtest(d) -> str:
    """Each order against the mean of the same customer's earlier ones: running sums by day, nothing paired."""
    earlier = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
    WITH days AS (SELECT o_custkey, o_orderdate, count(*) AS n, count(o_totalprice) AS priced, sum(o_totalprice) AS total FROM orders
      WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey, o_orderdate),
    known AS (SELECT o_custkey, o_orderdate, sum(n) {earlier} AS n, sum(priced) {earlier} AS priced, sum(total) {earlier} AS total FROM days)
    SELECT c.o_orderkey, CAST(coalesce(k.n, 0) AS BIGINT) AS seen, floor(round(100 * k.total / CASE WHEN k.priced > 0 THEN k.priced END, 6) + 0.5) / 100 AS predicted
    FROM orders c LEFT JOIN known k ON k.o_custkey = c.o_custkey AND k.o_orderdate = c.o_orderdate"""


def carried_choices(d) -> str:
    """Earlier choices that land on today's items: the same id and the same value."""
    return """
    SELECT a.doc_id, a.quality, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.quality = b.quality THEN 'carried' ELSE 'changed' END AS state
    FROM labels a LEFT JOIN (SELECT CASE WHEN doc_id % 4 = 1 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels) b ON a.doc_id = b.doc_id"""


def multiset_equality(d) -> str:
    """Whether two orderings hold the same rows, however often each: reordered, not changed. The second has part 1 where an order has a seventh line."""
    return """
    SELECT l_orderkey, sum(abs(n)) = 0 AS same FROM (
      SELECT l_orderkey, p, sum(side) AS n FROM (
        SELECT l_orderkey, l_partkey AS p, 1 AS side FROM lineitem UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 1 ELSE l_partkey END, -1 FROM lineitem) GROUP BY l_orderkey, p) GROUP BY l_orderkey"""


def claimed_keys(d) -> str:
    """Ids that any of four sets claims, and those of all."""
    return """
    SELECT doc_id, count(*) AS sets FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE n_chars > 3000
      UNION ALL SELECT doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id"""


def pair_agreement(d) -> str:
    """Labels of one language for each pair of judges: how often both say the same."""
    judges = " UNION ALL ".join(f"SELECT doc_id, {i} AS judge, {e} AS v FROM labels" for i, e in enumerate(("quality", "toxic", "(quality + toxic) % 2")))
    return f"""
    WITH j AS ({judges}) SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n, CAST(sum(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS BIGINT) AS same
    FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.judge < b.judge GROUP BY a.judge, b.judge"""


def update_join(d) -> str:
    """A reviewer's choices laid over decisions: rejected ones go, changed ones take the new value, others stay."""
    return """
    SELECT a.doc_id, CASE WHEN b.choice = 'change' THEN b.v ELSE a.quality END AS quality, coalesce(b.choice, 'none') AS choice
    FROM labels a LEFT JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 - doc_id END AS doc_id, 1 - quality AS v, CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'change' ELSE 'reject' END AS choice FROM labels) b ON a.doc_id = b.doc_id
    WHERE b.choice IS DISTINCT FROM 'reject'"""
