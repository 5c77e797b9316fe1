"""Statistics, roll-ups and status lines."""

from __future__ import annotations

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def wls_by_group(d) -> str:
    """Weighted least squares of log price on log quantity; each brand weighs 1; a ridge of 1e-6. Brands are averaged first, so one row of each is exchanged."""
    return """
    WITH x AS (SELECT p_brand, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy FROM (SELECT p_brand, ln(l_quantity) AS x, ln(l_extendedprice) AS y FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY p_brand),
    s AS (SELECT count(*) + 1e-6 AS s0, sum(x) AS sx, sum(y) AS sy, sum(xx) + 1e-6 AS sxx, sum(xy) AS sxy FROM x)
    SELECT round((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx), 6) AS slope, round((sxx * sy - sx * sxy) / (s0 * sxx - sx * sx), 6) AS intercept FROM s"""


def weighted_quantile(d) -> str:
    """The 95 % quantile of price where each return flag weighs as much, by line status: prices are counted first, in steps of a hundred, and only the step that holds it is sorted."""
    return """
    WITH n AS (SELECT l_linestatus, l_returnflag, count(*) AS rows_n FROM lineitem GROUP BY l_linestatus, l_returnflag),
    v AS (SELECT l_linestatus, l_returnflag, l_extendedprice AS v, floor(l_extendedprice / 100) AS step, count(*) AS c FROM lineitem GROUP BY l_linestatus, l_returnflag, l_extendedprice),
    w AS (SELECT v.l_linestatus, v.step, v.v, sum(v.c * CAST(1 AS DOUBLE) / n.rows_n) AS w FROM v JOIN n ON n.l_linestatus = v.l_linestatus AND n.l_returnflag = v.l_returnflag GROUP BY v.l_linestatus, v.step, v.v),
    steps AS (SELECT l_linestatus, step, sum(w) AS w FROM w GROUP BY l_linestatus, step),
    run AS (SELECT l_linestatus, step, w, sum(w) OVER (PARTITION BY l_linestatus ORDER BY step) AS so_far, sum(w) OVER (PARTITION BY l_linestatus) AS whole FROM steps),
    hit AS (SELECT l_linestatus, step, so_far - w AS before_w, whole FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY step) AS rn FROM run WHERE so_far / whole >= 0.9501) WHERE rn = 1)
    SELECT l_linestatus, min(v) AS q95 FROM (
      SELECT w.l_linestatus, w.v, (before_w + sum(w.w) OVER (PARTITION BY w.l_linestatus ORDER BY w.v)) / whole AS so_far FROM w JOIN hit ON hit.l_linestatus = w.l_linestatus AND hit.step = w.step)
    WHERE so_far >= 0.9501 GROUP BY l_linestatus"""


def lobo_ratios(d) -> str:
    """Each brand's mean against all the others'."""
    return """
    SELECT p_brand, round((s / n) / ((sum(s) OVER () - s) / (sum(n) OVER () - n)), 8) AS ratio FROM (
      SELECT p_brand, sum(l_extendedprice) AS s, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand)"""


def score_wilson(d) -> str:
    """Share of good labels by language, with its 95 % interval."""
    return """
    SELECT lang, n, k, round((k / n + 1.9208 / n - 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low,
      round((k / n + 1.9208 / n + 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high
    FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)"""


def mcnemar_counts(d) -> str:
    """Pairs in which one judge says yes and the other no."""
    return """
    SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS first_only, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS second_only,
      CAST(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM labels"""


def agreement(d) -> str:
    """Conversations in which all turns have one role, absent ones being a role too."""
    return "SELECT conv_id, count(*) AS turns, count(DISTINCT coalesce(role, '')) = 1 AS agree FROM conversations GROUP BY conv_id"


def status_rollup(d) -> str:
    """A customer's state from the states of the orders, the first that holds."""
    return """
    SELECT o_custkey, CASE WHEN min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'finished' WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN 'waiting'
      ELSE 'running' END AS state, substr(CAST(min(o_orderdate) AS STRING), 1, 10) AS first_date, round(sum(o_totalprice), 2) AS cost, CAST(sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
    FROM orders GROUP BY o_custkey"""


def release_status(d) -> str:
    """Shipped overrides; a failed check blocks; both checks passed make it ready."""
    return """
    SELECT user_id, CASE WHEN shipped > 0 AND last_ship >= last_fail THEN 'Shipped' WHEN last_fail > last_pass THEN 'Not Ready' WHEN passed >= 2 THEN 'Ready' ELSE 'Pending Evaluation' END AS status FROM (
      SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS shipped, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS passed,
        coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), -1) AS last_ship, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), -1) AS last_fail,
        coalesce(max(CASE WHEN event_type = 'view' THEN event_id END), -1) AS last_pass FROM events GROUP BY user_id)"""


def safety_state(d) -> str:
    """ok, failed or not checked, from five checks of which some are absent."""
    checks = [f"CASE WHEN doc_id % {k} = 0 THEN NULL WHEN n_chars % {k} = 1 THEN 0 ELSE 1 END" for k in (11, 13, 17, 19, 23)]
    return f"""
    SELECT doc_id, CASE WHEN low = 0 THEN 'failed' WHEN n = 5 THEN 'ok' ELSE 'not checked' END AS state FROM (
      SELECT doc_id, min(ok) AS low, count(ok) AS n FROM ({" UNION ALL ".join(f"SELECT doc_id, {c} AS ok FROM documents" for c in checks)}) GROUP BY doc_id)"""


def producer_summary(d) -> str:
    """Totals by the producer's name without its number."""
    return f"SELECT {d.replaced('source', '[0-9]+$', '')} AS producer, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters, count(DISTINCT lang) AS langs FROM documents GROUP BY {d.replaced('source', '[0-9]+$', '')}"


def body_size(d) -> str:
    """The most frequent half-step of a tenth of the quantity by flag; ties to the smallest."""
    return """
    SELECT l_returnflag, size_half, n FROM (SELECT l_returnflag, size_half, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, size_half) AS rn FROM (
      SELECT l_returnflag, round(l_quantity / 5) / 2 AS size_half, count(*) AS n FROM lineitem GROUP BY l_returnflag, round(l_quantity / 5) / 2)) WHERE rn = 1"""


def money_round_up(d) -> str:
    """Dollars never rounded down: a ten-thousandth more, then up to the cent."""
    return "SELECT o_orderkey, ceil(round((o_totalprice / 7 + 0.0001) * 100, 6)) / 100 AS charge, least(ceil(round((o_totalprice / 7 + 0.0001) * 100, 6)) / 100, 9999.0) AS bounded FROM orders"


def date_words(d) -> str:
    """Dates in words, 'date not recorded' where there is none."""
    part = lambda x: f"CAST({x}(o_orderdate) AS STRING)"
    return f"SELECT o_orderkey, coalesce(concat({d.pick(MONTHS, 'CAST(month(o_orderdate) AS INT)')}, ' ', {part('day')}, ', ', {part('year')}), 'date not recorded') AS words FROM orders"


def clock_words(d) -> str:
    """Times of day in words."""
    h = "CAST(hour(ts) AS INT)"
    return f"SELECT event_id, concat(CAST(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END AS STRING), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END) AS clock FROM events"


def duration_words(d) -> str:
    """Seconds in words: under half a second, seconds, minutes and seconds, hours and minutes; halves are rounded to even."""
    whole = "CASE WHEN v - floor(v) = 0.5 THEN floor(v) + floor(v) % 2 ELSE floor(v + 0.5) END"
    text = lambda x: f"CAST(CAST({x} AS BIGINT) AS STRING)"
    return f"""SELECT event_id, CASE WHEN v < 0.5 THEN 'less than 1 s' WHEN s < 60 THEN concat({text("s")}, ' s') WHEN s < 3600 THEN concat({text("floor(s / 60)")}, ' min ', {text("s % 60")}, ' s')
      ELSE concat({text("floor(s / 3600)")}, ' h ', {text("floor(s % 3600 / 60)")}, ' min') END AS words FROM (SELECT event_id, v, {whole} AS s FROM (SELECT event_id, value * 20 AS v FROM events))"""


def size_band(d) -> str:
    """Size bands 0, 1, 2 by share, and effective resolution with short side to short side."""
    return """SELECT p_partkey, CASE WHEN p_size < 5 THEN 0 WHEN p_size <= 20 THEN 1 ELSE 2 END AS band,
      round(least(72 * greatest(p_size, 30) / greatest(p_retailprice / 10, 50), 72 * least(p_size, 30) / least(p_retailprice / 10, 50)), 4) AS ppi FROM part"""


def allowance(d) -> str:
    """Most tokens of a request by kind and forms: English stands for work orders, German for figures, the others for language requests."""
    return """SELECT doc_id, CAST(CASE lang WHEN 'en' THEN greatest(48000, 16000 + 45 * forms) WHEN 'de' THEN 32000 ELSE 800 + 200 * least(forms, 20) + 130 * greatest(0, forms - 20) END AS BIGINT) AS most
      FROM (SELECT doc_id, lang, n_chars % 2000 AS forms FROM documents)"""


def session_mirror(d) -> str:
    """The latest row and the count of each part."""
    return """SELECT conv_id, max(turn) AS last_turn, count(*) AS turns, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS answers, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY conv_id"""


def batch_states(d) -> str:
    """Batches by month: counts by state, first date, cost."""
    return """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY year(o_orderdate), month(o_orderdate)"""


def style_summary(d) -> str:
    """Elements by style: how many, first and last place, first sample with text; styles of few, short elements are rare."""
    return """
    SELECT p_brand, count(*) AS n, min(p_partkey) AS first_id, max(p_partkey) AS last_id, min_by(p_name, p_partkey) AS sample, count(*) <= 30 AND avg(length(p_name)) <= 110 AS rare
    FROM part GROUP BY p_brand"""


def mcnemar_exact(d) -> str:
    """Exact two-sided p of discordant pairs, by source, from running sums of logarithms."""
    return f"""
    WITH pairs AS (SELECT source, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c
      FROM labels l JOIN documents x ON l.doc_id = x.doc_id GROUP BY source),
    terms AS (SELECT source, i, sum(CASE WHEN i = 0 THEN CAST(0 AS DOUBLE) ELSE ln(CAST(b + c - i + 1 AS DOUBLE) / CAST(i AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) - (b + c) * ln(CAST(2 AS DOUBLE)) AS z
      FROM (SELECT source, b, c, CAST(i AS BIGINT) AS i FROM pairs {d.each(d.numbers("CAST(0 AS BIGINT)", "least(b, c)"), "i")}))
    SELECT p.source, b, c, round(CASE WHEN b + c = 0 THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), 2 * s) END, 6) AS p FROM pairs p
    JOIN (SELECT source, sum(exp(z)) AS s FROM terms GROUP BY source) t ON p.source IS NOT DISTINCT FROM t.source"""


def held_summary(d) -> str:
    """Held rows by kind, most first, with a fingerprint of their sorted keys that notices any change."""
    return f"""SELECT event_type, count(*) AS n, {d.sha256(d.joined("CAST(user_id AS STRING)"))} AS fingerprint
    FROM (SELECT DISTINCT event_type, user_id FROM events WHERE value > 50) GROUP BY event_type"""


def backtest_report(d) -> str:
    """Predictions from a customer's earlier mean: share within a quarter and a half, and the median ratio, by priority."""
    return f"""
    SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN abs(o_totalprice / m - 1) <= 0.25 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS within_25,
      round(avg(CASE WHEN abs(o_totalprice / m - 1) <= 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS within_50, round({d.median("o_totalprice / m")}, 6) AS bias FROM (
      SELECT o_orderpriority, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS m FROM orders)
    WHERE m IS NOT NULL GROUP BY o_orderpriority"""
