"""Money limits over a stream of requests: reserve before a call, settle after it, time out what never came back.

A budget has several limits, each with a cap and what was spent before. A call
may be made if its worst case fits every limit beside what is spent and what is
reserved for other calls; its own earlier reservation is freed first. Settling
replaces the reservation by the charge, by the worst case where the charge
isn't known. A reservation that nothing settled within TIMEOUT counts as spent
in full. The same small ledger runs over a stream, with its state in Spark's
store, and over a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.groups import by_group
from ..sources.shared import shared_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a reservation is held for.
TIMEOUT = 3600.0
OUTCOME = "budget long, seq long, granted boolean, refused_by string, spent double, reserved double"


@dataclass
class Ledger:
    """One budget. limits: name to (cap or None, spent before); held: call to (worst case, since)."""

    limits: dict[str, tuple[float | None, float]]
    call_cap: float | None = None
    spent: float = 0.0
    held: dict[str, tuple[float, float]] = field(default_factory=dict)

    def expire(self, now: float) -> None:
        """Count as spent what has been held for TIMEOUT, oldest first."""
        for call, (worst, since) in sorted(self.held.items(), key=lambda x: (x[1][1], x[0])):
            if since + TIMEOUT <= now:
                del self.held[call]
                self.spent += worst

    def reserve(self, call: str, worst: float, now: float) -> str | None:
        """None if the call may be made, else the name of what has no room for it."""
        if self.call_cap is not None and worst > self.call_cap:
            return "call"
        others = sum(w for c, (w, _) in sorted(self.held.items()) if c != call)
        for name, (cap, before) in self.limits.items():
            if cap is not None and cap - before - self.spent - others < worst:
                return name
        self.held[call] = worst, now
        return None

    def settle(self, call: str, cost: float | None) -> None:
        """The call came back: its reservation goes, its cost is spent, the worst case where it isn't known."""
        worst, _ = self.held.pop(call, (0.0, 0.0))
        self.spent += worst if cost is None else cost

    def step(self, kind: str, call: str, amount: float | None, now: float) -> tuple[bool | None, str | None, float, float]:
        """(granted, refused by, spent, reserved) after one request of kind reserve, settle or release."""
        self.expire(now)
        refused = granted = None
        if kind == "reserve" and amount is not None:
            refused = self.reserve(call, amount, now)
            granted = refused is None
        elif kind == "settle":
            self.settle(call, amount)
        elif kind == "release":
            self.held.pop(call, None)
        return granted, refused, self.spent, sum(w for _, (w, _) in sorted(self.held.items()))


def decided(requests: DataFrame, limits: dict[str, tuple[float | None, float]], call_cap: float | None = None) -> DataFrame:
    """(OUTCOME) for each row of a table of requests: budget, seq, moment (seconds), kind, call, amount.

    Rows of a budget are taken in order of seq, which tells them apart; a
    reservation without an amount asks for nothing. A null budget is one.
    """

    def run(kind: list, call: list, amount: list, at: list) -> list[list]:
        ledger = Ledger(limits, call_cap)
        return [list(x) for x in zip(*(ledger.step(*row) for row in zip(kind, call, amount, at, strict=True)), strict=True)]

    rows = requests.select("budget", "seq", "moment", "kind", "call", "amount")
    out = by_group(rows, ["budget"], ["seq"], ["kind", "call", "amount", "moment"], run, "granted boolean, refused_by string, spent double, reserved double")
    return out.select("budget", "seq", "granted", "refused_by", "spent", "reserved")


class _Budget(StatefulProcessor):
    """The ledger of each budget in Spark's state store: what is spent, what is held, and a timer for what may be forgotten."""

    def __init__(self, limits: dict[str, tuple[float | None, float]], call_cap: float | None):
        self.limits, self.call_cap = limits, call_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "amount double")
        self.held = handle.getMapState("held", "call string", "worst double, since double")

    def _ledger(self) -> Ledger:
        held = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()} if self.held.exists() else {}
        return Ledger(self.limits, self.call_cap, self.spent.get()[0] if self.spent.exists() else 0.0, held)

    def _keep(self, before: dict, ledger: Ledger) -> None:
        self.spent.update((ledger.spent,))
        for call in before.keys() - ledger.held.keys():
            self.held.removeKey((call,))
        for call, held in ledger.held.items():
            if before.get(call) != held:
                self.held.updateValue((call,), held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        ledger = self._ledger()
        before = dict(ledger.held)
        out = [
            (key[0], int(seq), *ledger.step(kind, call, None if pd.isna(amount) else float(amount), float(at)))
            for seq, kind, call, amount, at in zip(batch["seq"], batch["kind"], batch["call"], batch["amount"], batch["moment"], strict=True)
        ]
        self._keep(before, ledger)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def streamed(requests: DataFrame, limits: dict[str, tuple[float | None, float]], call_cap: float | None = None) -> DataFrame:
    """decided() of a stream: rows of a budget are taken in order of seq within a batch, batches as they come."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = requests.where("budget IS NOT NULL").select("budget", "seq", "moment", "kind", "call", "amount")
    return rows.groupBy("budget").transformWithStateInPandas(_Budget(limits, call_cap), OUTCOME, "Append", "None")


def drained(spark: SparkSession, decisions: DataFrame, out: str | None = None, marks: str | None = None) -> DataFrame:
    """All that a stream of decisions holds now, each once: files and state are of one checkpoint, so a run that is broken off and begun again repeats none."""
    out, marks = out or shared_path(spark, "decided"), marks or shared_path(spark, "decided-marks")
    decisions.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTCOME).parquet(out)


#: The events as requests: looking reserves, buying settles, an error settles at the worst case, signing up releases; a user has eight calls under way at most.
REQUESTS = """user_id AS budget, event_id AS seq, {seconds} AS moment, CASE event_type WHEN 'purchase' THEN 'settle' WHEN 'error' THEN 'settle' WHEN 'signup' THEN 'release' ELSE 'reserve' END AS kind,
    CAST(event_id % 8 AS STRING) AS call, CASE WHEN event_type = 'purchase' THEN value / 2 WHEN event_type IN ('view', 'click') THEN value END AS amount"""
LIMITS, CALL_CAP = {"book": (600.0, 0.0), "account": (900.0, 250.0)}, 95.0


def sql(requests: str) -> str:
    """decided() with LIMITS and CALL_CAP in DuckDB: rows of a budget one after another, calls by number from 0 to 7."""
    total = "list_sum(list_transform({0}, lambda x: coalesce(x.worst, 0)))"
    rooms = " ".join(f"WHEN {cap - before} - spent - {total.format('list_transform(held, lambda x, i: CASE WHEN i = call + 1 THEN NULL ELSE x END)')} < amount THEN '{name}'" for name, (cap, before) in LIMITS.items())
    late = f"x.since + {TIMEOUT} <= moment"
    return f"""
    WITH RECURSIVE r AS (SELECT budget, seq, moment, kind, CAST(call AS INT) AS call, amount, row_number() OVER (PARTITION BY budget ORDER BY seq) AS rn FROM (SELECT {requests} FROM events)),
    s(budget, rn, seq, granted, refused_by, spent, held) AS (
      SELECT DISTINCT budget, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR, 0::DOUBLE, list_transform(range(8), lambda i: NULL::STRUCT(worst DOUBLE, since DOUBLE)) FROM r
      UNION ALL SELECT budget, rn, seq, CASE WHEN kind = 'reserve' AND amount IS NOT NULL THEN refused IS NULL END, refused,
        spent + CASE WHEN kind = 'settle' THEN coalesce(amount, held[call + 1].worst, 0) ELSE 0 END,
        list_transform(held, lambda x, i: CASE WHEN i = call + 1 AND kind <> 'reserve' THEN NULL WHEN i = call + 1 AND amount IS NOT NULL AND refused IS NULL THEN {{'worst': amount, 'since': moment}} ELSE x END)
      FROM (SELECT *, CASE WHEN kind <> 'reserve' OR amount IS NULL THEN NULL WHEN amount > {CALL_CAP} THEN 'call' {rooms} END AS refused FROM (
        SELECT r.budget, r.rn, r.seq, r.moment, r.kind, r.call, r.amount, spent + coalesce(list_sum(list_transform(held, lambda x: CASE WHEN {late} THEN x.worst ELSE 0 END)), 0) AS spent,
          list_transform(held, lambda x: CASE WHEN {late} THEN NULL ELSE x END) AS held FROM s JOIN r ON r.budget = s.budget AND r.rn = s.rn + 1)))
    SELECT budget, seq, granted, refused_by, round(spent, 4) AS spent, round({total.format('held')}, 4) AS reserved FROM s WHERE rn > 0"""


def rounded(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("spent", F.round("spent", 4)).withColumn("reserved", F.round("reserved", 4))
