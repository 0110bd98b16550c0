"""Structured Streaming forms of the per-key operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Noise, RateLimit, Vault

UNIT = 60_000_000


class TokenBucket(StatefulProcessor):
    """Two numbers of state per client; idle state expires after ten minutes, or later, when the bucket is full anyway."""

    def __init__(self, cfg: RateLimit):
        self.cap, self.rate = int(cfg.capacity * UNIT), cfg.per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        # an idle bucket is full again by then, so that dropping it changes no answer
        self.state = handle.getValueState("bucket", "level long, last long", int(60_000 * max(10, self.cap / UNIT / self.rate)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        level, last = self.state.get() if self.state.exists() else (self.cap, None)
        admitted = []
        for us in frame["us"].tolist():
            if last is not None:  # a row older than the last one refills nothing and leaves the clock alone
                level = min(self.cap, level + int(max(us - last, 0) * self.rate))
            last = us if last is None else max(us, last)
            admitted.append(level >= UNIT)
            level -= UNIT * (level >= UNIT)
        self.state.update((int(level), int(last)))
        yield pd.DataFrame({"client": key[0], "event_id": frame["event_id"].to_numpy(), "admitted": admitted})

    def close(self) -> None:
        pass


def admit(events: DataFrame, client: str, ts: str, event_id: str, cfg: RateLimit = RateLimit(), watermark: str = "10 minutes") -> DataFrame:
    """A stream of (client, event_id, admitted). Rows later than the watermark are dropped; needs the RocksDB store."""
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(client).alias("client"), F.col(event_id).alias("event_id")).withWatermark("ts", watermark)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    kind = dict(rows.dtypes)
    return rows.groupBy("client").transformWithStateInPandas(TokenBucket(cfg), f"client {kind['client']}, event_id {kind['event_id']}, admitted boolean", "append", "processingTime")


class Ledger(StatefulProcessor):
    """Budget spent and last use per subject; the ledger starts anew after the idle time."""

    def __init__(self, cfg: Noise):
        self.budget, self.idle = cfg.budget, cfg.idle_reset_hours * 3600 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "spent double, last long", self.idle // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        spent, last = self.state.get() if self.state.exists() else (0.0, None)
        allowed = []
        for us, cost in zip(frame["us"].tolist(), frame["cost"].tolist(), strict=True):
            if last is not None and us - last >= self.idle:
                spent = 0.0
            last = us if last is None else max(us, last)
            allowed.append(self.budget - spent > 0)
            spent += cost if allowed[-1] else 0.0
        self.state.update((float(spent), int(last)))
        yield pd.DataFrame({"subject": key[0], "event_id": frame["event_id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def charge(events: DataFrame, subject: str, ts: str, event_id: str, cost: str, cfg: Noise = Noise(), watermark: str = "10 minutes") -> DataFrame:
    """A stream of (subject, event_id, allowed): the budget ledger in keyed state."""
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(subject).alias("subject"), F.col(event_id).alias("event_id"), F.col(cost).cast("double").alias("cost")).withWatermark("ts", watermark)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    kind = dict(rows.dtypes)
    return rows.groupBy("subject").transformWithStateInPandas(Ledger(cfg), f"subject {kind['subject']}, event_id {kind['event_id']}, allowed boolean", "append", "processingTime")


def vault_sessions(events: DataFrame, key: str, ts: str, cfg: Vault = Vault(), watermark: str = "10 minutes") -> DataFrame:
    """A stream of closed vault sessions: they end after the vault's idle time."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    return rows.groupBy(key, F.session_window("__ts", f"{cfg.ttl_minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "requests")


def redactions_by_window(findings: DataFrame, ts: str, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """A stream of redaction counts by type and window."""
    rows = findings.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    return rows.groupBy(F.window("__ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")
