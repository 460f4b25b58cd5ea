"""Outbound delivery (O1-O9): events, due rows, attempts, back-off, signatures."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sottovoce.operators.fusion import rank


def alert_event(df: DataFrame, verdict: str = "verdict", with_text: bool = False) -> DataFrame:
    """O1: rows (id, endpoint_id, ts, verdict) with event_json: what was found, the first ten phrases, and the text only on demand."""
    v = F.col(verdict)
    body = F.struct(
        F.lit("alert").alias("type"), F.uuid().alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("endpoint_id"), v["severity"].alias("severity"), v["threat_score"].alias("threat_score"),
        v["categories"].alias("categories"), F.slice(F.transform(v["matches"], lambda m: m["phrase"]), 1, 10).alias("phrases"), *([v["transcript"].alias("transcript")] if with_text else []))
    return df.withColumn("event_json", F.to_json(body))


def status_event(state: str, **more) -> str:
    """O2."""
    return json.dumps({"type": "status", "state": state, **more}, sort_keys=True)


def gated(df: DataFrame, severity: Column, least: str = "HIGH", kind: Column | None = None) -> DataFrame:
    """O3: alerts from `least` on; rows of another kind always pass."""
    passes = rank(severity) >= rank(F.lit(least))
    return df.where(passes | (kind != "alert") if kind is not None else passes)


def current(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outbox rows (id, created, event_json) with the state that the appended attempts (id, at, ok, error) leave."""
    a = attempts.groupBy("id").agg(
        F.count(F.when(~F.col("ok"), 1)).alias("attempts"), F.min(F.when(F.col("ok"), F.col("at"))).alias("delivered_at"), F.max(F.struct("at", "ok", F.substring("error", 1, 300).alias("error"))).alias("l"))
    joined = outbox.join(a, "id", "left")
    tries = F.coalesce("attempts", F.lit(0))
    wait = backoff(tries - 1)
    due = F.when(tries > 0, F.timestamp_micros(F.unix_micros("l.at") + (wait * 1_000_000).cast("bigint"))).otherwise(F.col("created"))
    return joined.select(outbox["*"], tries.alias("attempts"), due.alias("next_attempt"), "delivered_at", F.when(F.col("delivered_at").isNull(), F.col("l.error")).alias("last_error"))


def backoff(attempts: Column) -> Column:
    """Seconds to wait, given the failures before this one."""
    return F.least(F.lit(300.0), 5.0 * F.pow(F.lit(2.0), F.least(attempts, F.lit(20))))


def due(state: DataFrame, now, limit: int = 20) -> DataFrame:
    """O4."""
    return state.where(F.col("delivered_at").isNull() & (F.col("next_attempt") <= F.lit(now).cast("timestamp"))).orderBy("id").limit(limit)


def stats(state: DataFrame) -> DataFrame:
    """O8."""
    return state.agg(F.count(F.when(F.col("delivered_at").isNull(), 1)).alias("pending"), F.count("delivered_at").alias("delivered"), F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("id"))).alias("last_error"))


def signature(secret: str, timestamp: str, body: str) -> str:
    """O9."""
    return "sha256=" + hmac.new(secret.encode(), f"{timestamp}.{body}".encode(), hashlib.sha256).hexdigest()


def http_sender(url: str, token: str, secret: str, prefix: str = "X-Sottovoce", timeout: float = 10.0) -> Callable[[str, str], None]:
    """A function that posts one signed event; other than 2xx raises."""
    def send(key: str, body: str) -> None:
        now = str(int(time.time()))
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {token}", f"{prefix}-Timestamp": now, f"{prefix}-Signature": signature(secret, now, body), "Idempotency-Key": key}
        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers, method="POST"), timeout=timeout) as answer:
            if not 200 <= answer.status < 300:
                raise OSError(f"HTTP {answer.status}")

    return send


def flush(rows: DataFrame, send: Callable[[str, str], None], now) -> list[tuple]:
    """Sends what is due, oldest first, and stops at the first failure. Returns attempts (id, at, ok, error) to append; at most one page of rows comes to the driver."""
    out = []
    for r in due(rows, now).collect():
        try:
            send(str(r["id"]), r["event_json"])
            out.append((r["id"], now, True, None))
        except Exception as e:  # noqa: BLE001 - any failure of the receiver is recorded and ends the flush
            out.append((r["id"], now, False, str(e)[:300]))
            break
    return out
