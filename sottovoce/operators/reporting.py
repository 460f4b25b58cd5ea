"""Reporting over alerts, consents and environment events (Q1-Q13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_alerts(alerts: DataFrame, severity: str | None = None, language: str | None = None, since=None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Q1, Q2: a page, newest first and then by id, and a one-row count under the same filters."""
    rows = alerts
    if severity:
        rows = rows.where(F.col("severity") == severity.upper())
    if language:
        rows = rows.where(F.col("language") == language)
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since))
    page = rows.orderBy(F.desc("ts"), F.desc("id")).offset(max(offset, 0)).limit(min(max(limit, 1), 1000))
    return page, rows.agg(F.count(F.lit(1)).alias("total"))


def newest(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Q10, Q11, Q13: the newest rows."""
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(min(max(limit, 0), 500))


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def by_language(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def by_category(alerts: DataFrame) -> DataFrame:
    """Q7: most frequent first, then by name."""
    return alerts.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def stats(alerts: DataFrame, as_of) -> DataFrame:
    """Q4, Q8, Q9 in one pass: total, last_24h, avg_latency_ms (whole), max_latency_ms."""
    recent = F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("interval 24 hours")
    return alerts.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(recent, 1)).alias("last_24h"),
        F.floor(F.avg("latency_ms") + 0.5).cast("long").alias("avg_latency_ms"), F.max("latency_ms").cast("long").alias("max_latency_ms"))


def text_filter(alerts: DataFrame, needle: str, text_cols: list[str], matches_col: str | None = None) -> DataFrame:
    """Q12: case-insensitive, in any of the texts or matched phrases."""
    n = F.lit(needle.lower())
    test = F.lit(False)
    for c in text_cols:
        test = test | F.contains(F.lower(F.coalesce(c, F.lit(""))), n)
    if matches_col:
        test = test | F.exists(matches_col, lambda m: F.contains(F.lower(m["phrase"]), n))
    return alerts.where(test)


CSV_COLUMNS = ["id", "ts", "source", "endpoint_id", "language", "severity", "threat_score", "keyword_score", "semantic_score", "pattern_score", "categories", "transcript", "translation"]


def csv_rows(alerts: DataFrame) -> DataFrame:
    """The exported columns as text; lists are joined by a bar, nulls of text are empty."""
    def shown(name: str):
        kind = alerts.schema[name].dataType.typeName()
        if kind == "array":
            return F.array_join(name, "|")
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        return F.coalesce(name, F.lit("")) if kind == "string" else F.col(name)

    return alerts.select(*[shown(c).alias(c) for c in CSV_COLUMNS])


def export_csv(alerts: DataFrame, path: str, limit: int = 100_000) -> None:
    """The newest alerts as CSV; each part begins with a byte-order mark and its header, and is written as text."""
    page = csv_rows(alerts.orderBy(F.desc("ts"), F.desc("id")).limit(limit))
    marked = page.withColumnRenamed(page.columns[0], "\ufeff" + page.columns[0])
    marked.write.csv(path, header=True, encoding="UTF-8")
