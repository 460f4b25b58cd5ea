"""Settings (S7): typed defaults, overridden by Spark configuration under `spark.sottovoce.`."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    vad_threshold: float = 0.5
    hang_over_chunks: int = 18
    min_speech_chunks: int = 8
    max_segment_seconds: float = 12.0
    store_transcripts: bool = False
    send_transcripts: bool = False
    retention_days: int = 90
    verify_min_score: float = 0.2
    backend_url: str = ""
    backend_min_severity: str = "HIGH"
    denoise_mode: str = "auto"
    language_threshold: float = 0.6

    @classmethod
    def read(cls, spark: SparkSession, prefix: str = "spark.sottovoce.") -> Settings:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(prefix + f.name, None)
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**found)
