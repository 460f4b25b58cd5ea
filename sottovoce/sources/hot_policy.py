"""A policy that changes while streams run (U3): versions in a folder that driver and executors share.

A version is written under a name of its own and then renamed, which shows it whole or not at all; of two writers of one
number the rename of the second fails, and it takes the next. Each micro-batch reads the newest version, which is as small
as a policy, and its verdicts tell which one it was. Any file system that Spark reaches will do."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.sources.policy import Policy


def _open(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    path, files = _open(spark, folder)
    if not files.exists(path):
        return []
    return sorted(int(f.getPath().getName()[:-5]) for f in files.listStatus(path) if f.getPath().getName()[:-5].isdigit() and f.getPath().getName().endswith(".yaml"))


def publish(spark: SparkSession, policy: Policy, folder: str) -> int:
    """Adds a version, which counts from the next micro-batch on; returns its number."""
    path, files = _open(spark, folder)
    files.mkdirs(path)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    draft = as_path(f"{folder}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(yaml.safe_dump(policy.raw, allow_unicode=True).encode()))
    stream.close()
    number = max(versions(spark, folder), default=0)
    while True:
        number += 1
        target = as_path(f"{folder}/{number:08}.yaml")
        if not files.exists(target) and files.rename(draft, target):
            return number


def newest(spark: SparkSession, folder: str) -> tuple[int, Policy]:
    """The newest version that can be used; one that is not valid (U4) is passed over."""
    for number in reversed(versions(spark, folder)):
        text = spark.read.text(f"{folder}/{number:08}.yaml", wholetext=True).head()[0]
        try:
            return number, Policy(yaml.safe_load(text))
        except (ValueError, yaml.YAMLError):
            continue
    raise FileNotFoundError(f"no policy in {folder}")


def rescored(folder: str, score: Callable[[DataFrame, Policy], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: scores a micro-batch by the newest policy, adds its number as policy_version, and hands it to the sink."""
    def write(batch: DataFrame, number: int) -> None:
        version, policy = newest(batch.sparkSession, folder)
        sink(score(batch, policy).withColumn("policy_version", F.lit(version)), number)

    return write
