"""State machines over finished tables without a fold per key: blocks of rows run at once, in rounds, until they agree.

A machine's state after a block depends on its state before it, which only the block before can tell. In the first round
every block but a key's first begins by a guess; in each later round those blocks run again whose
beginning turned out otherwise. Once no beginning changes, every block ran with what the one before it left, so the result
is that of one pass. After r rounds the first r blocks of a key are certainly right; as machines forget (averages settle,
runs end, windows pass), others are right after two or three rounds, and no task ever holds more than a block."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sottovoce.operators.environment import SETTLED
from sottovoce.operators.jumps import checkpointed
from sottovoce.operators.machines import Machine

BLOCK = SETTLED
#: Rows, at most, of the blocks that a task's Python holds at a time.
TOGETHER = 1 << 16
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(rows: DataFrame, machine: Machine, key: str, order: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """key and what the machine gives, over rows (key, order, values); of rows that share key and order one counts. Rows of a
    null key or order are left out."""
    slim = rows.select(F.col(key).alias("_key"), F.col(order).cast("long").alias("_ord"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)]).where("_key is not null and _ord is not null")
    placed = slim.dropDuplicates(["_key", "_ord"]).withColumn("_block", F.floor((F.row_number().over(W.partitionBy("_key").orderBy("_ord")) - 1) / block))
    packed = placed.groupBy("_key", "_block").agg(F.sort_array(F.collect_list(F.struct("_ord", *[f"v{k}" for k in range(len(values))]))).alias("rows"))  # at most `block` rows each
    packed = checkpointed(packed)
    kind, given = dict(rows.dtypes)[key], machine.gives
    done = f"_key {kind}, _block long, began string, left string, gave array<struct<{given.replace(' ', ':').replace(',:', ',')}>>"
    names = [f.strip().split(" ")[0] for f in given.split(",")]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, b, began, held in zip(frame["_key"], frame["_block"], frame["began"], frame["rows"], strict=True):
                # a machine takes (time, order, values); here only the order is known
                mine = [(None, *(r.values() if isinstance(r, dict) else r)) for r in held]
                kept = tuple(json.loads(began)) if began else machine.guess(mine[0], b * block) if b else machine.begin(mine[0])
                left, gave = machine.feed(kept, mine)
                out.append((k, b, began, json.dumps(left, sort_keys=True), [dict(zip(names, g, strict=True)) for g in gave]))
            yield pd.DataFrame(out, columns=["_key", "_block", "began", "left", "gave"])

    def ran(blocks: DataFrame) -> DataFrame:
        # a record is a block here; the setting holds while they run, which is at once
        conf = blocks.sparkSession.conf
        was = conf.get(_BATCH)
        conf.set(_BATCH, str(max(1, TOGETHER // block)))
        try:
            return checkpointed(blocks.mapInPandas(step, done))
        finally:
            conf.set(_BATCH, was)

    result = ran(packed.withColumn("began", F.lit(None).cast("string")))
    while True:
        after = result.select("_key", (F.col("_block") + 1).alias("_block"), F.col("left").alias("told"))
        wrong = checkpointed(result.select("_key", "_block", "began").join(after, ["_key", "_block"]).where(~F.col("told").eqNullSafe(F.col("began"))).select("_key", "_block", F.col("told").alias("began")))
        if not wrong.head(1):
            return result.select(F.col("_key").alias(key), F.explode("gave").alias("g")).select(key, "g.*")
        again = ran(packed.join(wrong, ["_key", "_block"]).select("_key", "_block", "rows", "began"))
        result = checkpointed(result.join(again.select("_key", "_block"), ["_key", "_block"], "left_anti").unionByName(again))
