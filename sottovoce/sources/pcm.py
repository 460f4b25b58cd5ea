"""A live source of PCM (S2): files that grow, one for each session, as a stream of whole chunks.

Recorders append little-endian 16-bit samples to <folder>/<session>.pcm, in blocks of any size, odd ones too. An offset is how
many bytes of each file were read, in whole chunks; what a file holds beyond waits in the file until its chunk is complete,
so nothing is carried in memory, and a query that starts again reads on where it had committed. Each file is a partition
of a micro-batch, or several if much is waiting. The folder must be mounted on the driver and all executors.

    spark.dataSource.register(pcm.PcmSource)
    spark.readStream.format("pcm").option("path", folder).load()   # session_id, chunk_idx, samples

Defined cases: an empty or missing folder has no rows yet; a file that shrinks is read on only once it is longer than
before; a rest that is no whole chunk is never read; other files are not looked at."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sottovoce.functions.audio import CHUNK

_BYTES = 2 * CHUNK
#: Chunks that a partition reads at most, and that are handed on together.
SPAN, TOGETHER = 20_000, 500


class Span(InputPartition):
    """Chunks `first` to `stop` of a session's file."""

    def __init__(self, session: str, first: int, stop: int) -> None:
        super().__init__((session, first, stop))
        self.session, self.first, self.stop = session, first, stop


class PcmReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole chunks of each session, by its name."""
        if not os.path.isdir(self.folder):
            return {}
        return {f.name[:-4]: f.stat().st_size // _BYTES for f in sorted(os.scandir(self.folder), key=lambda f: f.name) if f.is_file() and f.name.endswith(".pcm")}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for session, stop in end.items():
            for first in range(start.get(session, 0), stop, SPAN):
                out.append(Span(session, first, min(first + SPAN, stop)))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with open(os.path.join(self.folder, f"{partition.session}.pcm"), "rb") as f:
            for first in range(partition.first, partition.stop, TOGETHER):
                n = min(TOGETHER, partition.stop - first)
                f.seek(first * _BYTES)
                samples = np.frombuffer(f.read(n * _BYTES), "<i2").astype(np.float32) / 32768
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * CHUNK, pa.int32()), pa.array(samples))
                yield pa.RecordBatch.from_arrays([pa.array([partition.session] * n), pa.array(np.arange(first, first + n)), rows], ["session_id", "chunk_idx", "samples"])

    def commit(self, end: dict) -> None:
        pass


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "session_id string, chunk_idx bigint, samples array<float>"

    def streamReader(self, schema) -> PcmReader:
        return PcmReader(self.options["path"].removeprefix("file://"))
