import numpy as np

from sottovoce.functions.audio import CHUNK, pcm16
from sottovoce.sources import pcm


def test_files_that_grow_by_odd_blocks_over_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    spark.dataSource.register(pcm.PcmSource)
    folder = tmp_path / "live"
    folder.mkdir()
    data = {s: rng.integers(-30_000, 30_000, n).astype("<i2").tobytes() for s, n in (("a", 5 * CHUNK + 100), ("b", 3 * CHUNK), ("empty", 0), ("short", 7))}
    (folder / "notes.txt").write_text("not audio")
    sent = dict.fromkeys(data, 0)
    for step in (3 * CHUNK + 1, 2 * CHUNK - 333, 1, 10 * CHUNK):  # each time the query starts again
        for s, raw in data.items():
            with open(folder / f"{s}.pcm", "ab") as f:
                f.write(raw[sent[s] : sent[s] + step])
            sent[s] = min(sent[s] + step, len(raw))
        stream = spark.readStream.format("pcm").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {(r["session_id"], r["chunk_idx"]): r["samples"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [("a", k) for k in range(5)] + [("b", k) for k in range(3)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    for (s, k), samples in got.items():
        assert np.array_equal(np.array(samples, np.float32), pcm16(data[s])[k * CHUNK : (k + 1) * CHUNK])


def test_offsets_and_partitions(tmp_path, monkeypatch):
    monkeypatch.setattr(pcm, "SPAN", 4)
    reader = pcm.PcmReader(str(tmp_path / "none"))
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    spans = reader.partitions({"a": 3}, {"a": 12, "b": 2, "c": 0})
    assert [(p.session, p.first, p.stop) for p in spans] == [("a", 3, 7), ("a", 7, 11), ("a", 11, 12), ("b", 0, 2)]
    assert reader.partitions({"a": 5}, {"a": 4}) == []
