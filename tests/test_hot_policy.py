import pytest

from sottovoce.operators import fusion
from sottovoce.sources import hot_policy
from sottovoce.sources.policy import EXAMPLE, Policy
from sottovoce.streaming import monitor


def policy(*phrases):
    return Policy(EXAMPLE | {"categories": {"names": {"weight": 0.9, "phrases": list(phrases)}}})


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/policies"
    with pytest.raises(FileNotFoundError):
        hot_policy.newest(spark, folder)
    assert [hot_policy.publish(spark, policy("blue heron"), folder), hot_policy.publish(spark, policy("قلعہ"), folder)] == [1, 2]
    (tmp_path / "policies" / "00000003.yaml").write_text("categories: {}")
    (tmp_path / "policies" / "00000004.yaml").write_text("{: ]")
    number, found = hot_policy.newest(spark, folder)
    assert number == 2 and found.raw["categories"]["names"]["phrases"] == ["قلعہ"]
    assert hot_policy.publish(spark, policy("x"), folder) == 5 and not list((tmp_path / "policies").glob(".draft*[!c]"))


def test_a_stream_changes_its_verdicts_without_a_restart(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/policies", "id long, t string"
    hot_policy.publish(spark, policy("blue heron"), folder)
    (tmp_path / "in").mkdir()
    score = lambda df, p: fusion.score(df, p, "id", "t", latin=True)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(hot_policy.rescored(folder, score, monitor.parquet_sink(str(tmp_path / "out")))).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k in range(2):
            (tmp_path / f"{k}.json").write_text('{"id": %d, "t": "a blue heron by the river"}' % k)
            (tmp_path / f"{k}.json").rename(tmp_path / "in" / f"{k}.json")
            query.processAllAvailable()
            hot_policy.publish(spark, policy("grey seal"), folder)
    finally:
        query.stop()
    got = {r["id"]: (r["verdict"]["severity"], r["policy_version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: ("CRITICAL", 1), 1: ("NONE", 2)}
