import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sottovoce.operators import audit, merkle

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SIZES = {3: 1, 4: 2, 5: 16, 6: 17, 9: 300}


def entries(spark):
    rows = [(b, "alert", 1000 * b + k, T + dt.timedelta(seconds=k), f"payload {b} {k}", None if k % 2 else "d", k) for b, n in SIZES.items() for k in range(n)]
    df = spark.createDataFrame(rows, "batch bigint, kind string, ref_id bigint, ts timestamp, payload_hash string, detail string, ord int")
    return df.repartition(3)


def brute(rows):
    """row: (kind, ref, us, payload, detail) in order -> levels of digests."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    levels = [[sha("|".join(["leaf", k, str(r), str(us), p, d or ""])) for k, r, us, p, d in rows]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("node|" + ",".join(below[k : k + 16])) for k in range(0, len(below), 16)])
    return levels


@pytest.fixture(scope="module")
def built(spark):
    hashed = merkle.leaves(entries(spark)).cache()
    nodes = merkle.forest(hashed).cache()
    return hashed, nodes, merkle.heads(nodes).cache()


def test_trees_and_chain_equal_brute_force(built):
    hashed, nodes, chain = built
    got = {}
    for r in nodes.orderBy("batch", "level", "pos").collect():
        got.setdefault(r["batch"], {}).setdefault(r["level"], []).append(r["hash"])
        assert r["width"] >= 1
    prev, us = "0" * 64, int(T.timestamp()) * 10**6
    rows = {r["seq"]: r for r in chain.collect()}
    for seq, (b, n) in enumerate(SIZES.items(), 1):
        levels = brute([("alert", 1000 * b + k, us + k * 10**6, f"payload {b} {k}", None if k % 2 else "d") for k in range(n)])
        assert list(got[b].values()) == levels
        row = hashlib.sha256(f"{prev}|batch|{b}|{n}|{levels[-1][0]}".encode()).hexdigest()
        assert tuple(rows[seq]) == (seq, b, n, levels[-1][0], prev, row)
        prev = row


def test_a_chain_goes_on(spark, built):
    _, nodes, chain = built
    first = merkle.heads(nodes.where("batch <= 5"))
    second = merkle.heads(nodes.where("batch > 5"), first)
    assert sorted(map(tuple, first.union(second).collect())) == sorted(map(tuple, chain.collect()))
    assert merkle.heads(nodes.limit(0)).count() == 0 and merkle.forest(merkle.leaves(entries(spark).limit(0))).count() == 0


def test_every_leaf_has_a_proof(built):
    hashed, nodes, chain = built
    got = merkle.proofs(nodes, hashed).join(chain.select("batch", "root"), "batch")
    assert got.count() == sum(SIZES.values())
    assert got.where(merkle.proven_root(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert {r["batch"]: r["n"] for r in got.groupBy("batch").agg(F.max(F.size("proof")).alias("n")).collect()} == {3: 0, 4: 1, 5: 1, 6: 2, 9: 3}
    forged = got.withColumn("leaf", F.sha2("leaf", 256))
    assert forged.where(merkle.proven_root(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 0


def problems(*given):
    return sorted(((r["batch"], r["level"], r["pos"], r["problem"]) for r in merkle.verify(*given).collect()), key=repr)


def test_tampering_is_found_and_located(spark, built):
    hashed, nodes, chain = built
    assert problems(chain, nodes, hashed) == []
    edited = hashed.withColumn("payload_hash", F.when((F.col("batch") == 9) & (F.col("pos") == 77), F.lit("x")).otherwise(F.col("payload_hash")))
    assert problems(chain, nodes, edited) == [(9, 0, 77, "edited entry")]
    assert problems(chain, nodes, hashed.where("not (batch = 6 and pos = 16)")) == [(6, 0, 16, "missing entry")]
    assert problems(chain, nodes, hashed.union(hashed.where("batch = 3").withColumn("pos", F.lit(5).cast("bigint")))) == [(3, 0, 5, "unknown entry")]
    # a leaf that is rewritten with its row no longer fits the node above; a whole tree no longer fits the chain
    leaf = nodes.withColumn("hash", F.when((F.col("batch") == 9) & (F.col("level") == 0) & (F.col("pos") == 77), F.lit("x")).otherwise(F.col("hash")))
    assert problems(chain, leaf, hashed) == [(9, 0, 77, "edited entry"), (9, 1, 4, "rewritten node")]
    other = merkle.leaves(entries(spark).withColumn("payload_hash", F.when(F.col("batch") == 5, F.lit("y")).otherwise(F.col("payload_hash"))))
    assert problems(chain, merkle.forest(other), other) == [(5, None, None, "wrong root")]
    assert problems(chain.where("batch <> 4"), nodes, hashed) == sorted([(4, None, None, "unchained batch"), (5, None, None, "broken link")], key=repr)
    assert [p for *_, p in problems(chain.withColumn("row_hash", F.when(F.col("seq") == 5, F.lit("z")).otherwise(F.col("row_hash"))), nodes, hashed)] == ["rewritten row"]


def test_an_entry_without_a_batch_is_an_error(spark):
    with pytest.raises(Exception, match="no batch"):
        merkle.leaves(entries(spark).withColumn("batch", F.lit(None).cast("bigint"))).collect()


def test_payloads_of_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert rows.select(audit.payload_hash(rows, ["id", "t"]).alias("h")).distinct().count() == 2
