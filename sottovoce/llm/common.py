"""Helpers that the training-data operators share: text folding, shared storage, skew-proof joins."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key counts as hot when it holds more than this share of the rows; so at most HOT_SLICES keys are hot.
HOT_SLICES = 1000
#: Groups below this many rows are never split.
MIN_HOT_ROWS = 256
#: Tables of so few rows are joined as they are: one task may hold all of them.
SMALL_ROWS = 50_000
#: Tables of so few rows are written to a file for each FILE_ROWS, however many tasks they come from.
FEW_ROWS, FILE_ROWS = 1 << 17, 1 << 12


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null stays null."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master alone, a folder of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sottovoce-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_of(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """df with each column whose name (in any case) is among `names` renamed to kept_<name>, so that results can take
    those names and nothing is overwritten; and a function from an old name to its column."""
    wanted = {n.lower() for n in names}
    taken, now = wanted | {c.lower() for c in df.columns}, {}
    for c in df.columns:
        new = c
        while c.lower() in wanted and new.lower() in taken:
            new = f"kept_{new}"
        taken.add(new.lower())
        now[c] = new
    renamed = {c: new for c, new in now.items() if c != new}
    return df.withColumnsRenamed(renamed) if renamed else df, lambda c: F.col(f"`{now.get(c, c)}`")


def materialise(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back.

    most: the rows that df has at most, if known. A file takes longer to write than a few rows to move, so few rows are
    dealt to few files first; what they are computed by keeps its tasks."""
    path = shared_path(df.sparkSession, name)
    if most is not None and most <= FEW_ROWS:
        df = df.repartition(max(-(-most // FILE_ROWS), 1))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of materialised tables; files outside the shared folder are left alone."""
    spark = df.sparkSession
    conf, as_path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    own = as_path(shared_dir(spark)).toUri().getPath().rstrip("/") + "/"
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = as_path(parent)
        if path.toUri().getPath().startswith(own):
            path.getFileSystem(conf).delete(path, True)


def hot_keys(counted: DataFrame, on: str) -> DataFrame | None:
    """The keys with more than 1/HOT_SLICES of the rows, each with the parts (_n) to deal it over; None if there are none, or few rows. At most HOT_SLICES rows."""
    rows = counted.count()
    if rows <= SMALL_ROWS:
        return None
    share = max(rows // HOT_SLICES, MIN_HOT_ROWS)
    hot = counted.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    hot = materialise(hot.select(on, F.ceil(F.col("_n") / share).cast("int").alias("_n")), "hot", HOT_SLICES)
    return hot if hot.head(1) else None


_UNKNOWN = object()


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", counted: DataFrame | None = None, hot: object = _UNKNOWN) -> DataFrame:
    """Joins left, in which one key may hold most rows, to right, which has a row per key.

    Hot keys are dealt over several salts, with a copy of right's row for each; their list is bounded, so it may be
    broadcast. Keys are counted in `counted`, a table that holds left's keys as often as left or oftener, or else in
    left; it should be cheap to read. `hot` is what hot_keys() gave for such a table earlier. Null keys match nothing."""
    if hot is _UNKNOWN:
        hot = hot_keys(left if counted is None else counted, on)
    if hot is None:
        return left.join(right, on, how)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_n", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_n")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))
    copied = right.join(F.broadcast(hot), on, "left").withColumn("_salt", copies).drop("_n")
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")


#: Bits in a bitmap for each key (see flagged), the fewest and the most of a bitmap, and in a row of it. The most is 256 MB.
KEY_BITS, LEAST_BITS, MOST_BITS, ROW_BITS = 8, 1 << 20, 1 << 31, 4096


def flagged(df: DataFrame, key: str, needed: DataFrame, flag: str = "_maybe", most: int = MOST_BITS) -> DataFrame:
    """df with a column that is true where its bigint key is in needed (a table of one such column, any name, of distinct
    keys or nearly so), and for some other rows.

    Keys are looked up by hash in a bitmap that is broadcast. It has KEY_BITS bits for each needed key, so that about an
    eighth of the others are flagged however many there are, up to `most` bits; it goes on filling up to half as many keys
    as bits, and beyond that all rows are flagged: what is done to them is right for any, and only moves more."""
    keys = needed.count()
    bits = min(max(LEAST_BITS, 1 << (keys * KEY_BITS - 1).bit_length()), most)
    if keys * 2 > bits:
        return df.withColumn(flag, F.lit(True))
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    (k,) = needed.columns
    words = needed.select(F.floor(spot(k) / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(`{k}` as bigint)), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    listed = F.map_from_entries(F.collect_list(F.struct((F.col("w") % (ROW_BITS // 64)).cast("int"), "b")))
    rows = words.groupBy(F.floor(F.col("w") * 64 / ROW_BITS).cast("int").alias("_row")).agg(listed.alias("m"))  # at most 64 words each
    rows = rows.select("_row", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("_words"))
    found = df.withColumn("_row", F.floor(spot(key) / ROW_BITS).cast("int")).join(F.broadcast(materialise(rows, "bitmap", bits // ROW_BITS)), "_row", "left")
    word = F.get("_words", (F.floor(spot(key) / 64) % (ROW_BITS // 64)).cast("int"))
    hit = F.getbit(word, F.expr(f"cast(pmod(xxhash64(cast(`{key}` as bigint)), 64) as int)")) == 1
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_row", "_words")


def maybe_in(df: DataFrame, key: str, needed: DataFrame) -> DataFrame:
    """The rows of df whose bigint key is in needed, and some others (see flagged)."""
    return flagged(df, key, needed, "_maybe").where("_maybe").drop("_maybe")


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Before functions of this package run in tasks: sends the package to the executors, once an application, and
    keeps Arrow batches of long texts small (`rows` rows each, unless the session already asks for fewer)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/sottovoce", "zip", root, "sottovoce"))
        _SHIPPED.add(app)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
