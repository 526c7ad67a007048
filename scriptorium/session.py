"""Session settings, the shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only what a local session needs; on a cluster these come from its own configuration.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and for the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scriptorium")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``, else the session's
    checkpoint folder, else a new temporary one (local sessions only)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has processes of its own
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{work_folder(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove_folder(spark, path)
        except Exception:  # noqa: BLE001 - the session has already ended
            pass

    atexit.register(clean)
    return path


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, outlives lost executors,
    and keeps column pruning, which a checkpoint of rows would lose. ``release`` deletes it before the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def release(*settled: DataFrame | None) -> None:
    """Delete settled tables that nothing will read any more."""
    for df in settled:
        path = getattr(df, "_settled_at", None)
        if path:
            remove_folder(df.sparkSession, path)


#: Bounds of what may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the size of a row in memory."""
    total = F.lit(16)
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif "<" in kind:
            total = total + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 32
        else:
            total = total + 8
    return total.cast("bigint")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of ``max_bytes`` together; reads no more rows than needed to tell."""
    n, size = df.select(_row_bytes(df).alias("size")).limit(max_rows + 1).agg(F.count("*"), F.sum("size")).first()
    return n <= max_rows and (size or 0) <= max_bytes


def rows_within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than needed to tell."""
    return df.select(F.lit(1).alias("one")).limit(bound + 1).count() <= bound


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, salts: int = 16, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is usually small. Up to ``max_rows`` rows and ``max_bytes`` it is broadcast; beyond either the join is
    shuffled with the right side copied to ``salts`` salts, so that a hot key of the left side is spread.
    ``how`` is inner, left or left_semi. ``right`` is evaluated twice: settle it first if it is costly."""
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    spread = left.withColumn(salt, spread_salt(salts))
    copies = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies, [*on, salt], how).drop(salt)


def join_skewed(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot_rows: int = 100_000, salts: int = 16, hot: DataFrame | None = None) -> DataFrame:
    """Join on one key that some rows of ``left`` may share by the million. Keys with more than ``hot_rows`` rows on the left are
    salted there and copied on the right; all others are joined plainly. ``hot``: those keys, where they are known."""
    if hot is None:
        hot = left.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    hot = hot.filter(F.col(on).isNotNull()).select(on, F.lit(True).alias("__hot"))
    if rows_within(hot, 0):
        return left.join(right, on, how)
    hot = settle(hot, "hot_keys")
    salt, none = "__salt", F.lit(0)
    spread = join_small(left, hot, [on], "left").withColumn(salt, F.when(F.col("__hot"), spread_salt(salts)).otherwise(none)).drop("__hot")
    copies = join_small(right, hot, [on], "left").withColumn(salt, F.explode(F.when(F.col("__hot"), F.array(*[F.lit(i) for i in range(salts)])).otherwise(F.array(none)))).drop("__hot")
    return spread.join(copies, [on, salt], how).drop(salt)


def spread_salt(salts: int) -> Column:
    """A salt from the row's place, the same again when a task is repeated."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
