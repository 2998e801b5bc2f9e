"""Session helpers: building one, spreading small scans, cutting lineage, size checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Nothing above this size is ever broadcast.
BROADCAST_BYTES = 256 * 1024 * 1024


def build_session(app: str = "wordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` keys use '__' for '.'."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # groups that are collected are bounded (one document), so more of them fit the hash
        # map before an aggregation falls back to sorting
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of `df`: file sizes for tables, an upper guess for
    derived ones."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a table by `keys` if it is smaller than one scan split per slot of the
    cluster (few files, or files of one row group), so that all slots get work.  A larger
    scan is parallel already and is left alone: no shuffle is added to it.

    Apply it to the scan, before joins."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return df.repartition(slots, *keys) if table_bytes(df) < slots * split else df


def fits_broadcast(side: DataFrame, rows: int | None, row_bytes: int) -> bool:
    """May `side` be broadcast?  Yes if its bound of `rows` rows of about `row_bytes` bytes
    fits the budget; without a bound its rows are counted, up to one more than fit."""
    if rows is None:
        most = max(0, BROADCAST_BYTES // row_bytes)
        rows = side.limit(most + 1).count() if most else 1
    return rows * row_bytes <= BROADCAST_BYTES


def bounded_join(
    big: DataFrame,
    side: DataFrame,
    on: str | list[str],
    rows: int | None,
    row_bytes: int,
    how: str = "left",
) -> DataFrame:
    """Join `big` to a lookup table with one row per key.

    `rows` is the proven row bound of the lookup table, or its counted size.  A table within
    the broadcast budget travels and `big` stays where it is.  Otherwise both sides are
    shuffled and merged, which spills; the adaptive planner splits the partitions of hot keys."""
    if fits_broadcast(side, rows, row_bytes):
        return big.join(F.broadcast(side), on, how)
    return big.join(side.hint("merge"), on, how)


def ranked_join(big: DataFrame, side: DataFrame, on: str, rows: int | None, row_bytes: int, how: str = "left") -> DataFrame:
    """`bounded_join` to a table whose keys are ranks by frequency, from 0.

    Beyond the broadcast budget the ranks that fit it still travel, and with them the frequent
    keys; only rows of the others are shuffled.  A key with a third of all rows stays where it is."""
    if fits_broadcast(side, rows, row_bytes):
        return big.join(F.broadcast(side), on, how)
    most = max(0, BROADCAST_BYTES // row_bytes)
    often = F.col(on) < most
    near = big.where(often | F.col(on).isNull()).join(F.broadcast(side.where(often)), on, how)
    far = big.where(~often).join(side.where(~often).hint("merge"), on, how)
    return near.unionByName(far)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder of `spark.checkpoint.dir`.  Only a local master may
    fall back to a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="wordloom-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/wordloom-{uuid.uuid4().hex}"


_writing, _writing_lock = [0], threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end meanwhile go at once, not when the driver happens to
    collect its garbage.  Writers in several threads share the setting; the last one takes it back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _writing_lock:
        if not _writing[0]:
            _writing[1:] = [spark.conf.get(name, "false")]
        _writing[0] += 1
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _writing_lock:
            _writing[0] -= 1
            if not _writing[0]:
                spark.conf.set(name, _writing[1])


@contextmanager
def garbage_collected(spark: SparkSession, seconds: float = 15) -> Iterator[None]:
    """For a call that runs many jobs of its own: the shuffle files of those that are over go only when the
    driver collects its garbage, which it does meanwhile every so many seconds, and at the end."""
    over, collect = threading.Event(), spark.sparkContext._jvm.System.gc

    def run() -> None:
        while not over.wait(seconds):
            collect()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        collect()


def written(df: DataFrame, *folders: str) -> DataFrame:
    """`df` as a table written once in the shared folder, split into folders by the columns
    `folders`.

    Cuts the lineage: whatever reads it again, or again after an executor was lost, starts
    from the files, so the shuffle files behind it go.  Spark also knows the size of what it reads back."""
    path = shared_path(df.sparkSession)
    writer = df.write.partitionBy(*folders) if folders else df.write
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._wordloom_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` made and that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._wordloom_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one, that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
