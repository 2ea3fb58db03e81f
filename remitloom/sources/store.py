"""Writing results, and staging data that several readers share.

Plain parquet has no MERGE: a changed table is written to a new path, and the
caller switches to it.  Rated details are partitioned by run, because nearly
every reader asks for one run.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a session of one local process without that setting gets a folder of its own.
    """
    one_process = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None
    folder = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() if one_process else None)
    if folder:
        return folder
    if not one_process:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="remitloom-")


_folders: dict[str, str] = {}


def release(spark: SparkSession) -> None:
    """Remove what this application has frozen or staged; results that still read it end with it."""
    app = spark.sparkContext.applicationId
    if app in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(app))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _staged if k[0] == app]:
        del _staged[key]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(spark)}/remitloom/{app}"
    return f"{_folders[app]}/{label}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What a write in here has shuffled leaves the disk as soon as it is written.

    Otherwise it stays until the driver happens to collect its garbage, and the
    jobs that write the stored tables add up on disk.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


def freeze(df: DataFrame, label: str = "frozen") -> DataFrame:
    """Write a result once to the shared folder and go on from there.

    Used where two readers need the same rows: it cuts the lineage, survives
    the loss of executors and, being columnar, lets each reader scan only the
    columns it uses.
    """
    path = scratch(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_staged: dict[tuple[str, str, str], tuple[str, object]] = {}


def staged(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame],
           partition_by: str | None = None) -> DataFrame:
    """A derived table, written once per application and then read from the shared folder.

    Readers get partition pruning and column pruning instead of the whole
    derivation.  The first call runs the job; later calls are plain scans.
    """
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _staged:
        path = scratch(spark, name)
        df = build()
        with shuffles_freed(spark):
            save(df, path, partition_by)
        _staged[key] = (path, df.schema)
    path, schema = _staged[key]
    return spark.read.schema(schema).parquet(path)


def save(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    """Write a table, optionally partitioned by one column.

    ``REBALANCE`` lets adaptive execution bring the rows of one partition value
    together, merge small values and split one that holds a large part of the
    table over several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of; the files of all others stay as they are.

    ``df`` may read from ``path``.  A partition that is to end empty has no rows here: drop it.
    """
    df.hint("rebalance", partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def drop_partition(spark: SparkSession, path: str, partition_by: str, value) -> bool:
    """Remove one partition of a stored table; false if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_by}={value}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def apply(rows: DataFrame, emptied: DataFrame, path: str, partition_by: str) -> None:
    """Write the changed partitions of a stored table and remove those left empty; no other file is touched.

    Both are frozen first, as they read the table that changes.  What the driver
    sees is one value for each partition left empty.
    """
    rows, emptied = freeze(rows, "changes"), freeze(emptied, "emptied")
    replace_partitions(rows, path, partition_by)
    for row in emptied.select(partition_by).collect():
        drop_partition(rows.sparkSession, path, partition_by, row[0])


def append_batch(df: DataFrame, path: str, batch: str, partition_by: str | None = None) -> None:
    """Add the rows of a named batch; writing the batch again replaces them.

    A batch is a folder of its own (``batch=…``, a column of the table), so a
    job that is repeated after a failure leaves no row twice and no row of the
    failed attempt, whatever partitions that one had written.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    save(df, f"{path}/batch={batch}", partition_by, mode="overwrite")


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Add rows to a stored table."""
    save(df, path, partition_by, mode="append")


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int,
                  mode: str = "errorifexists", path: str | None = None) -> None:
    """Store a large fact bucketed by its join key, so later joins on it need no shuffle.

    The rows are dealt by key first: a bucket is then one file, whatever the
    number of tasks.  ``path`` puts the files elsewhere than in the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def staged_bucketed(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame], keys: list[str], buckets: int) -> DataFrame:
    """``staged`` as a bucketed table of the session catalog."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _staged:
        path = scratch(spark, name)
        table = f"remitloom_{name}_{uuid.uuid4().hex}"
        df = build()
        with shuffles_freed(spark):
            save_bucketed(df, table, keys, buckets, path=path)
        _staged[key] = (path, table)
    return spark.table(_staged[key][1])
