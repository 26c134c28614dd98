"""Intermediate tables in the folder all executors share, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 48 << 20

_written: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is configured and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomrec-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def stow(df: DataFrame, *, compression: str = "zstd", buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return a reader of it.

    The plan behind the result is a file scan: its lineage is cut, it is computed once however often it is read, and losing
    an executor loses nothing.  With ``buckets`` (a number and a column) the table is bucketed, so that grouping or joining it by
    that column needs no shuffle of it.  Folders are deleted when the driver's process ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stow-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    name = f"loomrec_{uuid.uuid4().hex}" if buckets else None
    _written.append((spark, path, name))  # before the write, so that what a failed one leaves is deleted too
    if buckets:
        writer.format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(name)
        out = spark.table(name)
        out._stowed_as = name
    else:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._stowed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stowed table that nothing reads any more; no effect on other DataFrames."""
    path = getattr(df, "_stowed_at", None)
    if path:
        if hasattr(df, "_stowed_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._stowed_as}")
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path, name in _written:
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def small_enough(rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if a table of ``rows`` counted rows may be broadcast."""
    return rows * bytes_per_row <= limit


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it; otherwise unchanged, and the join shuffles."""
    return F.broadcast(df) if small_enough(rows, bytes_per_row, limit) else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` placed by ``columns`` in exactly ``spark.sql.shuffle.partitions`` partitions.

    For work that is heavy for its bytes: small partitions of it must not be merged into few tasks afterwards.  A grouping by the
    same columns needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
