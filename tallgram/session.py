"""Session helper, shared working folder and size limits."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a small matrix (centres, singular vectors, one sketch) may take before it is refused;
#: ``spark.tallgram.matrix.bytes`` sets another limit.
SMALL_MATRIX_BYTES = 1 << 30

#: Whether the shuffle files of a job are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def get_session(app: str = "tallgram", cpus: str | int = "*", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tallgram-"))


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; callers own what they write there."""
    return f"{shared_dir(spark).rstrip('/')}/tallgram/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    Later jobs read the files, so a lost executor never forces the producing plan to run again, and what
    the plan shuffled goes once they are written.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a model-sized table, refused (not truncated) when there are more than ``limit``."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def matrix_budget() -> int:
    """The limit of the active session; the default where there is none, as in tasks."""
    spark = SparkSession.getActiveSession()
    return int(spark.conf.get("spark.tallgram.matrix.bytes", str(SMALL_MATRIX_BYTES))) if spark else SMALL_MATRIX_BYTES


def check_bytes(n_bytes: int, what: str, budget: int | None = None) -> None:
    budget = matrix_budget() if budget is None else budget
    if n_bytes > budget:
        raise ValueError(f"{what} needs {n_bytes} bytes, over the budget of {budget}")


#: Bytes a lookup table may take to be broadcast; beyond it the join shuffles both sides.
#: ``spark.tallgram.broadcast.bytes`` sets another limit.
BROADCAST_BYTES = 64 << 20


def _column_bytes(name: str, kind: T.DataType) -> F.Column:
    """Bytes one value takes in a row, about 8 for a scalar."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        width = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.greatest(F.size(name), F.lit(0)), F.lit(0)) * width + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return 2 * F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 24
    return F.lit(8)


def table_bytes(table: DataFrame) -> int:
    """Bytes of all rows as Spark holds them, summed where the rows are."""
    row = sum((_column_bytes(f"`{f.name}`", f.dataType) for f in table.schema.fields), F.lit(24))
    return int(table.agg(F.sum(row.cast("long"))).first()[0] or 0)


def fits_broadcast(table: DataFrame, limit: int | None = None) -> bool:
    if limit is None:
        limit = int(table.sparkSession.conf.get("spark.tallgram.broadcast.bytes", str(BROADCAST_BYTES)))
    return table_bytes(table) <= limit


def lookup(df: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """A lookup table written once and measured: with a broadcast hint if its rows take at most
    ``limit`` bytes, as it is (shuffled join, skew left to adaptive execution) if they take more."""
    table = stored(df, label)
    return F.broadcast(table) if fits_broadcast(table, limit) else table


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per application)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="tallgram-py-"), "tallgram")
        context.addPyFile(shutil.make_archive(base, "zip", root, "tallgram"))
        _shipped.add(context.applicationId)


def give_back_memory() -> None:
    """Return what a task has freed to the system, as idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package made importable on the executors; a task gives its memory back."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back_memory()

    run.__name__ = getattr(function, "__name__", "run")
    return df.mapInArrow(run, schema)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that this run wrote under the shared folder and that no plan reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def expected_partitions(df: DataFrame) -> int:
    """How many partitions the plan is likely to have, from its size; only a hint for the depth of
    merge trees, which are correct for any number."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    known = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return known if size >= 1 << 60 else max(known, -(-size // split))
