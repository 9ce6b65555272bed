"""Saved sketches and experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = (
    "exp string, dataset string, variant string, param_name string, param_value double, run int, "
    "l int, b int, alpha double, partitions int, time_s double, err double, proj_err double, "
    "l_bound double"
)


def save_sketches(states: DataFrame, path: str, dataset: str) -> None:
    """Write sketch states to the catalog at ``path``, laid out by (dataset, kind, l); what was saved
    for the same three before is replaced."""
    states.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("dataset", "kind", "l").parquet(path)


def load_sketches(
    spark: SparkSession, path: str, dataset: str | None = None, kind: str | None = None, l: int | None = None
) -> DataFrame:
    """Saved states; the filters prune catalog folders."""
    found = spark.read.parquet(path)
    for column, wanted in (("dataset", dataset), ("kind", kind), ("l", l)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    return found.withColumn("l", F.col("l").cast("int"))


def usable_sketches(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Which requested sketches can be reused.

    ``requests(dataset, kind, l, m, bound)`` against ``catalog(dataset, kind, l, m, err)``; ``bound``
    and ``err`` must be in the same unit. A request without a fitting entry gets ``valid = false``.
    """
    saved = catalog.select("dataset", "kind", "l", F.col("m").alias("saved_m"), "err")
    fits = (F.col("m") == F.col("saved_m")) & (F.col("err") < F.col("bound"))
    return requests.join(saved, ["dataset", "kind", "l"], "left").select(
        "dataset", "kind", "l", "m", "bound", "err", F.coalesce(fits, F.lit(False)).alias("valid")
    )


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)
