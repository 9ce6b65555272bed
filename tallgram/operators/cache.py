"""Spectra kept under a fingerprint of the matrix they belong to."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path
from .spectra import thin_svd

SPECTRUM = "k int, sigma double, v array<double>"


def fingerprint(matrix: DataFrame) -> str:
    """Hexadecimal digest of the rows of a matrix, whatever their order, partitions and files.

    Each row has two 64-bit hashes; their sums, and the number of rows, don't depend on order and count
    repeated rows. One aggregation with map-side combine.
    """
    columns = sorted(c for c in matrix.columns if c in ("row_id", "vec", "idx", "val", "i", "j", "v"))
    hashes = [F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)") for salt in (1, 2)]
    row = matrix.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias(f"h{k}") for k, h in enumerate(hashes))).first()
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in sorted(matrix.schema.fields, key=lambda f: f.name) if f.name in columns]
    return hashlib.sha256("|".join([*kinds, *(str(x) for x in row)]).encode()).hexdigest()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def cached_spectrum(matrix: DataFrame, folder: str, m: int | None = None, method: str = "gram") -> tuple[DataFrame, bool]:
    """(k, sigma, v) of ``thin_svd``, and whether it was found under ``folder``.

    An entry belongs to the fingerprint of the matrix, so a changed, added or missing row is a miss. It is
    written beside its place and moved there by one rename when it is complete; readers never see part
    of it, and of two writers either one's is right.
    """
    spark = matrix.sparkSession
    place = f"{folder.rstrip('/')}/spectrum-{method}-{m or 'all'}-{fingerprint(matrix)}"
    system, target = _file_system(spark, place)
    hit = system.exists(target)
    if not hit:
        draft = f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}"
        thin_svd(matrix, m, method).write.parquet(draft)
        _, source = _file_system(spark, draft)
        if system.exists(target) or not system.rename(source, target):
            delete_path(spark, draft)
    return spark.read.schema(SPECTRUM).parquet(place), hit
