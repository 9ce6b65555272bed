"""Linear sketches: sparse sign embedding (CountSketch) and Gaussian projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fourwise_sign, pairwise_bucket, random_bucket, random_sign, required
from .kernels import Spec
from .sketch import sketch, state_entries


def count_sketch(matrix: DataFrame, l: int, hashing: str = "pairwise", seed: int = 0) -> DataFrame:
    """Row k, times its sign, is added to row h(k) of an l-row sketch; entry layout out.

    Row or entry layout in. A single aggregation with map-side combine: each task sends at most
    l x m partial sums whatever it reads, so a hot row or bucket costs nothing extra.
    """
    dense = "vec" in matrix.columns
    k = F.col("row_id" if dense else "i")
    if hashing == "pairwise":
        bucket, sign = pairwise_bucket(k, l), fourwise_sign(k)
    elif hashing == "random":
        bucket, sign = random_bucket(k, l, seed), random_sign(k, seed)
    else:
        raise ValueError(f"unknown hashing {hashing!r}")
    cells = [F.posexplode(required(F.col("vec"), "vector")).alias("j", "v")] if dense else ["j", "v"]
    terms = matrix.select(bucket.alias("i"), sign.cast("double").alias("sign"), *cells)
    return terms.groupBy("i", "j").agg(F.sum(F.col("sign") * required(F.col("v"))).alias("v"))


def gaussian_sketch(matrix: DataFrame, l: int, m: int | None = None, seed: int = 0) -> DataFrame:
    """S A with S ~ N(0, 1/l) drawn by hash of (row, sketch row); entry layout out."""
    return state_entries(sketch(matrix, Spec("jlt", l, seed=seed), m=m)).select("i", "j", "v")
