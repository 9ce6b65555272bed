"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose the data and the cores. Every
query is run to completion through the noop sink. Rows per second refer to the matrix it reads.

``shape`` holds one sketch at the shape of the published numbers: BENCH_SHAPE_ROWS (10,000) x 3,072
pixels-like values drawn from the line ids, l = 200, in 1, 4 and 8 tasks with one BLAS thread each.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallgram.layouts import list_array  # noqa: E402
from tallgram.operators.kernels import Spec  # noqa: E402
from tallgram.operators.sketch import sketch  # noqa: E402
from tallgram.session import get_session, map_arrow, stored  # noqa: E402
from tallgram.workload import QUERIES  # noqa: E402

HEADLINE = {
    "fd": "embeddings", "fast_fd": "embeddings", "fd_median": "embeddings", "batch_fd": "embeddings",
    "batch_pfd": "embeddings", "pfd": "embeddings", "rand_batch_pfd": "embeddings",
    "tweak_pfd_fast": "embeddings", "dynamic_fd": "embeddings", "update_sketch": "embeddings",
    "batch_fd_lines": "lineitem", "batch_pfd_lines": "lineitem", "parallel_batch_pfd": "lineitem",
    "sketch_keyed": "lineitem", "sparse_batch_pfd": "events", "sparse_rand_batch_pfd": "events",
    "sparse_parallel_batch_pfd": "events", "cw_sparse": "embeddings", "cw_sparse_lines": "lineitem",
    "cw_sparse_entries": "events", "jlt_gaussian": "embeddings", "jlt_gaussian_sparse": "events",
    "gram": "embeddings", "gram_sparse": "events", "thin_svd": "embeddings", "randomized_svd": "embeddings",
    "cov_error": "embeddings", "projection_error": "embeddings", "sq_frobenius": "lineitem",
    "matmul": "events", "matmul_small": "embeddings", "nearest_centroid": "embeddings",
    "kmeans_train": "embeddings", "kmeans_warm_start": "embeddings", "kmeans_on_sketch": "embeddings",
    "sweep_sketch_compare": "embeddings", "sweep_alpha": "embeddings", "sweep_changepoint": "embeddings",
    "sweep_rand_vs_exact": "embeddings", "sweep_tweak_vs_batch": "embeddings",
    "object_api": "embeddings", "dynamic_fd_keyed": "embeddings",
    "read_dense_text": "embeddings", "read_matrix_market": "events", "stream_sketch": "embeddings",
}


WIDTH = 3072


def shape_seconds(spark, sf: str) -> dict[str, float]:
    """Seconds of one sketch of a generated matrix, by number of tasks."""
    n = int(os.environ.get("BENCH_SHAPE_ROWS", "10000"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.xxhash64("l_orderkey", "l_linenumber", "l_shipdate").alias("seed"))

    def draw(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                seeds = batch.column(0).slice(start, 512).to_numpy()
                block = np.array([np.random.default_rng(abs(int(x))).integers(0, 256, WIDTH) for x in seeds], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), list_array(block)], ["row_id", "vec"])

    made = map_arrow(lines.orderBy("seed").limit(n).repartition(8), draw, "row_id bigint, vec array<double>")
    matrix = stored(made.select("row_id", F.col("vec").cast("array<float>").alias("vec")), "shape")
    spec, seconds = Spec("batch_pfd", 200, b=200, alpha=0.2), {}
    for tasks in (1, 4, 8):
        started = time.perf_counter()
        sketch(matrix, spec, tasks=tasks).write.format("noop").mode("overwrite").save()
        seconds[f"batch_pfd {n} x {WIDTH} l=200, {tasks} tasks"] = round(time.perf_counter() - started, 3)
    return seconds


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = get_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in {"embeddings", "lineitem", "events"}}
    QUERIES["batch_pfd"](spark, sf).collect()  # starts the Python workers
    seconds, rate = {}, {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if name in HEADLINE:
            rate[name] = round(rows[HEADLINE[name]] / seconds[name])
    shape = {} if sys.argv[1:] else shape_seconds(spark, sf)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rate,
                "shape": shape,
                "cores": cpus,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
