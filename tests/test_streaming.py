"""Streams processed to the end agree with the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgram.operators.kernels import Spec
from tallgram.operators.linear import count_sketch
from tallgram.streaming import (
    current_state, rocksdb_states, run_available, stream_count_sketch, stream_sketch, stream_sketch_keyed, stream_sketch_windowed,
    stream_sketches,
)
from tests.conftest import cov_err, dense_entries, sketch_of


@pytest.fixture
def feed(spark, rng, tmp_path):
    """300 rows in six files, read one file per micro-batch."""
    a = rng.standard_normal((300, 6))
    data = [(i, [float(x) for x in r], i % 3, 1_000_000 * 60 * i) for i, r in enumerate(a)]
    df = spark.createDataFrame(data, "row_id bigint, vec array<double>, k int, us bigint")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    for n in range(6):
        df.filter((F.col("row_id") >= 50 * n) & (F.col("row_id") < 50 * n + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return a, df, stream


def check(a, row):
    b = sketch_of(row)
    assert row["n_rows"] == len(a)
    assert (b**2).sum() + row["mass_lost"] == pytest.approx((a**2).sum())
    assert cov_err(a, b) <= row["delta"] + 1e-9 * (a**2).sum()


def test_running_sketch_and_replay(spark, feed, tmp_path):
    a, _, stream = feed
    path = str(tmp_path / "state")
    spec = Spec("batch_pfd", 4, b=6, alpha=0.5)
    run_available(stream_sketch(stream, spec, path), str(tmp_path / "c"))
    check(a, current_state(spark, path).first())
    # The same rows from batch 0 on: versions are overwritten, nothing is counted twice.
    run_available(stream_sketch(stream, spec, path), str(tmp_path / "c2"))
    check(a, current_state(spark, path).first())


def test_other_files_beside_the_state_stay(spark, feed, tmp_path):
    a, _, stream = feed
    (tmp_path / "state" / "sub").mkdir(parents=True)
    for name in ("note.txt", "sub/data.txt"):
        (tmp_path / "state" / name).write_text("not the stream's")
    run_available(stream_sketch(stream, Spec("batch_fd", 4, b=6), str(tmp_path / "state")), str(tmp_path / "c"))
    check(a, current_state(spark, str(tmp_path / "state")).first())
    assert all((tmp_path / "state" / name).read_text() == "not the stream's" for name in ("note.txt", "sub/data.txt"))


def collected(frame, checkpoint):
    """Rows by key of the last micro-batch that emitted the key, and all emitted rows in order."""
    seen, order = {}, []

    def keep(batch, batch_id):
        for r in batch.collect():
            seen[r["key"]] = r
            order.append((batch_id, r))

    run_available(frame.writeStream.outputMode("update").foreachBatch(keep), checkpoint)
    return seen, order


def test_keyed_sketches_go_on_from_stored_ones(spark, feed, tmp_path):
    from tallgram.operators.sketch import sketch

    a, df, stream = feed
    spec = Spec("batch_fd", 3, b=4)
    first = sketch(df.filter("row_id < 100 OR row_id % 3 = 2"), spec, key="k", strict=False).cache()
    with rocksdb_states(spark):
        rest = stream_sketches(stream.filter("row_id >= 100 AND row_id % 3 < 2"), "k", spec, initial=first)
        seen, _ = collected(rest, str(tmp_path / "c"))
    assert set(seen) == {"0", "1"}  # a key without further rows isn't emitted
    for k, row in seen.items():
        check(a[np.arange(300) % 3 == int(k)], row)
        assert row["l_hat"] == pytest.approx(3)


def test_control_rows_raise_sizes_one_key_at_a_time(spark, feed, tmp_path):
    a, _, stream = feed
    schema = "key string, l int"
    for rows in ([], [("0", 5)], [("9", 4)], [("1", 4), ("0", 2)], [], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "control"))
    control = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "control"))
    with rocksdb_states(spark):
        out = stream_sketches(stream, "k", Spec("batch_fd", 3, b=4), control=control, largest=5)
        seen, order = collected(out, str(tmp_path / "c"))
    sizes = {k: [r["l"] for _, r in order if r["key"] == k] for k in "012"}
    assert sizes == {"0": [3, 5, 5, 5, 5, 5], "1": [3, 3, 3, 4, 4, 4], "2": [3] * 6}  # sizes never shrink
    assert set(seen) == {"0", "1", "2"}
    for k, row in seen.items():
        check(a[np.arange(300) % 3 == int(k)], row)
        assert 3 <= row["l_hat"] <= row["l"] and (row["l_hat"] > 3) == (k != "2")


def test_empty_start(spark, feed, tmp_path):
    """A stream whose first batches hold no rows after the filter."""
    a, _, stream = feed
    path = str(tmp_path / "state")
    late = stream.filter(F.col("row_id") >= 120)
    run_available(stream_sketch(late, Spec("batch_fd", 3, b=6), path), str(tmp_path / "c"))
    check(a[120:], current_state(spark, path).first())


def test_growing_size(spark, feed, tmp_path):
    a, _, stream = feed
    path = str(tmp_path / "state")
    writer = stream_sketch(stream, Spec("batch_fd", 3, b=6), path, schedule=lambda n: 3 if n < 3 else 5)
    run_available(writer, str(tmp_path / "c"))
    row = current_state(spark, path).first()
    check(a, row)
    assert row["l"] == 5 and 0 < row["delta_first"] < row["delta"]


def test_keyed(spark, feed, tmp_path):
    a, _, stream = feed
    seen = {}

    def keep(batch, batch_id):
        seen.update({r["key"]: r for r in batch.collect()})

    out = stream_sketch_keyed(stream, "k", Spec("batch_fd", 3, b=4))
    run_available(out.writeStream.outputMode("update").foreachBatch(keep), str(tmp_path / "c"))
    assert set(seen) == {"0", "1", "2"}
    for k, row in seen.items():
        check(a[np.arange(300) % 3 == int(k)], row)


def test_windows(spark, feed, tmp_path):
    a, _, stream = feed
    out = stream_sketch_windowed(stream, "ts", "1 hour", "10 minutes", Spec("batch_fd", 3, b=4))
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
    run_available(writer, str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {int(r["key"]) // 3_600_000: r for r in rows}
    # 300 minutes of rows: the watermark lies 70 minutes behind the last window's end.
    assert sorted(got) == [1, 2, 3] and len(rows) == 3
    for hour, row in got.items():
        check(a[60 * (hour - 1) : 60 * hour], row)


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    """A row for a window that is already emitted neither reopens nor changes it."""
    minute = 60 * 1_000_000

    def write(name, rows):
        df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, us bigint")
        df = df.withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    out = lambda s: stream_sketch_windowed(s, "ts", "1 hour", "5 minutes", Spec("batch_fd", 2, b=3))

    def run(schema):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = out(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        run_available(writer, str(tmp_path / "c"))
        return sorted((int(r["key"]) // 3_600_000, r["n_rows"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    schema = write("a", [(n, [1.0, float(n)], 10 * n * minute) for n in range(13)])
    assert run(schema) == [(1, 6)]
    write("b", [(20, [1.0, 1.0], 3 * minute), (21, [1.0, 2.0], 200 * minute)])
    assert run(schema) == [(1, 6), (2, 6)]


def test_late_rows_of_open_windows_are_kept(spark, tmp_path):
    """Whatever micro-batch brings a row and whatever it was condensed with."""
    minute = 60 * 1_000_000
    batches = [[1, 41], [12], [45, 13], [200], [61, 300]]
    for n, minutes in enumerate(batches):
        df = spark.createDataFrame([(100 * n + k, [1.0, float(t)], t * minute) for k, t in enumerate(minutes)], "row_id bigint, vec array<double>, us bigint")
        df = df.withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1)
        df.write.parquet(str(tmp_path / f"in/b={n}"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
        panes = stream_sketch_windowed(stream, "ts", "1 hour", "5 minutes", Spec("batch_fd", 2, b=3))
        run_available(panes.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "c"))
    got = sorted((int(r["key"]) // 3_600_000, r["n_rows"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # minute 61 arrives when its window (closing at 120) lies behind the watermark of 175
    assert got == [(1, 5), (4, 1)]


def test_sliding_windows(spark, feed, tmp_path):
    a, _, stream = feed
    out = stream_sketch_windowed(stream, "ts", "1 hour", "10 minutes", Spec("batch_fd", 3, b=4), slide="30 minutes")
    run_available(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "c"))
    rows = {int(r["key"]) // 60_000: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(range(60, 211, 30)) <= set(rows)
    for end, row in rows.items():
        check(a[max(0, end - 60) : end], row)


def test_count_sketch_stream_equals_batch(spark, feed, tmp_path):
    a, df, stream = feed
    last = {}

    def keep(batch, batch_id):
        last["b"] = dense_entries(batch, (8, 6))

    writer = stream_count_sketch(stream, 8).writeStream.outputMode("complete").foreachBatch(keep)
    run_available(writer, str(tmp_path / "c"))
    np.testing.assert_allclose(last["b"], dense_entries(count_sketch(df, 8), (8, 6)), atol=1e-12)
