"""Streaming queries: the tables as bounded streams, processed to the end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.errors import score
from ..operators.kernels import Spec
from ..operators.sketch import realised_size, sketch
from ..session import stored, work_path
from ..streaming import (
    current_state, rocksdb_states, run_available, stream_count_sketch, stream_sketch, stream_sketch_keyed,
    stream_sketch_sessions, stream_sketch_windowed, stream_sketches,
)
from .registry import EMB_MASS, EMB, query, rounded, sql_rounded, table
from .sketches import _cw_sql


def _stream(spark, sf, name):
    """The table as a file stream; the bracket makes the path a pattern, which fits one file as well
    as a folder of parts."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _rows(stream):
    return stream.select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<float>").alias("vec"), "label"
    )


def _scored(states, rows, digits: int = 4, key=None):
    """States with their mass and whether they keep what their kind promises, against exact Gram matrices
    of the same rows read as a batch; an empty sketch doesn't."""
    scored = score(states, sketch(rows, Spec("gram"), key=key))
    fits = F.col("certified") & (F.col("abs_err") <= F.col("delta") + 1e-9 * F.col("sq_norm"))
    return scored.select("key", "l", "n_rows", rounded(F.col("sketch_mass") + F.col("mass_lost"), digits).alias("mass"), fits.alias("fits"))


@query("stream_sketch", f"SELECT CAST(16 AS INTEGER) AS l, (SELECT count(*) FROM embeddings) AS n_rows, {sql_rounded('s', 4)} AS mass, true AS fits FROM {EMB_MASS}")
def stream_sketch_query(spark, sf):
    path = work_path(spark, "stream")
    writer = stream_sketch(_rows(_stream(spark, sf, "embeddings")), Spec("batch_pfd", 16, b=40, alpha=0.2), path + "/state")
    run_available(writer, path + "/checkpoint")
    return _scored(current_state(spark, path + "/state"), _rows(table(spark, sf, "embeddings"))).drop("key")


@query("stream_dynamic_fd", f"SELECT CAST(24 AS INTEGER) AS l, (SELECT count(*) FROM embeddings) AS n_rows, {sql_rounded('s', 4)} AS mass, true AS fits, true AS l_hat_between FROM {EMB_MASS}")
def stream_dynamic_fd(spark, sf):
    """The size grows from 16 to 24 after the second micro-batch."""
    path = work_path(spark, "stream")
    source = table(spark, sf, "embeddings")
    source.repartition(4, "vec_id").write.parquet(path + "/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path + "/in")
    writer = stream_sketch(
        _rows(stream), Spec("batch_fd", 16, b=40), path + "/state", schedule=lambda n: 16 if n < 2 else 24
    )
    run_available(writer, path + "/checkpoint")
    state = stored(current_state(spark, path + "/state"), "state").withColumn("kind", F.lit("dynamic_fd"))
    between = realised_size(state, 16, 24).select("l", F.col("l_hat").between(16, 24).alias("l_hat_between"))
    return _scored(state, _rows(source)).drop("key").join(between, "l")


def _collected(spark, frame, mode: str):
    """Run a streaming result into Parquet and read it back (``append``), or into the state of the
    last batch (``complete``/``update``) through the batch sink."""
    path = work_path(spark, "stream")
    if mode == "append":
        writer = frame.writeStream.format("parquet").option("path", path + "/out").outputMode("append")
        run_available(writer, path + "/checkpoint")
        return spark.read.schema(frame.schema).parquet(path + "/out")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/out/batch={batch_id}"
        )

    run_available(frame.writeStream.outputMode(mode).foreachBatch(keep), path + "/checkpoint")
    return spark.read.option("basePath", path + "/out").parquet(path + "/out")


@query(
    "stream_sketch_keyed",
    f"SELECT CAST(label AS VARCHAR) AS key, count(DISTINCT i) AS n_rows, {sql_rounded('sum(v * v)', 4)} AS mass, true AS fits FROM {EMB} GROUP BY label",
)
def stream_sketch_keyed_query(spark, sf):
    rows = _rows(_stream(spark, sf, "embeddings"))
    states = _collected(spark, stream_sketch_keyed(rows, "label", Spec("batch_fd", 16, b=16)), "update")
    return _scored(_latest(states), _rows(table(spark, sf, "embeddings")), key="label").drop("l")


def _latest(states):
    """The last state that was emitted for each key."""
    columns = [c for c in states.columns if c not in ("key", "batch")]
    last = F.max_by(F.struct(*columns), F.struct("n_rows", "batch"))
    return states.groupBy("key").agg(last.alias("s")).select("key", "s.*")


@query(
    "stream_sketch_resumed",
    f"SELECT CAST(label AS VARCHAR) AS key, CAST(16 AS INTEGER) AS l, count(DISTINCT i) AS n_rows, {sql_rounded('sum(v * v)', 4)} AS mass, true AS fits FROM {EMB} GROUP BY label",
)
def stream_sketch_resumed(spark, sf):
    """A batch over every other row, and a stream that starts from its sketches and reads the rest."""
    spec = Spec("batch_fd", 16, b=16)
    source = table(spark, sf, "embeddings")
    before = stored(sketch(_rows(source.filter("vec_id % 2 = 0")), spec, key="label", strict=False), "first-half")
    rest = _rows(_stream(spark, sf, "embeddings").filter("vec_id % 2 = 1"))
    with rocksdb_states(spark):
        states = _collected(spark, stream_sketches(rest, "label", spec, initial=before), "update")
    return _scored(_latest(states), _rows(source), key="label")


@query(
    "stream_dynamic_keyed",
    f"SELECT CAST(label AS VARCHAR) AS key, CAST(CASE WHEN label IN (1, 2) THEN 24 ELSE 16 END AS INTEGER) AS l, count(DISTINCT i) AS n_rows, "
    f"{sql_rounded('sum(v * v)', 4)} AS mass, true AS fits, true AS l_hat_fits FROM {EMB} GROUP BY label",
)
def stream_dynamic_keyed(spark, sf):
    """A control table as a second stream: the sketch of one key grows with the second micro-batch, that of
    another with the third."""
    path = work_path(spark, "stream")
    source = table(spark, sf, "embeddings")
    source.repartition(4, "vec_id").write.parquet(path + "/in")
    schema = "key string, l int"
    for batch, rows in enumerate(([], [("1", 24)], [("2", 24), ("1", 20)], [])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path + "/control")
    stream = _rows(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path + "/in"))
    control = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path + "/control")
    with rocksdb_states(spark):
        grown = stream_sketches(stream, "label", Spec("batch_fd", 16, b=16), control=control, largest=24)
        states = _latest(_collected(spark, grown, "update"))
    fits = F.when(F.col("l") == 24, F.col("l_hat").between(16, 24)).otherwise(F.abs(F.col("l_hat") - 16) < 1e-9)
    sizes = states.select("key", fits.alias("l_hat_fits"))
    return _scored(states.drop("l_hat"), _rows(source), key="label").join(sizes, "key")


@query(
    "stream_sketch_windowed",
    f"""
SELECT CAST(epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) AS VARCHAR) AS key, count(*) AS n_rows,
 {sql_rounded('sum(1 + value / 10 * value / 10)', 6)} AS mass, true AS fits FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY < (SELECT max(date_trunc('day', ts)) - INTERVAL 1 HOUR FROM events) GROUP BY ALL
""",
)
def stream_sketch_windowed_query(spark, sf):
    """Daily windows, emitted once the watermark (a day and an hour behind the latest window's end)
    has passed them."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")

    def rows(events):
        return events.select(
            F.col("event_id").alias("row_id"), F.array(F.lit(1.0), F.col("value") / 10).alias("vec"),
            F.timestamp_micros(micros).alias("ts"),
        )

    panes = stream_sketch_windowed(rows(_stream(spark, sf, "events")), "ts", "1 day", "1 hour", Spec("batch_fd", 2, b=50))
    states = _collected(spark, panes, "append")
    days = rows(table(spark, sf, "events")).withColumn("day", F.unix_millis(F.window("ts", "1 day").end))
    return _scored(states, days, 6, key="day").drop("l")


_GAP = 12 * 3600 * 1_000_000
_SESSIONS = f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < {_GAP} THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nr FROM f)
SELECT user_id || '@' || min(us) AS key, max(us) AS last_us, count(*) AS n_rows, {sql_rounded('sum(1 + value / 10 * value / 10)', 6)} AS mass, true AS fits
FROM s GROUP BY user_id, nr HAVING max(us) + 2 * {_GAP} < (SELECT (max(us) // {_GAP} + 1) * {_GAP} - 3600000000 - {_GAP} FROM e)
"""


@query("stream_sketch_sessions", _SESSIONS)
def stream_sketch_sessions_query(spark, sf):
    """Sessions of each user, ended by twelve hours without an event, that no later row can join."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")

    def rows(events):
        return events.select(
            F.col("event_id").alias("row_id"), F.array(F.lit(1.0), F.col("value") / 10).alias("vec"), "user_id",
            F.timestamp_micros(micros).alias("ts"),
        )

    with rocksdb_states(spark):
        sessions = stream_sketch_sessions(rows(_stream(spark, sf, "events")), "user_id", "ts", "12 hours", "1 hour", Spec("batch_fd", 2, b=50))
        states = stored(_collected(spark, sessions, "append"), "sessions")
    named = states.withColumn("key", F.concat_ws("@", "key", F.unix_micros("session_start")))
    by_user = Window.partitionBy("user_id").orderBy("us")
    since = F.col("us") - F.lag("us").over(by_user)
    exact = rows(table(spark, sf, "events")).withColumn("us", F.unix_micros("ts")).withColumn("fresh", F.when(since < _GAP, None).otherwise(F.col("us")))
    exact = exact.withColumn("session", F.concat_ws("@", "user_id", F.last("fresh", True).over(by_user)))
    scored = _scored(named.drop("session_start", "session_end"), exact, 6, key="session").drop("l")
    return scored.join(named.select("key", F.unix_micros("session_end").alias("last_us")), "key")


@query("stream_cw", _cw_sql(EMB, 16))
def stream_cw(spark, sf):
    rows = _rows(_stream(spark, sf, "embeddings")).select("row_id", F.col("vec").cast("array<double>").alias("vec"))
    totals = _collected(spark, stream_count_sketch(rows, 16), "complete")
    last = totals.agg(F.max("batch")).scalar()
    return totals.filter(F.col("batch") == last).select("i", "j", rounded("v").alias("v"))
