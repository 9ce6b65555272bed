"""Text formats: dense matrix files, Matrix Market coordinate files, word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lookup


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _numbers(line) -> F.Column:
    return F.transform(F.split(line, r"\s+"), lambda x: x.cast("double"))


def text_shape(spark: SparkSession, path) -> tuple[int, int] | None:
    """Shape announced by the ``# rows cols`` header line, if there is one."""
    header = (
        _lines(spark, path).filter(F.col("line").rlike(r"^#\s*\d+\s+\d+$")).select("line").take(1)
    )
    if not header:
        return None
    n, m = header[0].line.lstrip("#").split()
    return int(n), int(m)


def read_dense_text(spark: SparkSession, path, check_header: bool = False) -> DataFrame:
    """Dense rows from whitespace-separated lines; ``row_id`` is the line order.

    Numbering needs no global sort: every file split numbers its own lines, and the small table of
    lines per split, written once, gives each split its offset. It is broadcast if it is measured to
    be small; otherwise the lines of a split are joined with it.
    """
    lines = _lines(spark, path).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("seq").alias("first")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file",
        "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    rows = lines.join(lookup(offsets, "line-offsets"), ["file", "block"]).select(
        (F.col("seq") + F.col("shift")).alias("row_id"), _numbers(F.col("line")).alias("vec")
    )
    if check_header:
        announced = text_shape(spark, path)
        found = rows.agg(
            F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")
        ).first()
        if announced is not None and announced != (found.n, found.lo) or found.lo != found.hi:
            raise ValueError(f"header says {announced}, the file holds {tuple(found)}")
    return rows


def write_dense_text(rows: DataFrame, path: str, decimals: int = 4, ordered: bool = True) -> None:
    """Space-separated lines with fixed decimals, plus a header part ``# rows cols``.

    ``ordered`` sorts by ``row_id`` (a range-partitioned sort), so that reading the parts in name
    order gives the rows back in order.
    """
    spark = rows.sparkSession
    shape = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("m"))
    header = shape.select(F.format_string("# %d %d", "n", "m").alias("value"))
    body = rows.orderBy("row_id") if ordered else rows
    body.select(format_row(F.col("vec"), decimals).alias("value")).write.text(path)
    header.write.mode("append").text(path)


def format_row(vec, decimals: int = 4):
    return F.concat_ws(" ", F.transform(vec, lambda x: F.format_string(f"%.{decimals}f", x)))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Entries (zero-based) of a Matrix Market coordinate file or of a folder of its parts.

    The banner and the size line are looked up in the part that starts with ``%%``; a symmetric or
    skew-symmetric matrix gets its mirrored off-diagonal half.
    """
    lines = _lines(spark, path).withColumn("seq", F.monotonically_increasing_id())
    banner = lines.filter(F.col("line").startswith("%%MatrixMarket")).first()
    if banner is None:
        raise ValueError(f"no Matrix Market banner in {path}")
    kind = banner.line.lower().split()
    if kind[2] != "coordinate" or kind[3] not in ("real", "integer", "pattern"):
        raise ValueError(f"unsupported Matrix Market kind: {banner.line}")
    head = (F.col("file") == banner.file) & (F.col("block") == banner.block)
    data = (F.col("line") != "") & ~F.col("line").startswith("%")
    size = lines.filter(head & data).orderBy("seq").first()
    tokens = F.split("line", r"\s+")
    value = F.lit(1.0) if kind[3] == "pattern" else tokens[2].cast("double")
    entries = lines.filter(data & ~(head & (F.col("seq") == size.seq))).select(
        (tokens[0].cast("bigint") - 1).alias("i"),
        (tokens[1].cast("int") - 1).alias("j"),
        value.alias("v"),
    )
    if kind[4] == "general":
        return entries
    sign = -1.0 if kind[4] == "skew-symmetric" else 1.0
    mirrored = entries.filter("i <> j").select(
        F.col("j").cast("bigint").alias("i"), F.col("i").cast("int").alias("j"), (F.col("v") * sign).alias("v")
    )
    return entries.unionByName(mirrored)


def read_word_vectors(spark: SparkSession, path) -> DataFrame:
    """word STRING, vec ARRAY<DOUBLE> from the text form; the ``count dim`` line is dropped."""
    tokens = _lines(spark, path).select(F.split("line", r"\s+").alias("t"))
    return tokens.filter(F.size("t") > 2).select(
        F.col("t")[0].alias("word"),
        F.transform(F.expr("slice(t, 2, size(t) - 1)"), lambda x: x.cast("double")).alias("vec"),
    )


def stack_batches(batches: list[DataFrame]) -> DataFrame:
    """One tall matrix from several; ids follow (batch, row_id) without gaps between batches.
    The broadcast offsets hold one row per element of ``batches``."""
    out = None
    for number, batch in enumerate(batches):
        part = batch.select(F.lit(number).alias("batch"), "row_id", "vec")
        out = part if out is None else out.unionByName(part)
    sizes = out.groupBy("batch").agg((F.max("row_id") + 1).alias("n"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("batch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return out.join(F.broadcast(offsets), "batch").select(
        "batch", (F.col("start") + F.col("row_id")).alias("row_id"), "vec"
    )
