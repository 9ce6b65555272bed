"""Query registry, table access and SQL fragments shared by the workload modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import FOURWISE, HIGH, MIX_COL, MIX_ROW, PAIRWISE, PRIME
from ..layouts import rows_to_entries
from ..sources import matrix_from_columns, matrix_from_vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str, element: str = "double") -> DataFrame:
    return matrix_from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", element)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def line_id() -> F.Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def line_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Four columns of lineitem brought to similar magnitude."""
    cells = [
        F.col("l_quantity") / 50,
        F.col("l_extendedprice") / 100000,
        F.col("l_discount") * 10,
        F.col("l_tax") * 10,
    ]
    return matrix_from_columns(table(spark, sf, "lineitem"), line_id(), cells)


def account_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse matrix user x hour of the month, summed event values."""
    events = table(spark, sf, "events")
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    return (
        events.groupBy(F.col("user_id").alias("i"), hour.cast("int").alias("j"))
        .agg(F.sum("value").alias("v"))
        .select("i", "j", "v")
    )


HOURS = 744


def rounded(column, digits: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def cells(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Every element of a row-layout matrix: i, j, v."""
    return rows_to_entries(rows, keep_zeros=True).select("i", "j", rounded("v", digits).alias("v"))


def entries_out(entries: DataFrame, digits: int = 6) -> DataFrame:
    return entries.select("i", "j", rounded("v", digits).alias("v"))


# SQL fragments -------------------------------------------------------------------------------

EMB = (
    "(SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, "
    "CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"
)
LINES = (
    "(SELECT l_orderkey * 8 + l_linenumber AS i, l_quantity / 50 AS c0, l_extendedprice / 100000 AS c1, "
    "l_discount * 10 AS c2, l_tax * 10 AS c3 FROM lineitem)"
)
ACCOUNTS = (
    "(SELECT user_id AS i, CAST((day(ts) - 1) * 24 + hour(ts) AS INTEGER) AS j, sum(value) AS v "
    "FROM events GROUP BY ALL)"
)
EMB_MASS = "(SELECT sum(v * v) AS s FROM " + EMB + ")"
LINE_MASS = f"(SELECT sum(c0*c0 + c1*c1 + c2*c2 + c3*c3) AS s FROM {LINES})"
ACCOUNT_MASS = f"(SELECT sum(v * v) AS s FROM {ACCOUNTS})"


def sql_rounded(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def sql_cells(source: str, digits: int = 6) -> str:
    return f"SELECT i, j, {sql_rounded('v', digits)} AS v FROM {source}"


def sql_residue(x: str) -> str:
    low = f"((CAST({x} AS BIGINT) % {PRIME} + {PRIME}) % {PRIME})"
    high = f"(((CAST({x} AS BIGINT) - {low}) // {PRIME} % {PRIME} + {PRIME}) % {PRIME})"
    return f"(({low} + {high} * {HIGH}) % {PRIME})"


def sql_quintic(t: str) -> str:
    return f"(((({t}*{t}) % {PRIME}) * (({t}*{t}) % {PRIME}) % {PRIME}) * {t} % {PRIME})"


def sql_mixed(i: str, j: str, seed: int) -> str:
    inner = sql_quintic(f"(({sql_residue(i)} * {MIX_ROW} + {seed}) % {PRIME})")
    return sql_quintic(f"(({inner} + {sql_residue(j)} * {MIX_COL} % {PRIME}) % {PRIME})")


def sql_uniform(i: str, j: str, seed: int = 0) -> str:
    return f"(({sql_mixed(i, j, seed)} + 0.5) / {PRIME}.0::DOUBLE)"


def sql_bucket(x: str, buckets: int) -> str:
    a, b = PAIRWISE
    return f"(({sql_residue(x)} * {a} + {b}) % {PRIME} % {buckets})"


def sql_sign(x: str) -> str:
    r = sql_residue(x)
    h = str(FOURWISE[0])
    for c in FOURWISE[1:]:
        h = f"(({r} * {h} + {c}) % {PRIME})"
    return f"({h} % 2 * 2 - 1)"


def sql_gaussian(i: str, r: str, seed: int = 0) -> str:
    u1, u2 = sql_uniform(i, f"({r}*2)", seed), sql_uniform(i, f"({r}*2+1)", seed)
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"
