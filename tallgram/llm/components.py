"""Connected components of a table of links, by alternating star contraction.

Each round replaces the links by links towards the smallest neighbour, first for the larger and then
for the smaller ends, until every component is a star around its smallest id. Rounds are written to
the shared folder, so lineage stays short and a lost executor repeats one round at most. Smallest
neighbours are aggregated before the shuffle; the join back on a hot id has plain exchanges on both
sides, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, work_path


#: Links a task of a round takes on at most, about.
LINKS_PER_TASK = 500_000


def _write(df: DataFrame, label: str, tasks: int | None = None) -> tuple[DataFrame, str]:
    path = work_path(df.sparkSession, label)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _smallest(links: DataFrame, tasks: int) -> tuple[DataFrame, str]:
    """u and the least of u and its neighbours v."""
    return _write(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", tasks)


def _stars(edges: DataFrame, tasks: int) -> bool:
    """Every u has one v, and none of these has a smaller neighbour itself."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").coalesce(tasks).isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any order -> (id, component): every id in a link and the smallest id it reaches."""
    spark = links.sparkSession
    edges, path = _write(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"
    )
    tasks = 1 + edges.count() // LINKS_PER_TASK
    while not _stars(edges, tasks):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = _smallest(both, tasks)
        large, large_path = _write(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", tasks
        )
        down, down_path = _smallest(large, tasks)
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u > v")
            .distinct()
        )
        fresh, fresh_path = _write(small, "links", tasks)
        for old in (path, least_path, large_path, down_path):
            delete_path(spark, old)
        edges, path = fresh, fresh_path
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
