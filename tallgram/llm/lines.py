"""Cross-site boilerplate lines, by the number of distinct sites each line is found on.

Every line has a HyperLogLog sketch of its sites, keyed by the line's hash; sketches merge by
aggregation, before and after the shuffle, so a line that is everywhere costs one sketch a task.
Estimates that lie within ``BAND`` relative standard errors of the threshold are replaced by exact
distinct counts of those lines only. Lines on ``min_sites`` sites or more are removed from every
document but the one with the smallest id that has them, so that no content is lost altogether. A
text of which more than ``max_share`` of the lines would go is a copy of a document rather than a
page with boilerplate; it stays as it is, for near-duplicate detection to judge. With ``max_share``
None only texts that would lose every line stay, so a page with a line of its own keeps no boilerplate.

Only DataFrame functions are used. Lines are compared without the blanks around them, by 96 bits of
hash; blank lines are never removed. What is removed from each document travels to it as a list of
line numbers, by broadcast while that is small (``session.lookup``) and by a join on the id beyond.

Defined results: a null text has no lines and stays null, an empty one has one blank line. Rows
without a site add none to a line's sites. Rows with one id count as one document when the first is
sought, and repeated rows are cut alike; rows without id are never the first. Empty tables stay
empty; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup, stored

MIN_SITES = 10
MAX_SHARE = 0.5
#: log2 of the registers of a sketch; the relative standard error is 1.04 / sqrt(registers).
LOG_REGISTERS = 10
#: Width, in relative standard errors on either side, of the zone that is counted exactly.
BAND = 5.0

_BLANKS = " \t\r"


def line_array(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def line_rows(docs: DataFrame, id: str, text: str, *more: str) -> DataFrame:
    """h1, h2 (hash of a line that isn't blank), line (number) and the id and row of its text."""
    return (
        docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("row"), *more, F.posexplode(line_array(text)).alias("line", "raw"))
        .withColumn("raw", stripped(F.col("raw")))
        .filter("raw != ''")
        .select("id", "row", *more, "line", F.xxhash64("raw").alias("h1"), F.hash("raw").alias("h2"))
    )


def widespread(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", id: str = "doc_id", text: str = "text") -> DataFrame:
    """h1, h2 and first (smallest id) of the lines that are on ``min_sites`` sites or more."""
    rows = line_rows(docs.withColumn("__site", F.col(site).cast("string")), id, text, "__site")
    spread = (
        rows.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("__site", F.lit(LOG_REGISTERS)).alias("sketch"), F.min("id").alias("first"))
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    error = BAND * 1.04 / 2 ** (LOG_REGISTERS / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = stored(spread.filter(F.col("sites") >= low), "line-spread")
    near = lookup(spread.filter(F.col("sites") <= high).select("h1", "h2"), "near-lines")
    exact = (
        rows.join(near, ["h1", "h2"])
        .select("h1", "h2", "__site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("__site").alias("exact"))
        .filter(F.col("exact") >= min_sites)
        .select("h1", "h2")
    )
    sure = spread.filter(F.col("sites") > high)
    return sure.select("h1", "h2", "first").unionByName(spread.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def without_lines(lines: Column, gone: Column) -> Column:
    """The lines that are not at the sorted places ``gone``, as the stretches between them."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    stretches = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda k: F.slice(lines, F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1) - 1),
    )
    return F.flatten(stretches)


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, max_share: float | None = MAX_SHARE, site: str = "source",
    id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the numbers of lines and of lines
    removed."""
    spread = lookup(widespread(docs, min_sites, site, id, text), "boilerplate")
    hits = (
        line_rows(docs, id, text)
        .join(spread, ["h1", "h2"])
        .filter(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))))
        .groupBy("id", "row")
        .agg(F.sort_array(F.collect_set("line")).alias("__gone"))
        .select(F.col("id").alias("__id"), F.col("row").alias("__row"), "__gone")
    )
    joined = docs.join(
        lookup(hits, "removed-lines"), docs[id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__row")), "left"
    )
    lines = line_array(text)
    full = F.size(F.filter(lines, lambda x: stripped(x) != ""))
    gone = F.size("__gone")
    cut = F.col("__gone").isNotNull() & (gone < full if max_share is None else gone <= max_share * full)
    columns = {text: F.when(cut, F.array_join(without_lines(lines, F.col("__gone")), "\n")).otherwise(F.col(text))}
    columns[n_lines] = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    columns[n_lines] = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(columns[n_lines])
    columns[n_removed] = F.when(cut, F.size("__gone")).otherwise(0).cast("long")
    names = [*docs.columns, *(c for c in (n_lines, n_removed) if c not in docs.columns)]
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in names])
