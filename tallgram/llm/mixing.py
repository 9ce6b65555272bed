"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

A source's size is the number of words of its documents. The mix has ``SHARE`` times the words of all
sources. Every source gets its weight's part of that; one whose part is above ``MOST`` times its size
(the maximum number of epochs) is clamped there, and what it can't take goes to the others by weight,
until none is above. A source with the rate r = target / size takes each of its documents floor(r)
times, and some of them once more: its rows stand in the order of a seeded digest of id and text, and
the part from the front whose words come nearest to what is missing is taken again (of two equally near the
shorter). So the words taken differ from the target by half a document at most, and reruns agree.

The end of that part is found digit by digit: words are summed by source and the next three hex digits
of the digest, the digit group in which the missing words end is kept, and so on until few rows are
left. Rows with one id and one text share a digest; behind it comes a digest of a row's place in the
stored table, which tells them apart, so a source of nothing but copies is cut as finely as any other.
The table of sources may be of any length: it is ranked by a sort over ranges, its water level is found
by sums over it, and it is joined by the usual rule (broadcast if small, else shuffled).

Defined results: a null or empty text has size 0 and is taken 0 words, whatever its copies; a null
source is a source of its own, after all others; null ids are rows like others. Repeated rows are
drawn one by one; of rows equal in id and text any may be the one that is taken once more. A corpus
without words has targets of 0. An empty table gives an empty result. Columns named like an output are
replaced by it, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lookup, stored, work_path

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a multiple of all words.
SHARE = 1.5
#: Times that a source, or a document, is taken at most.
MOST = 2
SEED = "mix"

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of each of the two digests, and of one step of the search.
DIGITS = 15
STEP = 3
#: Rows of a source in one group of digits that are sorted in one task.
FEW_ROWS = 5_000

_OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def _digest(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, DIGITS)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def measured(docs: DataFrame, keep: list[str], id: str, text: str, source: str, seed: str) -> DataFrame:
    """Stored rows: ``row`` (the kept columns), source, size, and key (content digest, then place digest)."""
    plain = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row") if keep else F.struct(F.lit(0).alias("_")).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _digest(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("content"),
    )
    rows = stored(plain, "mix-rows")
    place = _digest(F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return rows.withColumn("key", F.concat("content", place)).drop("content")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 by code point, null last; no task holds all of them."""
    spark, path = sources.sparkSession, work_path(sources.sparkSession, "mix-sources")
    order = [F.col("source").isNull(), F.col("source")]
    sources.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    rows = spark.read.schema(sources.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index")
    )
    # one row a file: their number is that of the partitions, and names follow partition numbers
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(files), "file").withColumn("place", F.col("before") + F.col("row_index")).drop("file", "row_index", "before")


def water_level(caps: DataFrame, budget: float) -> float | None:
    """The words a unit of weight gets, for ``caps`` (weight, cap): sources above their cap are clamped
    and their excess is shared again until none is above. None if all are clamped."""
    level = 0.0
    while True:
        # what is clamped at one level stays so, as the level only rises
        clamped = F.col("weight") * F.lit(level) > F.col("cap")
        sums = caps.agg(
            F.sum(F.when(clamped, F.col("cap"))).alias("used"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weight"),
        ).first()
        if not sums["weight"]:
            return None
        fresh = (budget - float(sums["used"] or 0)) / float(sums["weight"])
        if fresh <= level:
            return level
        level = fresh


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Stored table: source, source_size, target, whole (repetitions of every document), missing (words
    left to the documents that are taken once more)."""
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(sources.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-caps")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total)
    part = F.lit(None).cast("double") if level is None else F.col("weight") * F.lit(level)
    target = F.least(part, F.col("cap").cast("double"))
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("whole", whole)
    return stored(
        sources.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing")), "mix-targets"
    )


def ends(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """source, stop: rows with a smaller key are taken once more. Sources that miss nothing are not listed."""
    # search: per source the digits known so far, and the words missing behind all smaller digits
    search = sources.filter("missing > 0").select("source", F.lit("").alias("known"), F.col("missing").alias("left"))
    search = stored(search, "mix-search")
    for digits in range(STEP, 2 * DIGITS + 1, STEP):
        here = inside(rows, search)
        cells = here.groupBy("source", F.substring("key", 1, digits).alias("next")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left")
        )
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("next"))
        # the group of digits that reaches what is missing: the first whose sum is at least that
        hit = cells.withColumn("upto", upto).filter("upto >= left").groupBy("source").agg(F.min_by(F.struct("next", "words", "upto", "left", "n"), "next").alias("c"))
        search = stored(
            hit.select("source", F.col("c.next").alias("known"), (F.col("c.left") - (F.col("c.upto") - F.col("c.words"))).alias("left"), F.col("c.n").alias("n")),
            "mix-search",
        )
        if not (search.agg(F.max("n")).first()[0] or 0) > FEW_ROWS:
            break
        search = search.drop("n")
    by_key = Window.partitionBy("source").orderBy("key")
    last = inside(rows, search).withColumn("upto", F.sum("size").over(by_key))
    # a row is out if taking it comes no nearer to what is missing; "~" is behind all keys of the group
    out = F.when(2 * F.col("upto") - F.col("size") >= 2 * F.col("left"), F.col("key"))
    return last.groupBy("source").agg(F.coalesce(F.min(out), F.concat(F.first("known"), F.lit("~"))).alias("stop"))


def inside(rows: DataFrame, search: DataFrame) -> DataFrame:
    """Source, key, size, known and left of the rows whose key begins with the digits known of their source."""
    found = lookup(search.select(F.col("source").alias("of"), "known", "left"), "mix-known")
    return rows.select("source", "key", "size").join(found, _same(F.col("source"), F.col("of")) & F.col("key").startswith(F.col("known"))).drop("of")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
    keep: list[str] | None = None, id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: its columns (those in ``keep``, if given), size (words), source_size and
    target (its source's words, and the words the mix has of them), copies (times it is taken) and
    taken (words, repeats counted). ``repeated`` lays the copies out as rows."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in _OUTPUTS]
    rows = measured(docs, keep, id, text, source, seed)
    sources = targets(rows, weights, share, most)
    plan = sources.join(ends(rows, sources).withColumnRenamed("source", "of"), _same(F.col("source"), F.col("of")), "left").drop("of")
    found = lookup(plan.withColumnRenamed("source", "of"), "mix-plan")
    # a source that misses words and has no stop takes all of its rows once more
    again = (F.col("missing") > 0) & (F.col("stop").isNull() | (F.col("key") < F.col("stop")))
    out = rows.join(found, _same(F.col("source"), F.col("of"))).withColumn("copies", F.col("whole") + again.cast("int"))
    fields = [F.col(f"row.`{c}`").alias(c) for c in keep]
    return out.select(*fields, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mix as often as they are taken, with ``copy`` from 1."""
    return mixed.drop("copy").withColumn("copy", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END")))
