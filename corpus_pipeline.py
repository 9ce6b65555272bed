"""Training corpus from documents: quality, boilerplate lines, near-duplicates, benchmark leaks, tokens.

Each stage works on all rows that the one before kept, which were written as Parquet and are read
again, so a lost executor never repeats an earlier stage. Every stage but the last returns the
columns of documents. Near copies are judged by doc_id: rows that share one are kept or dropped
together, and a row without one is never dropped as a copy. All other stages judge row by row, so
repeated rows fare alike.

Defined results: a null or empty text gets a score as any other document does, holds no line, shingle or
window, and has no tokens. A score of exactly ``LEAST_SCORE`` stays. A null source counts as no site, and
labels of null ids are not learnt from. Texts of any length are judged whole. An empty table gives an
empty result. Other columns pass through, whatever their names; ``n_chars`` follows the text where
there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgram.llm import decontaminate, lines, minhash, quality
from tallgram.llm.queries import table, token_digest
from tallgram.session import lookup, stored

#: Least score with which a document is kept.
LEAST_SCORE = 0.7


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to labels outside the held-out fold, doesn't reject."""
    known = table(spark, sf_dir, "labels").filter(~F.coalesce(quality.fold() == 2, F.lit(False)))
    score = unused(docs, "score")
    scored = quality.with_score(docs, quality.fit(docs, known), out=score)
    return scored.filter(F.col(score) >= LEAST_SCORE).drop(score)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of many sites; n_chars follows the text."""
    found, removed = unused(docs, "lines"), unused(docs, "removed")
    cleaned = lines.without_boilerplate(docs, n_lines=found, n_removed=removed)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n_chars)
    return cleaned.drop(found, removed).select(*map(quoted, docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    copies = minhash.clusters(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(lookup(copies, "copies"), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and the digest of its token ids, and the digest of the decoded bytes."""
    return token_digest(docs, spark)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: The classifier is fitted by descent on sampled rows, which SQL can't express; tests/llm/test_pipeline.py
#: holds each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
