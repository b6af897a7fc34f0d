"""Corpus pipeline: quality, boilerplate lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
each stage's rows as a Parquet table in the shared folder and reads them back as the next one's.

All but the last return all columns of their documents, others than the five of the table too, whatever their names.
Null and empty texts, texts of any length and null or repeated ids are documents like any other; what a stage does with them
is said there. Rows are told apart by a 64-bit hash of id and text: rows that repeat both share one decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import durable, kept, table
from tracelake.llm.decontaminate import drop_contaminated
from tracelake.llm.line_dedup import drop_boilerplate
from tracelake.llm.near_dup import jaccard_components
from tracelake.llm.packing import pack
from tracelake.llm.quality import score_quality
from tracelake.llm.queries import WORD_BPE

#: Rows of an Arrow batch: about 8 MB of text. A batch lives in the JVM and in the Python worker at once.
BATCH_ROWS = 2500


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a new column, and its name: the row's key by which stages decide, also where the id is null or repeated; rows that repeat an id and text share it."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def _matching(docs: DataFrame, rows: DataFrame, row: str, how: str) -> DataFrame:
    few = rows.count() <= 1_000_000
    return docs.join(F.broadcast(rows) if few else rows, row, how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted good quality; null and empty texts are scored too, and rows of one id and text stay or go together."""
    _bounded(spark)
    own, (docs, row) = docs.columns, _keyed(docs)
    scored = durable(score_quality(docs, table(spark, sf_dir, "labels"), row=row))
    return _matching(docs, scored.where("predicted = 1").select(row).distinct(), row, "left_semi").select(own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; a null text stays null, and n_chars is that of what is left."""
    _bounded(spark)
    kept = drop_boilerplate(docs, F.col("source"), F.col("text"))
    changed = {"text": F.col("_text").alias("text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long").alias("n_chars")}
    return kept.select(*[changed.get(c, F.col(f"`{c}`")) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id (null last), of each component of near duplicates; one row of those that repeat an id and text. Texts without words are alike to none."""
    _bounded(spark)
    own, (docs, row) = docs.columns, _keyed(docs)
    found = durable(jaccard_components(docs, key=row).select(F.col("doc_id").alias(row), "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row)
    found = durable(docs.select(row, "doc_id").join(found, row).groupBy("component_id").agg(first).select(row))
    kept = _matching(docs, found, row, "left_semi")
    repeated = durable(docs.groupBy(row).count().where("count > 1").select(row))
    if not repeated.isEmpty():
        kept = _matching(kept, repeated, row, "left_anti").unionByName(_matching(kept, repeated, row, "left_semi").dropDuplicates([row]))
    return kept.select(own)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    _bounded(spark)
    own, (docs, row) = docs.columns, _keyed(docs)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), row).select(own)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; a null text is empty, and each row has pieces of its own."""
    _bounded(spark)
    return pack(docs, WORD_BPE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the latent search and the packing have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
