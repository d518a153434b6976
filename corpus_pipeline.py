"""The document pipeline: each stage works on all documents its predecessor kept.

Quality rules reject documents and take lines that are frequent on a source out of
the others' texts; line deduplication takes repeated lines out, and documents of which it leaves
no word go; the Jaccard join keeps the smallest doc_id of each group of
near duplicates; decontamination rejects documents with a passage near a test
item; packing lays what is left out in sequences.

Quality rules and line deduplication judge rows that share a doc_id each by its own text.
In the next two stages they are one document and share its fate; a null doc_id is
decided for all such rows at once, except that it never links. n_chars counts the text that is left.
Other columns are passed through. Texts of rows that a stage leaves as they are don't move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontam, jaccard, linedup, packing, quality
from loomframe.llm.common import materialise, split_by_ids, table
from loomframe.llm.queries import tokenizer


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id is in ``ids`` (one column)."""
    gone = materialise(ids.toDF("__gone").distinct(), "gone")
    still, moved = split_by_ids(docs, gone)
    return still.unionByName(moved.join(gone.hint("merge"), moved["doc_id"].eqNullSafe(gone["__gone"]), "left_anti"))


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with n_chars counting the text."""
    return docs.select(*[F.when(F.col("text").isNull(), F.col(c)).otherwise(F.char_length("text").cast("long")).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.cleaned(docs), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(docs)
    emptied = (F.col("__n_dropped") > 0) & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    return _counted(out.where(~emptied), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, jaccard.jaccard_join(docs).documents.where("doc_id <> component_id").select("doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisation, edit matching and best-fit packing have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None
