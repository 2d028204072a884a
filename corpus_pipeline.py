"""The corpus pipeline: toxicity, line dedup, n-gram near duplicates, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``, further
columns of any name included.

Null and empty texts pass every stage but are one piece of one id in the last. Rows that repeat an id
are judged row by row. Of equal rows one stays in near_duplicates, unless their texts have no words.
Ties go to the smaller id. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import stash, unused
from fathomline.llm.decontaminate import mark_contamination
from fathomline.llm.line_dedup import dedup_lines
from fathomline.llm.packing import pack
from fathomline.llm.queries import tokenizer_path
from fathomline.llm.shingle_join import keep_one
from fathomline.llm.toxicity import fit_toxicity, is_held_out, score_toxicity
from fathomline.sources.tables import table


def _beside(docs: DataFrame, written: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs``: those named as the operator writes its own step aside meanwhile."""
    clash = [c for c in docs.columns if c.lower() in written]
    names = dict(zip(clash, unused(docs, *(f"_kept_{c}" for c in clash))))
    done = stage(docs.withColumnsRenamed(names))
    return done.drop(*[c for c in done.columns if c in clash]).withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject by their language's threshold.

    It learns from the labelled rows of ``docs`` that no evaluation holds out.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~is_held_out()))
    return _beside(docs, ["score", "threshold", "rejected"], lambda d: score_toxicity(d, model).where("not rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, of near or equal lines only the first kept; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = _beside(docs, ["n_lines", "n_dropped"], dedup_lines)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return _beside(docs, ["_t1", "_t2", "_id", "_m1", "_m2", "_gone", "_key", "_text"], keep_one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return _beside(docs, ["n_words", "n_hit", "items", "_hits", "_items"], lambda d: mark_contamination(d, items).where("n_hit = 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, placed in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, MinHash banding and packing have no SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows stashed for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
