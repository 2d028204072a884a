"""Text operators: sentences, chunks with overlap, furniture lines and section assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Sentences with white space normalised; empty ones left out."""
    parts = F.transform(F.split(text, r"[.!?]\s+"), lambda y: F.trim(F.regexp_replace(y, r"\s+", " ")))
    return F.filter(parts, lambda y: y != "")


def chunks(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences gathered to chunks of about ``words`` words, each with the last sentence of the one before.

    A sentence starts a new chunk as its first word crosses a multiple of ``words``; one longer than
    that is a chunk of its own.
    """
    s = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size(F.split("sentence", " "))
    s = s.withColumn("n", n).withColumn("chunk", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / words))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    out = s.groupBy(id_col, "chunk").agg(ordered.alias("s"), F.sum("n").alias("words"))
    carried = F.lag(F.element_at(F.col("s"), -1).getField("sentence")).over(Window.partitionBy(id_col).orderBy("chunk"))
    text = F.array_join(F.transform("s", lambda y: y.sentence), ". ")
    return out.select(id_col, "chunk", "words", F.concat_ws(". ", carried, text).alias("text"))


def furniture(docs: DataFrame, at_least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines, digits aside, that stand in ``at_least`` documents or more."""
    line = F.explode(F.split(text_col, "\n")).alias("line")
    norm = F.lower(F.trim(F.regexp_replace("line", "[0-9]+", "#")))
    seen = docs.select(id_col, line).select(id_col, norm.alias("line")).where("line != ''").distinct()
    return seen.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= at_least)


def sections(lines: DataFrame, by: list[str], order: list[str], head: str) -> DataFrame:
    """Each line with the last heading at or above it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
