"""Retrieval: vector and lexeme stages, prefix join, rank fusion, candidate assembly and decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RRF_K = 60
MAX_CANDIDATES, MIN_CANDIDATES = 6, 3
ABSTAIN, DECISIVE_GAP, CONTRADICTION = 0.34, 0.3, 0.5


def top_k(scored: DataFrame, score: str, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best, ties to the smaller key; ``by`` gives k for each of its values."""
    if not by:
        return scored.orderBy(F.desc(score), key).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefix_join(chunks: DataFrame, causes: DataFrame, ref: str = "section", own: str = "section") -> DataFrame:
    """Chunks with the causes filed under the chunk's section or one above it.

    Every chunk is entered under each ancestor of its dotted section, which makes the prefix
    condition an equi-join.
    """
    parts = F.split(ref, r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return chunks.withColumn("_at", F.explode(ancestors)).join(causes.withColumnRenamed(own, "_at"), "_at").drop("_at")


def union_max(parts: list[DataFrame], key: str, score: str) -> DataFrame:
    """The best score of each key over all hit sets; keys without a positive score go."""
    every = parts[0].select(key, score)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, score))
    return every.groupBy(key).agg(F.max(score).alias(score)).where(F.col(score) > 0)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_row, queries, ...), a document's one after the other, to (_query, _hits, ...) of each document and query."""

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        row = rows["_row"].to_numpy()
        queries = rows["_queries"].combine_chunks()
        at = np.repeat(np.searchsorted(row, row), queries.value_lengths().to_numpy())  # the first row of the same document
        met = pa.table({"at": at, "_query": queries.flatten()}).group_by(["at", "_query"], use_threads=False).aggregate([([], "count_all")])
        own = rows.drop_columns(["_row", "_queries"]).take(met["at"])
        yield from pa.table([met["_query"], met["count_all"], *own.columns], names=["_query", "_hits", *own.column_names]).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        row = batch["_row"].to_numpy()
        done = int(np.searchsorted(row, row[-1]))  # the last document may go on in the next batch
        if done or (held and held[-1]["_row"][-1].as_py() != row[-1]):
            yield from counted(pa.Table.from_batches([*held, batch.slice(0, done)]))
            held = []
        held.append(batch.slice(done))
    if held:
        yield from counted(pa.Table.from_batches(held))


def term_shares(docs: DataFrame, queries: DataFrame, words: str, terms: str) -> DataFrame:
    """Every document with every query that shares a word with it, and ``score``, the share of the query's terms that it has.

    ``words`` and ``terms`` are arrays of distinct words. The terms are broadcast, as they grow with the queries only; a
    document's words meet them and are counted where the document is read, so pairs are not shuffled.
    """
    copy = F.row_number().over(Window.partitionBy(*queries.columns).orderBy(F.lit(1)))
    asked = queries.withColumn("_copy", copy).withColumn("_query", F.xxhash64(*queries.columns, "_copy")).drop("_copy").withColumn("_n", F.size(terms))
    listed = asked.select("_query", F.explode(terms).alias("_term")).groupBy("_term").agg(F.collect_list("_query").alias("_queries"))
    own = [c for c in docs.columns if c != words]
    found = docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", *own, F.explode(words).alias("_term"))
    found = found.join(F.broadcast(listed), "_term").select("_row", "_queries", *own)
    met = found.mapInArrow(_hits, StructType([StructField("_query", LongType()), StructField("_hits", LongType()), *[docs.schema[c] for c in own]]))
    scored = met.join(F.broadcast(asked.drop(terms)), "_query")
    return scored.withColumn("score", F.col("_hits") / F.col("_n")).drop("_query", "_hits", "_n")


def fuse(stages: DataFrame, key: str, stage: str, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of stages in long form; zero scores have no rank. ``keep`` names columns that go with the key."""
    w = Window.partitionBy(stage).orderBy(F.desc(score), key)
    ranked = stages.where(F.col(score) > 0).withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(key).agg(F.sum(1 / (RRF_K + F.col("_r"))).alias("rrf"), F.count(F.lit(1)).alias("stages"), *[F.first(c).alias(c) for c in keep])


def assemble(fused: DataFrame, query: str, key: str, filed: Column) -> DataFrame:
    """For each query, those filed under its condition first, then by fused score, ``MAX_CANDIDATES`` at most."""
    w = Window.partitionBy(query).orderBy(F.desc(filed.cast("int")), F.desc("rrf"), key)
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_CANDIDATES)


def move_scores(moves: DataFrame, observed: DataFrame, contradiction: float = CONTRADICTION) -> DataFrame:
    """How well a fault's expected moves fit what was observed: (matches - weight * contradictions) / moves, from 0 to 1.

    ``moves`` has fault, signal, direction; ``observed`` has event, signal, direction. A signal that
    was not observed is silent.
    """
    seen = observed.withColumnRenamed("direction", "saw")
    n = moves.groupBy("fault").agg(F.count(F.lit(1)).alias("moves"))
    judged = moves.join(seen, "signal").groupBy("event", "fault").agg(F.count_if(F.col("saw") == F.col("direction")).alias("m"), F.count_if(F.col("saw") != F.col("direction")).alias("c"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("m") - contradiction * F.col("c")) / F.col("moves")))
    return judged.join(n, "fault").select("event", "fault", F.col("m").alias("matches"), F.col("c").alias("contradictions"), score.alias("score"))


def decide(support: DataFrame, query: str, key: str, score: str) -> DataFrame:
    """The best supported candidate of each query; none below ``ABSTAIN``; confidence grows with the gap to the next."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    ranked = support.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    best = ranked.where("_r = 1")
    gap = F.col(score) - F.coalesce("_next", F.lit(0.0))
    abstained = F.col(score) < ABSTAIN
    confidence = F.when(abstained, 0.0).otherwise(F.col(score) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), gap / DECISIVE_GAP)))
    return best.select(query, F.when(abstained, "none_of_these").otherwise(F.col(key)).alias("choice"), confidence.alias("confidence"), abstained.alias("abstained"))


def shares(support: DataFrame, query: str, score: str) -> DataFrame:
    """Scores normalised within each query; null where they sum to zero."""
    return support.withColumn("share", F.try_divide(F.col(score), F.sum(score).over(Window.partitionBy(query))))
