"""Full-text search by lexeme positions: matches of any or of all terms of a query, and their cover density.

Postings hold one row a place where a document has a term of some query; documents and queries meet only there. Each distinct
word is stemmed once. The words that some query asks for are broadcast, as they grow with the queries only, so words stay with
their document until no other is left: a frequent word is never gathered from all documents. A query's terms and its documents' places
are counted, never paired with each other.

A cover is a stretch from one place to another that holds every term of the query and no shorter stretch within it does. Its
weight is that of its places over one more than the other words in it; a document's rank is the sum. With ``any``
term enough, every place is a cover by itself. Positions count all words, stop words too; nothing is cut at a number of positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.stemming import dictionary, words
from .retrieval import top_k, union_max

#: Fixed value: the weight of a place in plain text.
PLAIN = 0.1


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word) of every word, positions from 1."""
    return docs.select(key, F.posexplode(words(F.col(text))).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


def query_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lexeme) of each query, distinct."""
    asked = queries.select(key, F.explode(words(F.col(text))).alias("word")).distinct()
    return asked.join(dictionary(asked), "word").select(key, "lexeme").distinct()


def wanted_words(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """The words of documents that stem to a lexeme of ``terms``, with the columns of ``terms``."""
    found = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    return F.broadcast(dictionary(found).join(F.broadcast(terms), "lexeme"))


def document_frequency(docs: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(lexeme, docs) of each lexeme of ``terms`` that stands in some document."""
    found = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    wanted = wanted_words(docs, terms.select("lexeme").distinct(), text)
    return found.join(wanted, "word").select(key, "lexeme").distinct().groupBy("lexeme").agg(F.count(F.lit(1)).alias("docs"))


def chosen(terms: DataFrame, frequency: DataFrame, query: str, n: int, rare: bool = True) -> DataFrame:
    """The ``n`` terms of each query that stand in the fewest documents, or in the most, ties by name; terms in none are left out."""
    order = Window.partitionBy(query).orderBy(F.asc("docs") if rare else F.desc("docs"), "lexeme")
    return terms.join(frequency, "lexeme").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select(query, "lexeme")


def postings(docs: DataFrame, terms: DataFrame, doc: str, query: str, text: str = "text") -> DataFrame:
    """(query, doc, pos, lexeme): the places of each query's terms in each document."""
    return tokens(docs, doc, text).join(wanted_words(docs, terms, text), "word").select(query, doc, "pos", "lexeme")


def any_rank(places: DataFrame, doc: str, query: str) -> DataFrame:
    """(query, doc, score): every place of a term counts alone."""
    return places.groupBy(query, doc).agg((PLAIN * F.count(F.lit(1))).alias("score"))


SPANS = ArrayType(StructType([StructField(name, IntegerType()) for name in ("start", "stop", "n")]))


def _minimal(pos: pa.ListArray, term: pa.ListArray, k: np.ndarray) -> pa.ListArray:
    """For each row of places, in any order, the minimal stretches that hold the terms 0 to k - 1."""
    row = np.repeat(np.arange(len(pos)), pos.value_lengths().to_numpy())
    at, what = pos.flatten().to_numpy(), term.flatten().to_numpy()
    order = np.lexsort((at, row))
    at, what = at[order], what[order]
    index, first = np.arange(len(row)), np.searchsorted(row, np.arange(len(pos)))[row]
    begin, met = index.copy(), np.ones(len(row), bool)
    for j in range(k.max(initial=0)):
        last = np.maximum.accumulate(np.where(what == j, index, -1))  # where the term stood last
        asked = j < k[row]
        met &= ~asked | (last >= first)
        begin = np.where(asked, np.minimum(begin, last), begin)
    stop = np.flatnonzero(met)
    start = begin[stop]
    # a stretch that begins where the one before does holds that one; places of other rows begin elsewhere
    fresh = np.diff(start, prepend=-1) != 0
    start, stop = start[fresh], stop[fresh]
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (at[start], at[stop], stop - start + 1)], names=["start", "stop", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[stop], np.arange(len(pos) + 1)).astype(np.int32)), spans)


def spans(places: DataFrame, terms: DataFrame, doc: str, query: str) -> DataFrame:
    """(query, doc, spans): the minimal stretches of each document in order, an array of (start, stop, n); documents without one are left out.

    The places of a document are folded to a row where it is read, and only that row is shuffled.
    """
    own = Window.partitionBy(query)
    asked = terms.withColumns({"term": F.row_number().over(own.orderBy("lexeme")) - 1, "k": F.count(F.lit(1)).over(own).cast("int")})
    numbered = places.join(F.broadcast(asked), [query, "lexeme"]).select(query, doc, "k", "pos", "term")
    keys = [numbered.schema[c] for c in (query, doc)]
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("pos", "term")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.Table.from_batches([batch]).group_by([query, doc, "k"], use_threads=False).aggregate([("pos", "list"), ("term", "list")])
            yield from held.select([query, doc, "k", "pos_list", "term_list"]).rename_columns([query, doc, "k", "pos", "term"]).combine_chunks().to_batches()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _minimal(batch.column("pos"), batch.column("term"), batch.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(query), batch.column(doc), made], names=[query, doc, "spans"])

    folded = numbered.mapInArrow(fold, StructType([*keys, StructField("k", IntegerType()), *lists]))
    whole = folded.groupBy(query, doc).agg(F.max("k").alias("k"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("pos", "term")])
    return whole.mapInArrow(sweep, StructType([*keys, StructField("spans", SPANS)])).where(F.size("spans") > 0)


def covers(places: DataFrame, terms: DataFrame, doc: str, query: str) -> DataFrame:
    """(query, doc, start, stop, n): the minimal stretches that hold all terms of the query, with the places of terms in them."""
    return spans(places, terms, doc, query).select(query, doc, F.inline("spans"))


def cover_rank(places: DataFrame, terms: DataFrame, doc: str, query: str) -> DataFrame:
    """(query, doc, score, covers): cover density of the documents that hold all terms."""
    weight = lambda total, s: total + PLAIN / (s["stop"] - s["start"] - s["n"] + 2)
    return spans(places, terms, doc, query).select(query, doc, F.aggregate("spans", F.lit(0.0), weight).alias("score"), F.size("spans").cast("long").alias("covers"))


def chunk_causes(chunks: DataFrame, causes: DataFrame) -> DataFrame:
    """Chunks with the causes they tell of: by fault where the chunk names one, else by its section or one above.

    ``chunks`` has fault_id and section, ``causes`` fault_id and section; either may be null. Both ways are equi-joins.
    """
    named = chunks.where("fault_id is not null").join(causes.select("fault_id", F.col("section").alias("cause_section")), "fault_id")
    parts = F.split("section", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    filed = chunks.where("fault_id is null and section is not null").drop("fault_id").withColumn("cause_section", F.explode(above))
    filed = filed.join(causes.where("section is not null").select("fault_id", F.col("section").alias("cause_section")), "cause_section")
    return named.unionByName(filed)


def fulltext_stage(sources: list[DataFrame], query: str, cause: str, limit: int) -> DataFrame:
    """The best score of each cause over all sources of hits, for each query the ``limit`` best."""
    every = [s.select(F.struct(query, cause).alias("_of"), "score") for s in sources]
    return top_k(union_max(every, "_of", "score").select(f"_of.{query}", f"_of.{cause}", "score"), "score", cause, limit, [query])
