"""Lexeme scores: documents and queries meet where a document is read, and each keeps its own count."""

from collections import Counter

import pytest

from fathomline.plans import retrieval_queries as q

ASKED = [(1, "pump valve seal"), (1, "seal valve pump!"), (2, "motor of a belt"), (3, "a b"), (None, "belt"), (5, None)]
READ = [(7, "Pump, valve; pump", "en"), (7, "Pump, valve; pump", "en"), (8, "belt " * 40 + "of motor valve", None), (9, None, "de"), (10, "", "de"), (11, "seal pump valve motor belt of x", "de")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(READ, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def words(text: str | None) -> set:
    return {w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() if len(w) >= 2}


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_repeated_rows_keep_their_own_scores_in_batches_of_any_size(spark, tables, batch):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        got = Counter(tuple(r) for r in q.lexeme_scores(spark, tables).collect())
    finally:
        spark.conf.set(size, before)
    pairs = [(i, d, lang, len(words(a) & words(t)) / max(1, len(words(a)))) for i, a in ASKED for d, t, lang in READ]
    assert got == Counter(p for p in pairs if p[3])


def test_fusion_reads_documents_once_and_shuffles_no_pairs(spark, tables):
    plan = q.fused(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(item_id" in line and "doc_id" in line]
    assert not shuffles


def test_only_named_queries_are_asked(spark, tables):
    assert {r.item_id for r in q.lexeme_scores(spark, tables, [2]).collect()} == {2}
