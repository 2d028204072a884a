"""Full-text ranks against all covers by brute force, and chunks of causes by name and by section."""

import random

import pytest

from fathomline.operators import fulltext as ft


def brute_covers(places, terms):
    """Every stretch that holds all terms and no shorter one that does; ``places`` is a list of (pos, term)."""
    spans = [(a, b) for a, _ in places for b, _ in places if a <= b and {t for p, t in places if a <= p <= b} == terms]
    return sorted((a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    texts = {k: " ".join(r.choice(["pump", "pumps", "valve", "the", "oil", "x", "rising", "rise", "12", "Cooler!"]) for _ in range(r.choice([0, 3, 20, 60]))) for k in range(120)}
    texts[500], texts[501] = None, "pump " * 400 + "valve"
    queries = {1: "Pumps rise", 2: "valve or oil", 3: "the it", 4: "pump valve oil cooler", 5: "turbine pump", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc int, text string")
    asked = spark.createDataFrame(list(queries.items()), "q int, text string")
    stems = {"pump": "pump", "pumps": "pump", "valve": "valv", "oil": "oil", "rising": "rise", "rise": "rise", "cooler": "cooler"}
    positions = {k: [(p + 1, stems[w]) for p, w in enumerate(t.lower().replace("12", "").replace("!", "").split()) if w in stems] for k, t in texts.items() if t}
    return docs, asked, positions


def test_terms_of_queries(spark, corpus):
    _, asked, _ = corpus
    got = {}
    for r in ft.query_terms(asked, "q").collect():
        got.setdefault(r.q, set()).add(r.lexeme)
    assert got == {1: {"pump", "rise"}, 2: {"valv", "oil"}, 4: {"pump", "valv", "oil", "cooler"}, 5: {"turbin", "pump"}}


def test_cover_density_equals_all_covers(spark, corpus):
    docs, asked, positions = corpus
    terms = ft.query_terms(asked, "q")
    places = ft.postings(docs, terms, "doc", "q")
    by_query = {}
    for r in terms.collect():
        by_query.setdefault(r.q, set()).add(r.lexeme)
    want = {}
    for q, own in by_query.items():
        for doc, every in positions.items():
            held = [(p, t) for p, t in every if t in own]
            spans = brute_covers(held, own) if len(held) < 200 else None
            if spans is None:
                continue
            score = sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p, _ in held) - 1)) for a, b in spans)
            if spans:
                want[q, doc] = (len(spans), round(score, 9))
    got = {(r.q, r.doc): (r.covers, round(r.score, 9)) for r in ft.cover_rank(places, terms, "doc", "q").collect() if r.doc != 501}
    assert got == want and len(want) > 60
    spans = {(r.q, r.start, r.stop) for r in ft.covers(places, terms, "doc", "q").where("doc = 501").collect()}
    assert spans == set()  # no query's terms are all there


def test_words_stay_with_their_document(spark, corpus):
    """No word of the documents is dealt by itself, and places are not paired with their query's terms."""
    docs, asked, _ = corpus
    terms = spark.createDataFrame(ft.query_terms(asked, "q").collect())
    places = ft.postings(docs, terms, "doc", "q")
    for found in (places, ft.cover_rank(places, terms, "doc", "q")):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert plan.count("Window ") <= 2  # of the terms only
    assert ft.covers(places, terms, "doc", "q").where("n > 1").count() > 60


def test_covers_of_a_document_read_in_parts(spark):
    places = spark.createDataFrame([(1, "d", p, t) for p, t in [(9, "a"), (2, "a"), (5, "b"), (4, "a"), (12, "b")]], "q int, doc string, pos int, lexeme string").repartition(3, "pos")
    terms = spark.createDataFrame([(1, "a"), (1, "b")], "q int, lexeme string")
    assert sorted((r.start, r.stop, r.n) for r in ft.covers(places, terms, "doc", "q").collect()) == [(4, 5, 2), (5, 9, 2), (9, 12, 2)]


def test_any_term_counts_every_place(spark, corpus):
    docs, asked, positions = corpus
    terms = ft.query_terms(asked, "q")
    got = {(r.q, r.doc): round(r.score, 6) for r in ft.any_rank(ft.postings(docs, terms, "doc", "q"), "doc", "q").collect()}
    own = {1: {"pump", "rise"}, 2: {"valv", "oil"}, 4: {"pump", "valv", "oil", "cooler"}, 5: {"pump"}}
    want = {(q, d): round(0.1 * n, 6) for q, ts in own.items() for d, every in positions.items() if (n := sum(t in ts for _, t in every))}
    assert got == want


def test_frequency_and_choice_of_terms(spark, corpus):
    docs, asked, positions = corpus
    terms = ft.query_terms(asked, "q")
    frequency = ft.document_frequency(docs, terms, "doc")
    want = {t: sum(any(x == t for _, x in every) for every in positions.values()) for t in ("pump", "rise", "valv", "oil", "cooler")}
    assert {r.lexeme: r.docs for r in frequency.collect()} == want
    order = sorted(("pump", "valv", "oil", "cooler"), key=lambda t: (want[t], t))
    for rare in (True, False):
        got = {r.lexeme for r in ft.chosen(terms, frequency, "q", 2, rare).where("q = 4").collect()}
        assert got == set(order[:2] if rare else sorted(order, key=lambda t: (-want[t], t))[:2])
    assert ft.cover_rank(ft.postings(docs.limit(0), terms, "doc", "q"), terms, "doc", "q").count() == 0


def test_chunks_tell_of_causes_by_name_else_by_section(spark):
    causes = spark.createDataFrame([("F1", "6.1"), ("F2", "6"), ("F3", None), ("F4", "6_1")], "fault_id string, section string")
    chunks = spark.createDataFrame([(1, "F3", "6.1"), (2, None, "6.1.2"), (3, None, "6.10"), (4, None, None), (5, "F9", "6.1"), (6, None, "6_1.3"), (7, None, "7")], "chunk int, fault_id string, section string")
    got = {(r.chunk, r.fault_id) for r in ft.chunk_causes(chunks, causes).collect()}
    assert got == {(1, "F3"), (2, "F1"), (2, "F2"), (3, "F2"), (6, "F4")}


def test_stage_takes_the_best_source_of_a_cause(spark):
    a = spark.createDataFrame([(1, "F1", 0.2), (1, "F2", 0.0)], "q int, fault string, score double")
    b = spark.createDataFrame([(1, "F1", 0.1), (1, "F3", 0.2), (2, "F3", 0.3)], "q int, fault string, score double")
    got = [tuple(r) for r in ft.fulltext_stage([a, b], "q", "fault", 2).orderBy("q", "rank").collect()]
    assert got == [(1, "F1", 0.2, 1), (1, "F3", 0.2, 2), (2, "F3", 0.3, 1)]
