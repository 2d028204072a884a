"""Queries of the full-text stage, and SQL that stems and searches on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming as st
from ..operators import fulltext as ft
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {sql}"
        return f

    return add


def _region(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{st.REGION}') THEN length(regexp_extract({text}, '{st.REGION}')) ELSE length({text}) END"


def _rules(rules: dict[str, str], region: str) -> str:
    """A step of the stemmer over w, longest suffix first."""
    lines = []
    for suffix in sorted(rules, key=len, reverse=True):
        k = len(suffix)
        ok = f"length(w) - {k} >= {'r2' if suffix == 'ative' else region}"
        if suffix in st.BEFORE:
            ok += f" AND contains('{st.BEFORE[suffix]}', w[-{k + 1}:-{k + 1}]) AND length(w) > {k}"
        lines.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {ok} THEN w[:-{k + 1}] || '{rules[suffix]}' ELSE w END")
    return f"CASE {' '.join(lines)} ELSE w END"


def _past(k: int) -> str:
    s = f"w[:-{k + 1}]"
    return f"""CASE WHEN NOT regexp_matches({s}, '[aeiouy]') THEN w WHEN regexp_matches({s}, '(at|bl|iz)$') THEN {s} || 'e'
      WHEN regexp_matches({s}, '{st.DOUBLE}') THEN CASE WHEN regexp_matches({s}, '^[aeo]..$') THEN {s} ELSE {s}[:-2] END
      WHEN length({s}) <= r1 AND regexp_matches({s}, '{st.SHORT}') THEN {s} || 'e' ELSE {s} END"""


def stems_sql(source: str) -> str:
    """CTEs up to st(word, lexeme) of the searched words of ``source``.word."""
    stop = ", ".join(f"'{w}'" for w in st.STOP_WORDS)
    whole = " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in st.WHOLE.items())
    kept = lambda k: f"CASE WHEN length(w) - {k} >= r1 THEN w[:-{k + 1}] || 'ee' ELSE w END"
    return f"""
s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT word FROM {source} WHERE length(word) >= 2 AND word NOT IN ({stop}))),
s1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6 ELSE {_region("w")} END AS r1 FROM s0),
s2 AS (SELECT *, r1 + {_region("substr(w, r1 + 1)")} AS r2 FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN w[:-3] WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
  WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w) FROM s2),
s4 AS (SELECT *, w AS w1a FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'eedly') THEN {kept(5)} WHEN ends_with(w, 'ingly') THEN {_past(5)} WHEN ends_with(w, 'edly') THEN {_past(4)}
  WHEN ends_with(w, 'eed') THEN {kept(3)} WHEN ends_with(w, 'ing') THEN {_past(3)} WHEN ends_with(w, 'ed') THEN {_past(2)} ELSE w END AS w) FROM s4),
s6 AS (SELECT * REPLACE (CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN w[:-2] || 'i' ELSE w END AS w) FROM s5),
s7 AS (SELECT * REPLACE ({_rules(st.STEP_2, "r1")} AS w) FROM s6),
s8 AS (SELECT * REPLACE ({_rules(st.STEP_3, "r1")} AS w) FROM s7),
s9 AS (SELECT * REPLACE ({_rules(st.STEP_4, "r2")} AS w) FROM s8),
sa AS (SELECT *, CASE WHEN ends_with(w, 'e') THEN CASE WHEN length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(w[:-2], '{st.SHORT}')) THEN w[:-2] ELSE w END
  WHEN ends_with(w, 'll') AND length(w) > r2 THEN w[:-2] ELSE w END AS w5 FROM s9),
st AS (SELECT word, CASE {whole} WHEN length(word) < 3 THEN word WHEN w1a IN ({", ".join(f"'{w}'" for w in st.INVARIANT)}) THEN w1a ELSE replace(w5, 'Y', 'y') END AS lexeme FROM sa)"""


#: Tokens of all documents and of the query set, their stems, and the places where they meet.
PLACES = f"""
tk AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents)),
qk AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark WHERE item_id % 20 = 0),
al AS (SELECT word FROM tk UNION SELECT word FROM qk WHERE word <> ''),
{stems_sql("al")},
qt AS (SELECT DISTINCT item_id, lexeme FROM qk JOIN st USING (word)),
tl AS (SELECT doc_id, pos, lexeme FROM tk JOIN st USING (word))"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and the terms of the stated query set: every benchmark row whose id is divisible by 20."""
    items = table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0)
    return table(spark, sf_dir, "documents"), ft.query_terms(items, "item_id")


@query("stem_words", f"tk AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), {stems_sql('tk')} SELECT * FROM st")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.dictionary(ft.tokens(table(spark, sf_dir, "documents"), "doc_id"))


@query(
    "fulltext_any",
    f"""{PLACES}, r AS (SELECT item_id, doc_id, round(0.1 * count(*), 6) AS score FROM tl JOIN qt USING (lexeme) GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 50""",
)
def fulltext_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms = asked(spark, sf_dir)
    scored = ft.any_rank(ft.postings(docs, terms, "doc_id", "item_id"), "doc_id", "item_id").withColumn("score", F.round("score", 6))
    return ft.top_k(scored, "score", "doc_id", 50, ["item_id"])


@query(
    "cover_density",
    f"""{PLACES}, df AS (SELECT lexeme, count(DISTINCT doc_id) AS docs FROM tl SEMI JOIN qt USING (lexeme) GROUP BY lexeme),
q3 AS (SELECT item_id, lexeme FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY docs DESC, lexeme) AS k FROM qt JOIN df USING (lexeme)) WHERE k <= 3),
qn AS (SELECT item_id, count(*) AS k FROM q3 GROUP BY item_id),
pl AS (SELECT item_id, doc_id, pos, lexeme, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS n FROM tl JOIN q3 USING (lexeme)),
la AS (SELECT e.item_id, e.doc_id, e.pos AS stop, e.n, s.lexeme, max(s.pos) AS pos, max(s.n) AS m FROM pl e JOIN pl s ON s.item_id = e.item_id AND s.doc_id = e.doc_id AND s.pos <= e.pos GROUP BY ALL),
co AS (SELECT item_id, doc_id, stop, n, min(pos) AS start, min(m) AS m FROM la JOIN qn USING (item_id) GROUP BY item_id, doc_id, stop, n, k HAVING count(*) = k),
mi AS (SELECT *, lag(start) OVER (PARTITION BY item_id, doc_id ORDER BY stop) AS before FROM co),
ra AS (SELECT item_id, doc_id, round(sum(0.1 / (1 + stop - start - (n - m))), 6) AS score, count(*) AS covers FROM mi WHERE before IS NULL OR before < start GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, covers, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM ra) WHERE k <= 50""",
)
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms = asked(spark, sf_dir)
    terms = ft.chosen(terms, ft.document_frequency(docs, terms, "doc_id"), "item_id", 3, rare=False)
    ranked = ft.cover_rank(ft.postings(docs, terms, "doc_id", "item_id"), terms, "doc_id", "item_id")
    return ft.top_k(ranked.withColumn("score", F.round("score", 6)), "score", "doc_id", 50, ["item_id"])


#: Each source of a language is a cause with its first document's text; a document tells of a cause by name or by section.
CAUSES = """
ca AS (SELECT lang || '-' || source AS fault_id, lang || '.' || source AS section, arg_min(text, doc_id) AS text FROM documents GROUP BY lang, source),
ch AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '-' || source END AS fault_id, lang || '.' || source || '.' || doc_id % 7 AS section FROM documents),
cc AS (SELECT doc_id, ca.fault_id FROM ch JOIN ca ON ch.fault_id = ca.fault_id OR (ch.fault_id IS NULL AND (ch.section = ca.section OR starts_with(ch.section, ca.section || '.'))))"""


def causes_and_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    fault, section = F.concat_ws("-", "lang", "source"), F.concat_ws(".", "lang", "source")
    causes = docs.groupBy("lang", "source").agg(F.min_by("text", "doc_id").alias("text")).select(fault.alias("fault_id"), section.alias("section"), "text")
    chunks = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, fault).alias("fault_id"), F.concat_ws(".", section, F.col("doc_id") % 7).alias("section"))
    return causes, chunks


@query("chunk_cause_counts", f"{CAUSES} SELECT fault_id, count(*) AS chunks FROM cc GROUP BY fault_id")
def chunk_cause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes, chunks = causes_and_chunks(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return ft.chunk_causes(chunks, causes).groupBy("fault_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "fulltext_stage",
    f"""{PLACES}, {CAUSES},
cw AS (SELECT fault_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM ca),
hi AS (SELECT item_id, fault_id, 0.1 * count(*) AS score FROM cw JOIN st USING (word) JOIN qt USING (lexeme) GROUP BY ALL
  UNION ALL SELECT item_id, fault_id, score FROM (SELECT item_id, doc_id, 0.1 * count(*) AS score FROM tl JOIN qt USING (lexeme) GROUP BY ALL) JOIN cc USING (doc_id)),
be AS (SELECT item_id, fault_id, round(max(score), 6) AS score FROM hi GROUP BY ALL)
SELECT item_id, fault_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fault_id) AS k FROM be) WHERE k <= 50""",
)
def fulltext_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms = asked(spark, sf_dir)
    causes, chunks = causes_and_chunks(docs.select("doc_id", "lang", "source", "text"))
    own = ft.any_rank(ft.postings(causes, terms, "fault_id", "item_id"), "fault_id", "item_id")
    told = ft.any_rank(ft.postings(docs, terms, "doc_id", "item_id"), "doc_id", "item_id").join(ft.chunk_causes(chunks, causes).select("doc_id", "fault_id"), "doc_id")
    rounded = [s.withColumn("score", F.round("score", 6)) for s in (own, told)]
    return ft.fulltext_stage(rounded, "item_id", "fault_id", 50)
