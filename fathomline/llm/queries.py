"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import once, scratch_path, stash
from .decontaminate import mark_contamination
from .html_extract import extract_text
from .line_dedup import dedup_lines
from .packing import pack
from .periodic_runs import find_runs
from .secrets import scan_secrets
from .shingle_join import link_documents
from .source_audit import divergences
from .surrogates import replace_entities
from .toxicity import fit_toxicity, is_held_out, score_toxicity
from .url_filter import CONTRACT_RULES, judge_urls, rules_frame
from .vamana import build_index, search
from .warc import assemble, read_records, resolve, write_archives


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~is_held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "fathomline").select("doc_id", "n_entities", "text")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where(F.pmod("vec_id", F.lit(100)) == 0), 10)


def tokenizer_path() -> str:
    """The public tokenizer of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, CONTRACT_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = stash(assemble(stash(read_records(spark, path, payload=False), "records")), "captures")
    key = lambda of: F.col(f"{of}.fields")["key"].cast("long")
    return resolve(captures).select(key("metadata").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("original").alias("refers_to"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The documents of the op13 contract: of one in ten, the words from some place on repeat what begins there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = once(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))
    return docs.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    run = "struct<start:long,length:long,period:long>"
    longer = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(run), lambda best, r: F.when(longer(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
dp AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
dw AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM dp CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE p + n - 1 <= len(w)),
m AS (SELECT rid, p, bw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM m) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS sh
  FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.rid <> y.rid GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (rid)
JOIN (SELECT r.a AS rid, min(x.doc_id) AS component_id FROM r JOIN d x ON x.rid = r.b GROUP BY r.a) m USING (rid)
"""

OP9_SQL = f"""
WITH rules(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in CONTRACT_RULES)}),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
j AS (
  SELECT rid, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC, verdict DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM j WHERE k = 1) USING (rid)
"""

OP11_SQL = """
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (
  SELECT *, first_value(page_id) OVER w AS top, row_number() OVER w AS k
  FROM p WINDOW w AS (PARTITION BY hex ORDER BY page_id DESC NULLS LAST, rid))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN top END AS refers_to
FROM r
"""

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
o AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS own_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (
  SELECT o.lang, o.source, k.term, coalesce(n, 0) AS n,
         CAST(1 + CAST(coalesce(n, 0) + 2 AS HUGEINT) * 1000000000 // (own_n + 2 * v) AS BIGINT) AS p,
         CAST(1 + CAST(total + 2 AS HUGEINT) * 1000000000 // (all_n + 2 * v) AS BIGINT) AS q
  FROM o JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
e AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN e ON e.lang = x.lang AND e.source = x.source AND e.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM w WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_surrogates": op3_surrogates,
    "op4_neighbours": op4_neighbours,
    "op5_pack": op5_pack,
    "op6_lines": op6_lines,
    "op7_secrets": op7_secrets,
    "op8_jaccard": op8_jaccard,
    "op9_urls": op9_urls,
    "op10_html": op10_html,
    "op11_warc": op11_warc,
    "op12_divergence": op12_divergence,
    "op13_periods": op13_periods,
}

SQL = {
    "op1_decontaminate": OP1_SQL,
    "op8_jaccard": OP8_SQL,
    "op9_urls": OP9_SQL,
    "op11_warc": OP11_SQL,
    "op12_divergence": OP12_SQL,
}
