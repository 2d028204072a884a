"""Queries over vectors, texts and catalogs, and the sequential machines; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import retrieval as r
from ..operators import stateful
from ..operators.alarms import hysteresis_events
from ..operators.matching import DIRECTIONS, judged_scores
from ..operators.text import chunks, furniture, sections, sentences
from ..sources.bridge import TELEMETRY_SQL, telemetry
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {sql}"
        return f

    return add


VECTORS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT v AS qv FROM e WHERE vec_id = 0),
c AS (SELECT vec_id, label, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS sim FROM e CROSS JOIN q)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against the query vector, a one-row literal side."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qv"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(x.cosine(F.col("embedding"), F.col("qv")), 6).alias("sim"))


@query("vector_topk", f"{VECTORS} SELECT vec_id, label, sim FROM c ORDER BY sim DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top_k(scored(spark, sf_dir), "sim", "vec_id", 20)


@query("vector_stage", f"{VECTORS} SELECT label, max(sim) AS sim FROM (SELECT * FROM c ORDER BY sim DESC, vec_id LIMIT 20) GROUP BY label HAVING max(sim) > 0")
def vector_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.union_max([vector_topk(spark, sf_dir)], "label", "sim")


LEX = """d AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) >= 2)) AS w FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) >= 2)) AS q FROM benchmark)"""


def lexeme_scores(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    """The share of each query's lexemes that a document has; ``only`` names the queries that are asked."""
    b = table(spark, sf_dir, "benchmark")
    b = b.where(F.col("item_id").isin(only)) if only else b
    q = b.select("item_id", x.lexemes(F.col("text")).alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", x.lexemes(F.col("text")).alias("w"))
    return r.term_shares(d, q, "w", "q").select("item_id", "doc_id", "lang", "score")


@query("lexeme_overlap", f"{LEX} SELECT item_id, doc_id, round(len(list_intersect(q, w)) / len(q), 6) AS score FROM d CROSS JOIN b WHERE len(list_intersect(q, w)) > 0")
def lexeme_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexeme_scores(spark, sf_dir).select("item_id", "doc_id", F.round("score", 6).alias("score"))


FUSED = f"""{LEX},
s AS (SELECT item_id, doc_id, lang, len(list_intersect(q, w)) / len(q) AS score FROM d CROSS JOIN b WHERE len(list_intersect(q, w)) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM s),
f AS (SELECT doc_id, any_value(lang) AS lang, sum(1.0 / (60 + rk)) AS rrf, count(*) AS stages FROM k WHERE rk <= 50 GROUP BY doc_id)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = r.top_k(lexeme_scores(spark, sf_dir), "score", "doc_id", 50, ["item_id"])
    return r.fuse(best, "doc_id", "item_id", "score", ("lang",))


@query("rrf_fusion", f"{FUSED} SELECT doc_id, round(rrf, 8) AS rrf, stages FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("doc_id", F.round("rrf", 8).alias("rrf"), "stages")


@query("candidate_assembly", f"{FUSED}, a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id % 7 = 0) DESC, round(rrf, 8) DESC, doc_id) AS place FROM f) SELECT * FROM a WHERE place <= 6")
def candidate_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fused(spark, sf_dir).withColumn("rrf", F.round("rrf", 8))
    return r.assemble(f, "lang", "doc_id", F.col("doc_id") % 7 == 0).select("lang", "doc_id", "place")


@query("union_max_hits", f"""{FUSED}, u AS (SELECT doc_id, score FROM s WHERE item_id = 0 UNION ALL SELECT doc_id, score / 2 AS score FROM s WHERE item_id = 1 UNION ALL SELECT doc_id, score / 4 AS score FROM s WHERE item_id = 2)
SELECT doc_id, round(max(score), 6) AS score FROM u GROUP BY doc_id HAVING max(score) > 0""")
def union_max_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexeme_scores(spark, sf_dir, [0, 1, 2])
    weighted = s.withColumn("score", F.col("score") / F.pow(F.lit(2.0), F.col("item_id")))
    return r.union_max([weighted], "doc_id", "score").select("doc_id", F.round("score", 6).alias("score"))


@query("prefix_join", """ch AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), lambda y: y <> '') AS p FROM pages),
a AS (SELECT page_id, unnest(range(1, len(p) + 1)) AS i, p FROM ch),
s AS (SELECT page_id, array_to_string(list_reverse(p)[1:i], '.') AS ref FROM a)
SELECT ref AS section, count(*) AS pages FROM s WHERE ref IN ('com', 'com.example', 'net.example', 'org') GROUP BY ref""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\."), lambda y: y != "")
    ch = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(parts), ".").alias("ref"))
    causes = spark.createDataFrame([("com",), ("com.example",), ("net.example",), ("org",)], "section string").withColumn("cause", F.col("section"))
    return r.prefix_join(ch, causes, "ref", "section").groupBy(F.col("cause").alias("section")).agg(F.count(F.lit(1)).alias("pages"))


#: The direction words in order, with the question and what they ask for.
WORDS = ", ".join(f"({k}, '{word}', '{kind}', {f"'{want}'" if want else 'NULL'})" for k, (word, (kind, want)) in enumerate(DIRECTIONS.items()))
LEVELS = ("far_below_normal", "below_normal", "normal", "normal", "normal", "above_normal", "far_above_normal")
TRENDS = ("falling", "flat", "flat", "rising", "erratic", "stuck", "rising_sharply", "flat")
MOVES = f"""wo(k, direction, kind, want) AS (VALUES {WORDS}),
mv AS (SELECT DISTINCT l_suppkey % 20 AS fault, l_partkey % 12 AS signal, l_suppkey * 7 % 60 + l_partkey % 12 AS h FROM lineitem),
m1 AS (SELECT fault, signal, kind, want FROM (SELECT fault, signal, min(h) % 21 AS k FROM mv GROUP BY ALL) JOIN wo USING (k)),
ob AS (SELECT o_orderkey AS event, o_custkey % 12 AS signal, {list(LEVELS)}[o_orderkey % 7 + 1] AS level, {list(TRENDS)}[o_orderkey % 8 + 1] AS trend,
         CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS usual FROM orders),
o2 AS (SELECT *, level LIKE '%above%' AS up, level LIKE '%below%' AS down, trend LIKE 'rising%' AS rise, trend LIKE 'falling%' AS fall, trend NOT IN ('flat', 'stuck') AS moved, level = 'normal' AND trend IN ('flat', 'stuck') AS rest,
         CASE WHEN level LIKE '%above%' THEN true WHEN level LIKE '%below%' THEN false ELSE usual END AS reads FROM ob),
n AS (SELECT fault, count(*) AS moves FROM m1 GROUP BY fault),
ve AS (SELECT event, fault, CASE kind
    WHEN 'state' THEN CASE WHEN NOT up AND NOT down THEN 0 WHEN up = (want = 'above') THEN 1 ELSE -1 END
    WHEN 'movement' THEN CASE WHEN (want = 'above' AND (up OR rise)) OR (want = 'below' AND (down OR fall)) THEN 1 WHEN up OR down OR rise OR fall THEN -1 ELSE 0 END
    WHEN 'steady' THEN CASE WHEN level = 'normal' AND trend = 'flat' THEN 1 ELSE -1 END
    WHEN 'unsettled' THEN CASE WHEN trend = 'erratic' THEN 1 WHEN trend IN ('flat', 'stuck') THEN -1 ELSE 0 END
    WHEN 'toggles' THEN CASE WHEN moved THEN 1 WHEN trend = 'stuck' THEN -1 WHEN rest THEN 0 ELSE -1 END
    WHEN 'no_pulse' THEN CASE WHEN trend = 'stuck' THEN 1 WHEN moved THEN -1 WHEN rest THEN 0 ELSE 1 END
    ELSE CASE WHEN kind = 'holds' AND moved THEN -1 WHEN reads IS NULL THEN 0 WHEN reads <> (want = 'on') THEN -1 WHEN rest THEN 0 ELSE 1 END END AS verdict
  FROM m1 JOIN o2 USING (signal)),
j AS (SELECT event, fault, count(*) FILTER (verdict = 1) AS m, count(*) FILTER (verdict = -1) AS c FROM ve GROUP BY ALL),
sc AS (SELECT event, fault, m, c, round(greatest(0, least(1, (m - 0.5 * c) / moves)), 6) AS score FROM j JOIN n USING (fault))"""


def move_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    mv = li.select((F.col("l_suppkey") % 20).alias("fault"), (F.col("l_partkey") % 12).alias("signal"), (F.col("l_suppkey") * 7 % 60 + F.col("l_partkey") % 12).alias("h"))
    mv = mv.groupBy("fault", "signal").agg(pick(DIRECTIONS, F.min("h") % len(DIRECTIONS)).alias("direction"))
    key = F.col("o_orderkey")
    usual = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    ob = o.select(key.alias("event"), (F.col("o_custkey") % 12).alias("signal"), pick(LEVELS, key % 7).alias("level"), pick(TRENDS, key % 8).alias("trend"), usual.alias("usual"))
    return judged_scores(mv, ob).withColumn("score", F.round("score", 6))


@query("move_match_score", f"{MOVES} SELECT event, fault, m AS matches, c AS contradictions, moves - m - c AS silent, score FROM sc JOIN n USING (fault)")
def move_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return move_scores(spark, sf_dir)


@query("rules_decision", f"""{MOVES},
k AS (SELECT *, row_number() OVER w AS rk, lead(s4) OVER w AS nxt FROM (SELECT *, least(1.0, score * 4) AS s4 FROM sc) WINDOW w AS (PARTITION BY event ORDER BY s4 DESC, CAST(fault AS VARCHAR)))
SELECT event, CASE WHEN s4 < 0.34 THEN 'none_of_these' ELSE CAST(fault AS VARCHAR) END AS choice, round(CASE WHEN s4 < 0.34 THEN 0 ELSE s4 * least(1, greatest(0, (s4 - coalesce(nxt, 0)) / 0.3)) END, 5) AS confidence, s4 < 0.34 AS abstained FROM k WHERE rk = 1""")
def rules_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = move_scores(spark, sf_dir).select("event", F.col("fault").cast("string").alias("fault"), F.least(F.lit(1.0), F.col("score") * 4).alias("s4"))
    return r.decide(s, "event", "fault", "s4").withColumn("confidence", F.round("confidence", 5))


@query("probability_shares", f"{MOVES} SELECT event, fault, round(score / nullif(sum(score) OVER (PARTITION BY event), 0), 5) AS share FROM sc")
def probability_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.shares(move_scores(spark, sf_dir), "event", "score").select("event", "fault", F.round("share", 5).alias("share"))


@query("catalog_entry_nested", """l AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS ordinal FROM lineitem GROUP BY ALL)
SELECT p_partkey, any_value(p_name) AS name, string_agg(ordinal || ':' || s_name, '|' ORDER BY ordinal, s_name) AS causes, count(*) AS n FROM l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey""")
def catalog_entry_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("ordinal"))
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    j = link.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    nested = j.groupBy("p_partkey").agg(F.first("p_name").alias("name"), F.array_sort(F.collect_list(F.struct("ordinal", "s_name"))).alias("c"))
    return nested.select("p_partkey", "name", F.array_join(F.transform("c", lambda c: F.concat_ws(":", c.ordinal.cast("string"), c.s_name)), "|").alias("causes"), F.size("c").cast("long").alias("n"))


@query("chunk_sentences", """s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]\\s+'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> '') AS p FROM documents)
SELECT doc_id, len(p) AS sentences, coalesce(list_max(list_transform(p, lambda y: length(y))), 0) AS longest FROM s""")
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("p", sentences(F.col("text"))).select("doc_id", F.size("p").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("p", lambda y: F.length(y))), F.lit(0)).cast("long").alias("longest"))


@query("text_chunks", """p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]\\s+'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> '') AS p FROM documents),
s AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM p),
c AS (SELECT *, len(string_split(sentence, ' ')) AS n, CAST(floor(coalesce(sum(len(string_split(sentence, ' '))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200) AS BIGINT) AS chunk FROM s),
g AS (SELECT doc_id, chunk, CAST(sum(n) AS BIGINT) AS words, string_agg(sentence, '. ' ORDER BY pos) AS t, arg_max(sentence, pos) AS last FROM c GROUP BY ALL)
SELECT doc_id, chunk, words, concat_ws('. ', lag(last) OVER (PARTITION BY doc_id ORDER BY chunk), t) AS text FROM g""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "documents"), 200)


@query("furniture_lines", """l AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(line, '[0-9]+', '#', 'g'))) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT line, count(*) AS docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 3""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(table(spark, sf_dir, "documents"), 3)


@query("section_assignment", """l AS (SELECT conv_id, turn, role, text FROM conversations), h AS (SELECT *, CASE WHEN role = 'user' THEN left(text, 20) END AS head FROM l)
SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS section FROM h""")
def section_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.substring("text", 1, 20)))
    return sections(c, ["conv_id"], ["turn", "role", "text"], "head").select("conv_id", "turn", "section")


@query("answer_store", """a AS (SELECT DISTINCT sha256(role || '|' || text) AS digest FROM conversations WHERE turn = 1) SELECT conv_id, turn, sha256(role || '|' || text) AS digest FROM conversations WHERE sha256(role || '|' || text) IN (SELECT digest FROM a)""")
def answer_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a recorded answer exists for, by digest."""
    c = table(spark, sf_dir, "conversations").withColumn("digest", F.sha2(F.concat_ws("|", "role", "text"), 256)).where("role is not null and text is not null")
    return c.join(c.where("turn = 1").select("digest"), "digest", "left_semi").select("conv_id", "turn", "digest")


@query("token_budget", "n AS (SELECT 1) SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, length(left(text, 800)) AS kept FROM documents")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / 4).alias("tokens"), F.length(F.substring("text", 1, 800)).cast("long").alias("kept"))


@query("trigram_similarity", "p AS (SELECT p_partkey, list_distinct(list_transform(range(1, greatest(2, length(p_name) - 1)), lambda i: substring(p_name, i, 3))) AS g FROM part), q AS (SELECT g AS qg FROM p WHERE p_partkey = 1) SELECT p_partkey, round(len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg))), 6) AS sim FROM p CROSS JOIN q")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))
    p = table(spark, sf_dir, "part").select("p_partkey", grams(F.col("p_name")).alias("g"))
    q = p.where("p_partkey = 1").select(F.col("g").alias("qg"))
    return p.crossJoin(F.broadcast(q)).select("p_partkey", F.round(F.size(F.array_intersect("g", "qg")) / F.size(F.array_union("g", "qg")), 6).alias("sim"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("unit_id", "seq", F.unix_micros("sim_ts").alias("t_us"), "v")


@query("alarm_hysteresis", f"""{TELEMETRY_SQL},
a AS (SELECT unit_id, seq, epoch_us(sim_ts) AS t, v, lag(epoch_us(sim_ts)) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS p FROM tel),
b AS (SELECT *, sum(CASE WHEN t - p > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seg FROM a),
k AS (SELECT *, sum(CASE WHEN v <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, seg ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS isl FROM b),
i AS (SELECT *, min(CASE WHEN v > 60 THEN t END) OVER (PARTITION BY unit_id, seg, isl) AS since FROM k),
w AS (SELECT *, CASE WHEN v > 60 AND t - since >= 600000000 THEN 1 WHEN v < 40 THEN 0 END AS word FROM i),
u AS (SELECT *, coalesce(last_value(word IGNORE NULLS) OVER (PARTITION BY unit_id, seg ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS up FROM w),
x AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY unit_id, seg ORDER BY t, seq), 0) AS was, coalesce(lag(up) OVER (PARTITION BY unit_id ORDER BY t, seq), 0) AS any_was, lag(seg) OVER (PARTITION BY unit_id ORDER BY t, seq) AS pseg FROM u),
y AS (SELECT *, last_value(CASE WHEN up > was THEN since END IGNORE NULLS) OVER (PARTITION BY unit_id, seg ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS raised FROM x)
SELECT unit_id, seq, t AS t_us, 'raise' AS kind, since AS since_us FROM y WHERE up > was
UNION ALL SELECT unit_id, seq, t, 'clear', raised FROM y WHERE up < was
UNION ALL SELECT unit_id, seq, t, 'reset', p FROM y WHERE seg <> pseg AND any_was = 1""")
def alarm_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hysteresis_events(samples(spark, sf_dir), 60.0, 40.0, 600, 7200)


@query("redecision_cadence")
def redecision_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.run_batch(samples(spark, sf_dir), stateful.Cadence(50.0, 3600, 14400))


#: Firing by firing: a decision opens an hour in which none follows, a silence of four hours opens anew.
SQL["redecision_cadence"] = f"""WITH RECURSIVE {TELEMETRY_SQL},
f AS (SELECT unit_id, seq, epoch_us(sim_ts) AS t, row_number() OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS n FROM tel WHERE v > 50),
r AS (
  SELECT unit_id, n, seq, t, t AS decided, 'open' AS kind, t AS since FROM f WHERE n = 1
  UNION ALL
  SELECT f.unit_id, f.n, f.seq, f.t, CASE WHEN f.t - r.t > 14400000000 OR f.t - r.decided >= 3600000000 THEN f.t ELSE r.decided END,
         CASE WHEN f.t - r.t > 14400000000 THEN 'open' WHEN f.t - r.decided >= 3600000000 THEN 'decide' END, CASE WHEN f.t - r.t > 14400000000 THEN f.t ELSE r.decided END
  FROM r JOIN f ON f.unit_id = r.unit_id AND f.n = r.n + 1)
SELECT unit_id, seq, t AS t_us, kind, since AS since_us FROM r WHERE kind IS NOT NULL"""


@query("heartbeat_silence", f"""{TELEMETRY_SQL}, g AS (SELECT unit_id, sim_ts, lag(sim_ts) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS p FROM tel)
SELECT unit_id, epoch_us(p) + 5400000000 AS raised_us, epoch_us(sim_ts) AS cleared_us FROM g WHERE epoch_us(sim_ts) - epoch_us(p) > 5400000000""")
def heartbeat_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of over 90 minutes: raised when the time ran out, cleared by the next sample."""
    before = F.lag(F.unix_micros("sim_ts")).over(Window.partitionBy("unit_id").orderBy("sim_ts", "seq"))
    g = telemetry(spark, sf_dir).select("unit_id", F.unix_micros("sim_ts").alias("cleared_us"), before.alias("p"))
    return g.where(F.col("cleared_us") - F.col("p") > 5400000000).select("unit_id", (F.col("p") + 5400000000).alias("raised_us"), "cleared_us")


@query("failure_streaks", f"""{TELEMETRY_SQL},
s AS (SELECT *, tag = 'error' AS bad, row_number() OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) - row_number() OVER (PARTITION BY unit_id, tag = 'error' ORDER BY sim_ts, seq) AS g FROM tel)
SELECT unit_id, min(seq) AS first_seq, count(*) AS n FROM s WHERE bad GROUP BY unit_id, g HAVING count(*) >= 3""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("tag") == "error"
    whole = F.row_number().over(Window.partitionBy("unit_id").orderBy("sim_ts", "seq"))
    own = F.row_number().over(Window.partitionBy("unit_id", bad).orderBy("sim_ts", "seq"))
    s = telemetry(spark, sf_dir).withColumn("g", whole - own).where(bad)
    return s.groupBy("unit_id", "g").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("g")
