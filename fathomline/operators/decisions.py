"""Decisions: stage merge, catalog stage, observation choice, display probabilities, answers, gate and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE_OF_THESE = "none_of_these"
#: The severity levels from least to worst; fixed values.
SEVERITY = ("low", "medium", "high", "critical")
CONDITION_BONUS, CO_SYMPTOM_BONUS = 0.15, 0.05
TIE_MARGIN, INCONSISTENT_BELOW = 0.05, 0.4
MAX_OBSERVATIONS = 12


def merge_stages(entries: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Every entry with one score a stage, 0 where the stage doesn't know it; a stage has (key, score), keys once."""
    out = entries
    for name, scores in stages.items():
        out = out.join(scores.select(key, F.col("score").alias(name)), key, "left").fillna(0.0, [name])
    return out


def catalog_score(moves: Column, conditions: Column, symptom: Column, co_symptoms: Column) -> Column:
    """The move score, and a bonus each for an entry filed under the symptom and under any co-symptom.

    Null conditions or co-symptoms count as none.
    """
    filed = F.coalesce(F.array_contains(conditions, symptom), F.lit(False))
    beside = F.coalesce(F.arrays_overlap(conditions, co_symptoms), F.lit(False))
    return moves + F.when(filed, CONDITION_BONUS).otherwise(0.0) + F.when(beside, CO_SYMPTOM_BONUS).otherwise(0.0)


def choose_observations(observed: DataFrame, event: str, most: int = MAX_OBSERVATIONS) -> DataFrame:
    """Named or moving observations of each event, named ones first, then by magnitude, then by index."""
    w = Window.partitionBy(event).orderBy(F.desc("named"), F.desc("magnitude"), "index")
    return observed.where("named or moving").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def display_probabilities(support: DataFrame, query: str, key: str, score: str) -> DataFrame:
    """(query, key, probability): the supports and what the best of them leaves to none of these, normalised.

    Where nothing has any mass, all of it is on none of these.
    """
    own = F.collect_list(F.struct(F.col(key).alias("key"), F.col(score).cast("double").alias("score")))
    left = 1 - F.greatest(F.lit(0.0), F.max(score))
    each = support.groupBy(query).agg(own.alias("_own"), left.alias("_left"), (F.coalesce(F.sum(score), F.lit(0.0)) + left).alias("_total"))
    none = F.array(F.struct(F.lit(NONE_OF_THESE).alias("key"), F.col("_left").alias("score")))
    every = each.select(query, "_total", F.inline(F.concat("_own", none)))
    empty = F.when(F.col("key") == NONE_OF_THESE, 1.0).otherwise(0.0)
    return every.select(query, F.col("key").alias(key), F.when(F.col("_total") <= 0, empty).otherwise(F.try_divide("score", "_total")).alias("probability"))


def _ranked(mass: Column) -> Column:
    """A map's keys from most to least mass, ties to the smaller key, as (less, key)."""
    return F.array_sort(F.transform(F.map_entries(mass), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"))))


def read_answers(answers: DataFrame) -> DataFrame:
    """``answers`` with decided, tie_broken, inconsistent and level.

    It has choice, probabilities and support (maps by option) and severity (a map by level number).
    When the two likeliest options are within the margin and both have a support of their own, the
    better supported one is decided; an equal support leaves the choice.
    """
    two = _ranked(F.col("probabilities"))
    first, second = F.get(two, 0), F.get(two, 1)
    s1, s2 = F.try_element_at("support", first["key"]), F.try_element_at("support", second["key"])
    apart = second["less"] - first["less"] > TIE_MARGIN
    choice = F.col("choice")
    decided = F.when(second.isNull() | apart | s1.isNull() | s2.isNull() | (s1 == s2), choice).when(s2 > s1, second["key"]).otherwise(first["key"])
    out = answers.withColumn("decided", decided).withColumn("tie_broken", F.col("decided") != choice)
    named = F.when(F.col("decided") != NONE_OF_THESE, F.try_element_at("support", F.col("decided")))
    worst = F.get(_ranked(F.col("severity")), 0)["key"].cast("int")
    return out.withColumn("inconsistent", F.coalesce(named < INCONSISTENT_BELOW, F.lit(False))).withColumn("level", F.get(F.array(*[F.lit(s) for s in SEVERITY]), worst))


def worst_hint(rule_ids: Column, hints: dict[str, str]) -> Column:
    """The worst severity hinted by any of the rules; the least where none has a hint."""
    table = F.create_map(*[F.lit(v) for rule, level in hints.items() for v in (rule, SEVERITY.index(level))])
    score = F.array_max(F.transform(rule_ids, lambda r: F.coalesce(F.try_element_at(table, r), F.lit(0))))
    return F.get(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce(score, F.lit(0)))


def abstained(choice: Column, confidence: Column, review: float = 0.60) -> Column:
    """Whether a decision is sure that no candidate fits."""
    return (choice == NONE_OF_THESE) & (confidence.cast("double") >= review)


def recordset(df: DataFrame, keys: list[str], json_col: str, schema: str) -> DataFrame:
    """A row for each object of a JSON array, with the columns of the DDL ``schema``; null or damaged text has none."""
    return df.select(*keys, F.inline(F.from_json(json_col, f"array<struct<{schema}>>")))


def live_episodes(episodes: DataFrame, tickets: DataFrame) -> DataFrame:
    """Episodes that are open or whose ticket is, with the ticket they have or are named by.

    ``episodes`` has episode_id, status, ticket_id, closed_by_technician; ``tickets`` has episode_id,
    ticket_id and status, one row an episode at most.
    """
    t = tickets.select("episode_id", F.col("ticket_id").alias("_ticket"), F.col("status").alias("_status"))
    closed = F.col("closed_by_technician") | F.coalesce(F.col("_status") == "closed", F.lit(False))
    live = (F.col("status") == "open") | F.coalesce(F.col("_status").isin("review", "open"), F.lit(False))
    out = episodes.join(t, "episode_id", "left").where(live)
    return out.withColumn("ticket_id", F.coalesce("ticket_id", "_ticket")).withColumn("closed_by_technician", closed).drop("_ticket", "_status")


def merged_sets(df: DataFrame, key: str, arrays: str) -> DataFrame:
    """The distinct values of all arrays of a key, sorted; repeats go before anything is gathered."""
    each = df.select(key, F.explode(arrays).alias("_v")).distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias(arrays))


def headline_check(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: the sorted ids detected and missed among the wanted windows, and whether none was missed.

    ``wanted`` is a hand-labelled registry, so its ids fit a row; none wanted does not pass.
    """
    hit = found.select(key).distinct().withColumn("_hit", F.lit(True))
    ids = wanted.select(key).distinct().join(hit, key, "left")
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(key))))
    out = ids.agg(of(F.col("_hit")).alias("detected"), of(F.col("_hit").isNull()).alias("missed"))
    return out.withColumn("pass", (F.size("detected") > 0) & (F.size("missed") == 0))
