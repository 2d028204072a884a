"""Verdicts over scored scenarios: detection, diagnosis at review and at ticket level, the core gate, and the design reading.

Tables are joined on the scenario, instants with windows by a residual; each ticket and suspect is reduced to flags before it is
counted, so windows that overlap count nothing twice. Instants are in microseconds; a window is half-open.

``scenarios``: scenario, kind (positive, negative or benign), expect_none, max_false, fault (listed, any or benign_or_none), deadline_us or null.
``windows``: scenario, window_id, from_us, to_us, accepted (array), deadline_us or null, the latest suspect that counts.
``suspects``: scenario, t_us. ``tickets``: scenario, ticket_id, opened_us, level (review or ticket), fault, benign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import NONE_OF_THESE

#: The core gate's least numbers of passed scenarios and passed positives.
MIN_SCENARIOS, MIN_POSITIVES = 8, 5


def _within(at: str) -> Column:
    return (F.col(at) >= F.col("from_us")) & (F.col(at) < F.col("to_us"))


def _dealt(df: DataFrame) -> DataFrame:
    """The rows by scenario, in as many parts as the session's shuffles have. All joins and counts follow on these parts in one stage, whose
    memory is theirs together, so that small parts must not be put together again by their size on disk.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scenario")


def ticket_flags(tickets: DataFrame, windows: DataFrame) -> DataFrame:
    """The tickets with ``inside`` and ``hit``: in some window, and in one that accepts their fault."""
    w = windows.select(F.col("scenario").alias("_s"), "from_us", "to_us", "accepted")
    met = tickets.join(w, (F.col("scenario") == F.col("_s")) & _within("opened_us"), "left")
    own = ["scenario", "ticket_id", "opened_us", "level", "fault", "benign"]
    hit = F.array_contains("accepted", F.col("fault"))
    return met.groupBy(*own).agg(F.bool_or(F.col("_s").isNotNull()).alias("inside"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))


def scenario_verdicts(scenarios: DataFrame, windows: DataFrame, suspects: DataFrame, tickets: DataFrame) -> DataFrame:
    """(scenario, kind, detection, review_diagnosis, diagnosis), each whether the scenario passes at that level."""
    windows, suspects, tickets = _dealt(windows), _dealt(suspects), _dealt(tickets)
    w = windows.select(F.col("scenario").alias("_s"), "window_id", "from_us", "to_us", F.col("deadline_us").alias("_by"))
    seen = suspects.join(w, (F.col("scenario") == F.col("_s")) & _within("t_us"), "left")
    in_time = F.col("_s").isNotNull() & (F.col("_by").isNull() | (F.col("t_us") <= F.col("_by")))
    seen = seen.groupBy("scenario").agg(F.bool_or(in_time).alias("detected"), F.bool_or(F.col("_s").isNull()).alias("stray"))
    by = F.col("deadline_us")
    early = by.isNull() | (F.col("opened_us") <= by)
    flags = ticket_flags(tickets, windows).join(scenarios.select("scenario", "deadline_us"), "scenario")
    ripe = F.col("inside") & (F.col("level") == "ticket")
    first = F.min(F.when(ripe, F.struct("opened_us", "ticket_id", "hit", "benign")))
    counted = flags.groupBy("scenario").agg(
        F.bool_or(F.col("hit") & early).alias("tp_in_time"),
        F.count_if(~F.col("hit") & ~F.col("benign")).alias("fp"),
        first.alias("first"),
    )
    every = scenarios.join(seen, "scenario", "left").join(counted, "scenario", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    fp = F.coalesce("fp", F.lit(0))
    review = F.when(F.col("expect_none"), fp == 0).otherwise(yes(F.col("tp_in_time")) & (fp <= F.col("max_false")))
    detection = F.when(F.col("kind") == "positive", yes(F.col("detected"))).when(F.col("kind") == "negative", ~yes(F.col("stray"))).otherwise(review)
    named = F.when(F.col("fault") == "any", True).when(F.col("fault") == "benign_or_none", F.col("first.benign")).otherwise(F.col("first.hit"))
    ticket = F.when(F.col("expect_none"), True).otherwise(yes(F.col("first").isNotNull() & named & (by.isNull() | (F.col("first.opened_us") <= by))))
    return every.select("scenario", "kind", detection.alias("detection"), review.alias("review_diagnosis"), (review & ticket).alias("diagnosis"))


def core_gate(verdicts: DataFrame, expected: DataFrame, level: str, scenarios: int = MIN_SCENARIOS, positives: int = MIN_POSITIVES) -> DataFrame:
    """(gate, passed, total, positives_passed, missing, pass) of each gate's expected scenarios; a missing one has failed.

    ``expected`` has gate, scenario and positive.
    """
    held = verdicts.select("scenario", F.col(level).alias("_ok"), F.lit(True).alias("_there"))
    ok = F.coalesce("_ok", F.lit(False))
    out = expected.join(held, "scenario", "left").groupBy("gate").agg(
        F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"), F.count_if(ok & F.col("positive")).alias("positives_passed"), F.count_if(F.col("_there").isNull()).alias("missing")
    )
    return out.withColumn("pass", (F.col("passed") >= scenarios) & (F.col("positives_passed") >= positives))


def design_reading(targets: DataFrame, episodes: DataFrame, tickets: DataFrame) -> DataFrame:
    """(scenario, level, on_target, off_target, benign, outside, first_ticket, met) of tickets inside unlabelled episodes.

    ``targets`` has scenario and accepted (array), ``episodes`` scenario, from_us and to_us. Every ticket takes part at review level,
    those of level ticket at ticket level too. Met: the first ticket inside names an accepted fault.
    """
    episodes, tickets = _dealt(episodes), _dealt(tickets)
    ep = episodes.select(F.col("scenario").alias("_s"), "from_us", "to_us")
    at = tickets.join(ep, (F.col("scenario") == F.col("_s")) & _within("opened_us"), "left")
    at = at.groupBy("scenario", "ticket_id", "opened_us", "level", "fault", F.col("benign").alias("_benign")).agg(F.bool_or(F.col("_s").isNotNull()).alias("inside"))
    at = at.join(targets, "scenario").withColumn("hit", F.array_contains("accepted", F.col("fault")))
    both = at.withColumn("at", F.explode(F.when(F.col("level") == "ticket", F.array(F.lit("review"), F.lit("ticket"))).otherwise(F.array(F.lit("review")))))
    inside = F.col("inside")
    read = both.groupBy("scenario", F.col("at").alias("level")).agg(
        F.count_if(inside & F.col("hit")).alias("on_target"),
        F.count_if(inside & ~F.col("hit") & ~F.col("_benign")).alias("off_target"),
        F.count_if(inside & ~F.col("hit") & F.col("_benign")).alias("benign"),
        F.count_if(~inside).alias("outside"),
        F.min(F.when(inside, F.struct("opened_us", "ticket_id", "hit"))).alias("_first"),
    )
    # a level without tickets is read as zeros
    levels = targets.select("scenario", F.explode(F.array(F.lit("review"), F.lit("ticket"))).alias("level"))
    read = levels.join(read, ["scenario", "level"], "left").fillna(0, ["on_target", "off_target", "benign", "outside"])
    return read.select("scenario", "level", "on_target", "off_target", "benign", "outside", F.col("_first.ticket_id").alias("first_ticket"), F.coalesce("_first.hit", F.lit(False)).alias("met"))


def design_choices(targets: DataFrame, episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(scenario, choice, n, on_target) of decisions (scenario, decision_id, t_us, choice) inside unlabelled episodes."""
    episodes, decisions = _dealt(episodes), _dealt(decisions)
    ep = episodes.select(F.col("scenario").alias("_s"), "from_us", "to_us")
    inside = decisions.join(ep, (F.col("scenario") == F.col("_s")) & _within("t_us"), "left_semi").join(targets, "scenario")
    hit = (F.col("choice") != NONE_OF_THESE) & F.array_contains("accepted", F.col("choice"))
    return inside.groupBy("scenario", "choice").agg(F.count(F.lit(1)).alias("n"), F.bool_or(hit).alias("on_target"))
