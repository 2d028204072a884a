"""Signal moves that a fault expects, judged against observed levels and trends: match, contradiction or silence.

A direction word asks one of eight questions: a state (which side of its band), a movement (sits there or heads there), steady,
unsettled, and for digitals a reading, a value held, toggling and no pulse. Silence is an outcome of its own: it scores
nothing, but the divisor still counts the move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each direction's question, and the side or value it asks for.
DIRECTIONS = {
    "rises": ("movement", "above"), "falls": ("movement", "below"), "high": ("state", "above"), "low": ("state", "below"),
    "unchanged": ("steady", None), "fluctuates": ("unsettled", None), "near_zero": ("state", "below"), "not_venting": ("state", "above"),
    "on": ("reads", "on"), "off": ("reads", "off"), "stays_on": ("holds", "on"), "stays_off": ("holds", "off"),
    "toggles": ("toggles", None), "no_pulse": ("no_pulse", None), "higher": ("state", "above"), "lower": ("state", "below"),
    "longer": ("state", "above"), "shorter": ("state", "below"), "faster": ("state", "above"), "slower": ("state", "below"), "not_reached": ("state", "below"),
}
#: Levels and trends by side.
ABOVE, BELOW = ("above_normal", "far_above_normal"), ("below_normal", "far_below_normal")
RISING, FALLING = ("rising", "rising_sharply"), ("falling", "falling_sharply")
#: Fixed value: a contradiction costs half a match.
CONTRADICTION = 0.5


def _side(word: Column, above: tuple, below: tuple) -> Column:
    return F.when(word.isin(*above), "above").when(word.isin(*below), "below")


def verdict(direction: Column, level: Column, trend: Column, usual: Column) -> Column:
    """``match``, ``contradiction`` or ``silent``; null for an unknown direction.

    ``usual`` is the only value a digital may show at a normal level in the machine's mode, null where either may be.
    An observation without level or trend is silent.
    """
    return _judged(*_question(direction), level, trend, usual)


def _question(direction: Column) -> tuple[Column, Column]:
    """A direction's question, and the side or value it asks for."""
    table = F.create_map(*[F.lit(x) for word, (kind, _) in DIRECTIONS.items() for x in (word, kind)])
    asked = F.create_map(*[F.lit(x) for word, (_, what) in DIRECTIONS.items() if what for x in (word, what)])
    return F.element_at(table, direction), F.element_at(asked, direction)


def _judged(kind: Column, want: Column, level: Column, trend: Column, usual: Column) -> Column:
    at, heading = _side(level, ABOVE, BELOW), _side(trend, RISING, FALLING)
    moved = ~trend.isin("flat", "stuck")
    resting = (level == "normal") & ~moved
    match, contradiction, silent = F.lit("match"), F.lit("contradiction"), F.lit("silent")
    value = F.coalesce(at == "above", usual)
    reads = F.when(value.isNull(), silent).when(value != (want == "on"), contradiction).when(resting, silent).otherwise(match)
    return (
        F.when(kind.isNull(), F.lit(None))
        .when(level.isNull() | trend.isNull(), silent)
        .when(kind == "state", F.when(at.isNull(), silent).when(at == want, match).otherwise(contradiction))
        .when(kind == "movement", F.when(at.eqNullSafe(want) | heading.eqNullSafe(want), match).when(at.isNull() & heading.isNull(), silent).otherwise(contradiction))
        .when(kind == "steady", F.when((level == "normal") & (trend == "flat"), match).otherwise(contradiction))
        .when(kind == "unsettled", F.when(trend == "erratic", match).when(trend.isin("flat", "stuck"), contradiction).otherwise(silent))
        .when(kind == "reads", reads)
        .when(kind == "holds", F.when(moved, contradiction).otherwise(reads))
        .when(kind == "toggles", F.when(moved, match).when(trend == "stuck", contradiction).when(resting, silent).otherwise(contradiction))
        .otherwise(F.when(trend == "stuck", match).when(moved, contradiction).when(resting, silent).otherwise(match))
    )


def judged_scores(moves: DataFrame, observed: DataFrame) -> DataFrame:
    """(event, fault, matches, contradictions, silent, score) of the faults whose moves meet an observation of the event.

    ``moves`` has fault, signal and direction; ``observed`` has event, signal, level, trend and usual, a signal once an event.
    Observations are dealt by event before they meet the moves, a catalogue that is broadcast, so neither their faults nor
    what is made of an event's faults later is dealt again. The number of parts is the session's: small as they are
    before they meet the moves, they would be put together again.
    """
    kind, want = _question(F.col("direction"))
    n = moves.groupBy("fault").agg(F.count(F.lit(1)).alias("moves"))
    asked = moves.select("fault", "signal", kind.alias("kind"), want.alias("want")).join(F.broadcast(n), "fault")
    parts = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = observed.select("event", "signal", "level", "trend", "usual").repartition(parts, "event").join(F.broadcast(asked), "signal")
    judged = met.withColumn("verdict", _judged(F.col("kind"), F.col("want"), F.col("level"), F.col("trend"), F.col("usual")))
    count = lambda v: F.count_if(F.col("verdict") == v)
    tally = judged.groupBy("event", "fault").agg(count("match").alias("matches"), count("contradiction").alias("contradictions"), F.max("moves").alias("moves"))
    raw = (F.col("matches") - CONTRADICTION * F.col("contradictions")) / F.col("moves")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return tally.select("event", "fault", "matches", "contradictions", (F.col("moves") - F.col("matches") - F.col("contradictions")).alias("silent"), score.alias("score"))
