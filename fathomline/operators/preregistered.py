"""Choice among triples of thresholds by a rule that was fixed beforehand, over seeded resamples of whole days.

A resample weighs each day by a Poisson draw of mean one from the hash of seed, resample and day, so all resamples come from one pass
over sums by day: nothing is drawn on the driver. A triple qualifies if its rates keep within the limits on
every resample; those that do are ranked by median positives, then by fewer false reviews and tickets, then by the incumbent's persistence,
then by nearness to the incumbent, then by higher thresholds. Figures that agree to nine decimals are equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a, fnv1a_long, uniform

#: Draws of more than this many copies of a day are too rare to matter: less than one in ten million.
MOST_COPIES = 9
TRIPLE = ("persist", "ticket", "review")


def poisson_one(u: Column) -> Column:
    """The Poisson value of mean one at a uniform value, by its distribution."""
    out, total = F, 0.0
    for k in range(MOST_COPIES):
        total += math.exp(-1) / math.factorial(k)
        out = out.when(u < total, k)
    return out.otherwise(MOST_COPIES)


def resampled(by_day: DataFrame, figures: list[str], resamples: int, seed: str) -> DataFrame:
    """(triple, resample, days, figures...): weighted sums of ``by_day`` (triple, day, figures) for each resample.

    The hash is folded twice over the resample, since its last byte alone moves only the lower bits.
    """
    days = by_day.select("day").distinct().withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    k = F.col("resample").cast("long")
    drawn = uniform(fnv1a_long(k, fnv1a_long(F.col("day").cast("long"), fnv1a_long(k, fnv1a(F.lit(seed))))))
    each = by_day.join(days.withColumn("_w", poisson_one(drawn)), "day")
    return each.groupBy(*TRIPLE, "resample").agg(F.sum("_w").alias("days"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in figures])


def triple_verdicts(rates: DataFrame, incumbent: tuple[float, float, float], max_tickets: float, max_reviews: float) -> DataFrame:
    """(triple, worst_tickets, worst_reviews, median_positives, qualifies, rank): rank 1 is the choice, null does not qualify.

    ``rates`` has a row a triple and resample: positives, false_tickets and false_reviews a day.
    """
    half = lambda c: F.round(F.percentile(c, 0.5), 9)
    figures = rates.groupBy(*TRIPLE).agg(
        F.round(F.max("false_tickets"), 9).alias("worst_tickets"),
        F.round(F.max("false_reviews"), 9).alias("worst_reviews"),
        half("positives").alias("median_positives"),
        half("false_reviews").alias("_reviews"),
        half("false_tickets").alias("_tickets"),
    )
    ok = (F.col("worst_tickets") <= max_tickets) & (F.col("worst_reviews") <= max_reviews)
    other = (F.col("persist") != incumbent[0]).cast("int")
    far = F.round(F.abs(F.col("ticket") - incumbent[1]) + F.abs(F.col("review") - incumbent[2]), 9)
    order = [F.desc("median_positives"), F.asc("_reviews"), F.asc("_tickets"), other, far, F.desc("ticket"), F.desc("review"), F.desc("persist")]
    place = F.row_number().over(Window.partitionBy("qualifies").orderBy(*order))  # one row a triple of the grid
    judged = figures.withColumn("qualifies", ok).withColumn("_place", place)
    return judged.withColumn("rank", F.when(F.col("qualifies"), F.col("_place"))).drop("_place", "_reviews", "_tickets")
