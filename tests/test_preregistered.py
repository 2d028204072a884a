"""The choice among triples by hand, and its resamples against a loop."""

import math
from collections import Counter

from pyspark.sql import functions as F

from fathomline.operators import preregistered as pre

RATE = "persist int, ticket double, review double, resample int, positives double, false_tickets double, false_reviews double"


def verdicts(spark, triples, incumbent=(1, 0.85, 0.6)):
    rows = [(p, t, r, k, *map(float, x)) for (p, t, r), each in triples.items() for k, x in enumerate(each)]
    got = pre.triple_verdicts(spark.createDataFrame(rows, RATE), incumbent, 1.0, 2.0).collect()
    return {(r.persist, r.ticket, r.review): r["rank"] for r in got}


def test_worst_resample_decides_on_the_limits(spark):
    got = verdicts(spark, {(1, 0.85, 0.6): [(1, 1.0, 2.0), (9, 0, 0)], (1, 0.9, 0.6): [(9, 1.1, 0), (9, 0, 0)], (1, 0.8, 0.6): [(9, 0, 2.1), (9, 0, 0)]})
    assert got == {(1, 0.85, 0.6): 1, (1, 0.9, 0.6): None, (1, 0.8, 0.6): None}


def test_ties_in_their_order(spark):
    same = [(5, 0.5, 1), (7, 0.5, 1)]
    got = verdicts(
        spark,
        {
            (1, 0.85, 0.6): same,  # the incumbent is nearest to itself
            (1, 0.9, 0.6): same,
            (1, 0.8, 0.6): same,  # as near as 0.9, lower
            (2, 0.85, 0.6): same,  # another persistence
            (0, 0.85, 0.5): [(5, 0.5, 0.9), (7, 0.5, 0.9)],  # fewer reviews
            (0, 0.85, 0.7): [(6, 0.5, 2), (7, 0.5, 2)],  # more positives
            (0, 0.8, 0.7): [(5, 0.4, 1), (7, 0.4, 1)],  # fewer tickets
        },
    )
    assert sorted(got, key=got.get) == [(0, 0.85, 0.7), (0, 0.85, 0.5), (0, 0.8, 0.7), (1, 0.85, 0.6), (1, 0.9, 0.6), (1, 0.8, 0.6), (2, 0.85, 0.6)]


def fnv(data, x=14695981039346656037):
    for byte in data:
        x = ((x ^ byte) * 1099511628211) % 2**64
    return x


def test_resamples_equal_a_loop(spark):
    rows = [(p, 0.85, 0.6, day, day % 7, day % 3) for p in (0, 1) for day in range(19000, 19200)]
    got = pre.resampled(spark.createDataFrame(rows, "persist int, ticket double, review double, day int, a int, b int"), ["a", "b"], 30, "s")
    weights = {}
    for k in range(30):
        for day in range(19000, 19200):
            u = (fnv(b"s" + k.to_bytes(8, "big") + day.to_bytes(8, "big") + k.to_bytes(8, "big")) >> 11) / 2**53
            total, n = 0.0, 0
            while n < pre.MOST_COPIES and u >= (total := total + math.exp(-1) / math.factorial(n)):
                n += 1
            weights[k, day] = n
    want = {(p, k): tuple(sum(w * f(d) for (j, d), w in weights.items() if j == k) for f in (lambda d: 1, lambda d: d % 7, lambda d: d % 3)) for p in (0, 1) for k in range(30)}
    assert {(r.persist, r.resample): (r.days, r.a, r.b) for r in got.collect()} == want
    counts = Counter(weights.values())
    assert abs(sum(weights.values()) / 6000 - 1) < 0.05 and abs(counts[0] / 6000 - math.exp(-1)) < 0.03
    assert got.where(F.col("days") == 0).count() == 0
