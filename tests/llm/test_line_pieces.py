"""Lines and their band keys: cheaper expressions with the values that the plain ones have."""

import random

from pyspark.sql import functions as F

from fathomline.llm import line_dedup as d


def test_lines_lose_outer_blanks_tabs_and_returns_and_nothing_else(spark):
    texts = ["a \t\r\n \tb\t c \r\n\t \r\n\n d \n　e\x0b", "\r\n", " ", "x\r\r \t", "\t\t", "plain"]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "id long, text string")
    got = {(r.id, r.pos): r.line for r in d._lines(docs, "id", "text").collect()}
    assert got == {(i, p): line.strip(" \t\r") for i, t in enumerate(texts) for p, line in enumerate(t.split("\n")) if line.strip(" \t\r")}


def test_only_lines_with_tabs_or_returns_at_an_end_are_trimmed_by_a_set(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    plan = d._lines(docs, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    by_set = plan.count(", Some( \t\r))")
    assert by_set and plan.count("StartsWith") >= 2 * by_set


def test_band_keys_are_those_of_the_smallest_hashes_of_each_range(spark):
    lines = ["w", "eight ch", *["".join(chr(97 + i * j * j % 26) for j in range(n)) for i, n in enumerate([9, 20, 23, 24, 26, 27, 60, 103, 104, 400], 1)]]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", d._band_keys(F.col("line")).alias("bands"), d._hashes(F.col("line")).alias("h")).collect()
    bounds = [-(1 << 63), *d._BOUNDS, 1 << 63]
    wanted = []
    for r in rows:
        n, part = len(r.h), (1 << 64) // d.BANDS - 1
        most = int(part / n * d.BANDS * d.ENOUGH)  # of a long line only the low part of a range counts
        kept = sorted({v for v in r.h if n <= d.BANDS * d.ENOUGH or v & part < most} | set(d._BOUNDS))
        sizes = [d.ROWS] * (n > d.FEW - 4) + [d.SHORT_ROWS] * (n < d.FEW)
        for size in sizes:
            for b in range(d.BANDS):
                at = 0 if b == 0 else kept.index(bounds[b]) + 1
                if at < len(kept) and kept[at] != bounds[b + 1]:
                    wanted.append((r.line, size, b, kept[at : at + size]))
    keyed = spark.createDataFrame(wanted, "line string, size int, b int, hashes array<long>").select("line", F.xxhash64("size", "b", "hashes").alias("key"))
    by = {line: [] for line in lines}
    for r in keyed.collect():
        by[r.line].append(r.key)
    assert {r.line: sorted(r.bands) for r in rows} == {line: sorted(keys) for line, keys in by.items()}


def _words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


def _shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def test_lines_of_many_words_make_keys_of_the_shingles_that_begin_a_word(spark):
    rng = random.Random(1)
    many, few, between = _words(rng, 60), _words(rng, 9), _words(rng, d.STARTS + 3)
    unbroken = _words(rng, 60).replace(" ", "") + " " + _words(rng, d.STARTS + 30)[:150]
    docs = spark.createDataFrame(list(enumerate([many, few, between, unbroken])), "id long, text string")
    lines = d._lines(docs, "id", "text")
    rows = d._signed(lines).join(lines.select("h1", "line", d._band_keys(F.col("line")).alias("full"), F.size(d._start_hashes(F.col("line"))).alias("c")), "h1").collect()
    got = {r.line: ({k for k in r.bands if k is not None}, set(r.full), r.c) for r in rows}
    held, full, c = got[many]
    assert c == len({(" " + many)[i + 1 : i + 9] for i in range(len(many) - 7) if (" " + many)[i] == " "}) and 0 < len(held) <= d.BANDS and not held & full
    assert got[few][0] == got[few][1]
    assert got[between][1] < got[between][0]
    assert got[unbroken][1] <= got[unbroken][0]


def test_near_lines_go_and_others_stay_whichever_keys_they_make(spark):
    rng = random.Random(2)
    lines, tests = [], []
    while len(tests) < 400:
        line = _words(rng, rng.choice([6, 12, 17, 20, 25, 40, 90, 250]))
        words = line.split(" ")
        for _ in range(rng.randint(1, max(1, len(words) // 6))):
            words[rng.randrange(len(words))] = _words(rng, 1)
        other = " ".join(words)
        x, y = _shingles(line), _shingles(other)
        if line != other:
            tests.append(100 * len(x & y) >= 80 * len(x | y))
            lines += [line, other]
    out = {r.id: r.text for r in d.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "id long, text string"), "id").collect()}
    assert all(out[2 * i] for i in range(len(tests)))
    gone = [out[2 * i + 1] == "" for i in range(len(tests))]
    assert sum(tests) > 80 and not any(g and not t for g, t in zip(gone, tests))
    assert sum(gone) >= 0.97 * sum(tests)
