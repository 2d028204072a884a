"""Periodic runs against all lags compared word by word, and the query's digests against a plain reading of its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm.periodic_runs import find_runs, lag_counts, word_runs
from fathomline.llm.queries import op13_periods


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            s = w[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(s[x:] == s[:-x] for x in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def mixed(r, n):
    w = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(n)]
    for _ in range(r.randrange(4)):
        x = [r.randrange(4) for _ in range(r.choice([1, 2, 3, 5, 8, 20, 33, 40, 70]))]
        at = r.randrange(len(w) + 1)
        w[at:at] = (x * r.randrange(2, 9))[: r.randrange(1, 600)]
    return w


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    w = mixed(r, r.choice([0, 5, 6, 7, 12, 30, 60, 150, 400]))
    codes = np.array(w, np.int64)
    assert word_runs(codes) == brute(w)
    most = len(w) // 4
    counts = lag_counts(codes, most) if w else []
    assert all(counts[q] == sum(a == b for a, b in zip(w, w[q:])) for q in range(1, most + 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_few_words(w):
    assert word_runs(np.array(w, np.int64)) == brute(w)


@pytest.mark.parametrize("n", [4_000, 60_000])
def test_heavy_and_light_words_count_alike(n):
    codes = np.random.default_rng(n).choice([0] * 50 + list(range(1, 400)), n)
    counts = lag_counts(codes, n // 4)
    for q in (1, 2, 3, 17, 500, n // 8, n // 4):
        assert counts[q] == (codes[q:] == codes[:-q]).sum()


def test_very_long_texts(spark):
    cases = ["a " * 300_000, "a b c " * 100_000, " ".join(map(str, range(200_000))), ("a " * 3000 + "b ") * 50]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in find_runs(rows).collect()}
    shown = lambda k: [(x.start, x.length, x.period) for x in got[k].runs]
    assert shown(0) == [(0, 300_000, 1)] and got[0].collapsed == "a" and got[0].n_kept == 1
    assert shown(1) == [(0, 300_000, 3)] and got[1].collapsed == "a b c"
    assert shown(2) == [] and got[2].n_kept == 200_000
    assert (0, 150_050, 3001) in shown(3) and len(shown(3)) == 51


def contract(doc_id, text):
    """The contract read word for word."""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_contract(spark, tmp_path):
    r = random.Random(3)
    texts = [None, "", " \t\n", "\x85 nbsp\xa0one word \x1f \x0b x", "a b " * 3, "one"] + [" ".join(f"w{x}é" for x in mixed(r, r.choice([1, 8, 30, 90, 200]))) for _ in range(150)]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "a a a a a a a", "clash", 1), (7, texts[7], None, None), (7, texts[7], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_kept long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_periods(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((contract(k, t) for k, t, *_ in rows), key=repr)
    kept = find_runs(docs)
    assert kept.columns == ["doc_id", "text", "runs", "n_kept", "collapsed"] and kept.count() == len(rows)
    assert find_runs(docs.limit(0)).count() == 0
    assert docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0).count() > 5
