"""Source divergence against a dense count over all terms, and its sketch against exact document frequencies."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import source_audit as audit

SCHEMA = "lang string, source string, text string, term string, n long, value string"


def words_of(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold)


def brute(rows, least, ranks):
    docs, occ, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text, *_ in rows:
        lang, source, w = lang or "", source or "", words_of(text)
        groups.add((lang, source))
        docs[lang].update(set(w))
        occ[lang, source].update(w)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[x] for x in kept) + 2 * v) for t in kept}  # noqa: E731, B023
        p = {s: share(occ[lang, s]) for s in sources}
        q = share(sum((occ[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if occ[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < ranks]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["Haus", "über", "THE", "the", "a1b", "naïve", "日本", "É", "é", "x" * 300, *(f"w{chr(97 + k)}" for k in range(26))]
    rows = []
    for _ in range(300):
        lang, source = r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "S3", None])
        text = "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n", "3", "_"]) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((lang, source, text if r.random() < 0.95 else None, "t", 1, "v"))
    return rows + [("fr", "only", "rare words here", "t", 1, "v"), ("it", "s1", None, None, None, None), ("it", "s2", "", None, None, None)] + rows[:20] * 2


@pytest.mark.parametrize("least", [1, 10, 60])
def test_equals_dense_counts(spark, least):
    rows = corpus(least)
    got = audit.divergences(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, ranks=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, 3)


def test_no_documents_and_no_terms(spark):
    assert audit.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
    got = audit.divergences(spark.createDataFrame([("en", "b", None, None, None, None), ("en", "a", "12 %", None, None, None)], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    with pytest.raises(ValueError):
        audit.divergences(spark.createDataFrame([], SCHEMA), least=256)


def test_sketch_never_underestimates(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    sketch = audit.document_sketch(df.selectExpr("cast(coalesce(lang, '') as binary) lang", "cast(text as binary) text"))
    docs = defaultdict(Counter)
    for lang, _, text, *_ in rows:
        docs[lang or ""].update(set(words_of(text)))
    for lang, counts in docs.items():
        for term, n in counts.items():
            assert sketch[audit.cells(lang.encode(), [term.encode()])].min() >= min(n, audit.FULL)


def test_counts_stop_and_tasks_hand_on(monkeypatch):
    monkeypatch.setattr(audit, "HELD", 10)
    monkeypatch.setattr(audit, "PIECE", 50)
    text = ("alpha Beta gamma " * 40 + "ü" * 200 + " omega").encode()
    assert [w for part in audit.terms(text) for w in part] == [w.encode() for w in words_of(text.decode())]
    batch = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=list("abc"[: len(columns)]))
    many = [" ".join(f"q{chr(97 + k % 26)}{chr(97 + j)}" for j in range(12)).encode() for k in range(600)]
    blocks = list(audit._sketches(iter([batch([b"en"] * 600, many)])))
    assert max(max(b.column(1)[0].as_py()) for b in blocks) <= audit.FULL
    full = np.full(audit.DEPTH * audit.WIDTH, audit.FULL, np.uint8)
    held = type("B", (), {"value": full})
    got = Counter()
    for b in audit._counts(iter([batch([b"en"] * 600, [b"s"] * 600, many)]), held, 10):
        for term, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            got[term] += n
    assert got == Counter(w for t in many for w in words_of(t.decode()))
    none = type("B", (), {"value": full * 0})
    assert not [r for b in audit._counts(iter([batch([b"en"] * 600, [b"s"] * 600, many)]), none, 10) for r in b.to_pylist()]
