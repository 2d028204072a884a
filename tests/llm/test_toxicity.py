"""The classifier learns from every labelled row, by shards."""

import numpy as np

from fathomline.llm import toxicity as tox


def test_every_labelled_row_teaches_and_shards_are_averaged(spark, monkeypatch):
    rng = np.random.default_rng(1)
    marked = [i % 4 == 0 for i in range(14000)]  # more rows of both kinds than the sample that was drawn before
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 12)) + (" vile" if bad else ""), "en") for i, bad in enumerate(marked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(marked)], "doc_id long, toxic int")
    counted, start = [], tox._start
    monkeypatch.setattr(tox, "_start", lambda seen, n, *a: counted.append((seen[1].max(), n)) or start(seen, n, *a))
    monkeypatch.setattr(tox, "EPOCHS", 1)
    model = tox.fit_toxicity(docs, labels, shard=4000)
    (most, n), = counted
    assert most == n[1] > 2500 and n[0] > 5000 and abs(sum(n) - 11200) < 300
    scores = model.score([r[1] for r in rows[:400]])
    assert all((s >= 0.3) == bad for s, bad in zip(scores, marked))
