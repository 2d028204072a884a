"""The pipeline's stages one by one: edge cases, what each keeps and what it takes away."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

#: The columns of documents, with a null row, an empty text, repeated rows and repeated ids.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i}" for i in range(400)]
#: Names that operators use for columns of their own.
MINE = ("_gone", "_at", "_own", "_th", "score", "n_hit", "n_lines", "component_id", "_t1", "_items")


def prose(seed: int, n: int = 60) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def near(text: str) -> str:
    words = text.split()
    return " ".join([*words[:-1], "changed"])


ROWS = [
    (1, prose(1), "en", "a", 1),
    (2, near(prose(1)), "en", "a", 1),
    (3, prose(3), "de", "b", 1),
    (3, prose(33), "de", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, prose(6), "en", "a", 1),
    (6, prose(6), "en", "a", 1),
    (None, prose(7), "en", "a", 1),
    (8, prose(8, 4000), "en", "a", 1),
    (9, prose(20, 30) + " " + prose(99, 12) + " " + prose(21, 30), "en", "a", 1),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with labels and a benchmark."""
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", prose(99, 12))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def frames(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    clash = plain
    for name in MINE:
        clash = clash.withColumn(name, F.lit("mine"))
    return plain, clash, plain.where("false")


def names_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1) for r in df.collect())


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_duplicates", "decontamination"])
def test_stage_keeps_columns_and_survives_edges(spark, tables, name):
    stage = dict(pipeline.STAGES)[name]
    plain, clash, empty = frames(spark)
    assert stage(spark, empty, tables).count() == 0
    kept = {}
    for docs in (plain, clash):
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        kept[len(docs.columns)] = names_of(out)
        if docs is clash:
            assert all(r[c] == "mine" for r in out.collect() for c in MINE)
    assert kept[5] == kept[15]
    every = sorted(x[0] if x[0] is not None else -1 for x in ROWS)
    want = {
        "toxicity": every,  # without labels there is no evidence against anything
        "line_dedup": every,  # lines go, documents stay
        "near_duplicates": sorted(set(every) - {2} | {3}) + [3],  # one of 1 and 2, one of the two equal rows, both texts under id 3
        "decontamination": [x for x in every if x != 9],
    }[name]
    assert kept[5] == sorted(want)


def test_lines_follow_the_text(spark, tables):
    line = prose(50, 12)
    docs = spark.createDataFrame([(1, line + "\nown one", "en", "a", 1), (2, line + "\nown two", "en", "a", 1), (3, None, "en", "a", None)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_dedup(spark, docs, tables).collect()}
    assert got == {1: (line + "\nown one", len(line) + 8), 2: ("own two", 7), 3: (None, None)}


def test_toxic_rows_go_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        words = rng.choices(WORDS, k=40)
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(40)] = "vilething"
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in pipeline.toxicity(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert len([i for i in left if i % 5 == 0]) <= 8 and len([i for i in left if i % 5]) >= 630


def test_packing_stage_takes_every_row(spark, tables):
    plain, clash, empty = frames(spark)
    assert pipeline.packing(spark, empty, tables).count() == 0
    got = pipeline.packing(spark, clash, tables).collect()
    assert sorted(r.doc_id or -1 for r in got if r.piece == 0) == sorted(x[0] or -1 for x in ROWS)
    used = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
