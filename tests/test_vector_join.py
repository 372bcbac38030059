"""The threshold join of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import clustering as L
from storyloom.operators import vector_join as V

SCHEMA = "vec_id long, embedding array<float>, id long, cell int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("threshold", [0.35, 0.9])
def test_against_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(V, "PIVOTS", 5)
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    points = [(centres[i % 6] + rng.normal(scale=0.25, size=12)) * rng.uniform(0.1, 9) for i in range(150)]
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a large group of copies
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] + [1.0] * 11), (None, rows[3][1])]
    df = frame(spark, rows).repartition(3)
    classes = V.vector_classes(df)
    members = {r.id: r.class_id for r in classes.collect()}
    assert members == {i: 7 if i >= 1000 else i for i, _ in rows if i is not None and i < 2000}
    blocks = V.similar_blocks(classes, threshold).collect()
    got = {(h.a, h.b): h.similarity for r in blocks for h in r.hits}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:150]}
    want = {(i, j): round(float(unit[i] @ unit[j]), 12) for i in unit for j in unit if i < j and round(float(unit[i] @ unit[j]), 12) >= threshold}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want) and len(want) > 100
    assert sum(len(r.hits) for r in blocks) == len(want)
    if threshold == 0.9:
        assert len(blocks) < 40 and sum(r.formed for r in blocks) < 150 * 149 // 4


def test_empty(spark):
    assert V.similar_vectors(frame(spark, []), 0.5).count() == 0
    assert V.similar_vectors(frame(spark, [(1, [1.0, 0.0])]), 0.5).count() == 0


def test_matching_prefers_vectors_and_asks_the_source(spark):
    story = "storm flood river bridge rescue train"
    rows = [(1, story, story, "world", None, [1.0, 0.0]), (2, story, story, "world", None, [0.0, 1.0]), (3, story, "other words", None, "world", [0.1, 1.0]),
            (4, story, story, "world", None, None), (5, story, story, None, "sport", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, title string, raw_text string, category string, source_category string, embedding array<float>")
    df = df.withColumn("state", F.lit(None).cast("string")).withColumn("district", F.lit(None).cast("string")).withColumn(
        "published_at", F.timestamp_seconds(F.lit(1706745600))).withColumn("ingested_at", F.timestamp_seconds(F.col("id") + 1706745600))
    got = {r.id: r.parent_id for r in L.first_match_cluster(df, "2024-02-01 00:00:00").collect()}
    # 2 points elsewhere than 1; 3 takes its source's category and meets 2; 4 has no vector and is compared by words; 5 is of another category
    assert got == {1: None, 2: None, 3: 2, 4: 1, 5: None}


@pytest.mark.parametrize("shelf", [1, 4])
def test_shelves_send_a_block_once(spark, monkeypatch, shelf):
    """All blocks meet; each is sent once to every shelf, and matches are those of all pairs, near the threshold too."""
    monkeypatch.setattr(V, "BLOCK", 8)
    monkeypatch.setattr(V, "SHELF", shelf)
    monkeypatch.setattr(V, "HELD", 50)
    monkeypatch.setattr(V.np, "ceil", lambda x: 1)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(100)]
    rows += [(100 + i, [1.0 if k == i else 0.0 for k in range(6)]) for i in range(6)] + [(110, [1.0, 1.0, 1.0, 1.0, 0.0, 0.0])]
    sent = []
    sides = V._sides
    monkeypatch.setattr(V, "_sides", lambda blocks, pairs, span: sent.append(sides(blocks, pairs, span)) or sent[-1])
    got = {(h.a, h.b): h.similarity for r in V.similar_blocks(V.vector_classes(frame(spark, rows)), 0.5).collect() for h in r.hits}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {(i, j): round(float(unit[i] @ unit[j]), 12) for i in unit for j in unit if i < j and round(float(unit[i] @ unit[j]), 12) >= 0.5}
    assert set(got) == set(want) and (100, 110) in got and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    blocks = -(-len(rows) // 8)
    shelves = -(-blocks // shelf)
    assert sent[0].count() <= blocks * (shelves + 1)
