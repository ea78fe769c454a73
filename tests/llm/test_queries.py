"""Neighbours against brute force, and the pipeline against its stages in plain form."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import near_copies, neighbours
from runlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, a in good:
        if i % 50 == 0:
            near = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), j) for j, b in good if j != i and len(b) == len(a))
            out[i] = [j for _, j in near[:k]]
    return out


def test_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 5)
    got = {}
    for r in QUERIES["op7_nearest_neighbours"](spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(200, [3.0, 2.0, 1.0]), (201, None), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 1.0]),
                                                         (250, [float("nan"), 1.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, block=16, query_block=1, probes=81).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4]}
    assert neighbours.search(df.limit(0), F.lit(True)).collect() == []


def test_perturbations_rise_in_cost():
    place = np.array([0.2, 3.9, -1.45, 7.5])
    frac = place - np.floor(place)
    steps = neighbours.perturbations(place, 81)
    cost = [sum(f * f if s < 0 else (1 - f) ** 2 if s > 0 else 0 for f, s in zip(frac, row)) for row in steps]
    assert cost == sorted(cost) and len({tuple(s) for s in steps}) == len(steps) == 81


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns and 0 < out.count() <= kept.count()
        kept = out
    sets = [(r.doc_id, near_copies.shingles(r.text)) for r in kept.orderBy("doc_id").collect()]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if near_copies.similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    left = corpus_pipeline.STAGES[2][1](spark, kept, SF)
    ids = sorted(r.doc_id for r in left.collect())
    assert left.columns == docs.columns and ids == sorted({top(i) for i in root})
    packed = corpus_pipeline.run(spark, SF)
    assert sorted({r.doc_id for r in packed.collect()}) == ids


def test_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and "op2_licence_scan" in ORACLES
