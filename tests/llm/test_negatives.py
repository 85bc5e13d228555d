"""Hard negatives against SQL on tables and against plain search on small ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetide.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, span int, chunk string"


def brute(rows, every, positives=5, negatives_=10):
    first = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        first[i] = min(first.get(i, (y, v)), (y, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, (y, v) in first.items():
        if i % every:
            continue
        scores = sorted((-dot(v, w), j, z) for j, (z, w) in first.items() if j != i)
        for p, j, _ in [s for s in scores if s[2] == y][:positives]:
            ok = [(s, n) for s, n, z in scores if z != y and 30 * -p <= 100 * -s <= 90 * -p][:negatives_]
            out |= {(i, j, k, n, -p, -s) for k, (s, n) in enumerate(ok, 1)}
    return out


def found(spark, rows, every):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, "x") for i, v, y in rows], SCHEMA)
    got = [tuple(r) for r in negatives.hard_negatives(df, F.expr(f"pmod(vec_id, {every}) = 0"), F.col("label")).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("kind", ["spread", "clusters", "lengths", "ties", "hot label"])
def test_equals_plain_search(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "SPAN_ROWS", 150)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 20)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8))
    if kind == "clusters":
        x = rng.normal(size=(6, 8))[rng.integers(0, 6, 600)] * 3 + x * 0.2
    if kind == "lengths":
        x = x * rng.pareto(1.0, size=(600, 1))
        x[:5] = 0
    if kind == "ties":
        x = np.round(x)
    label = np.where(rng.random(600) < 0.7, 0, rng.integers(0, 10, 600)) if kind == "hot label" else rng.integers(0, 4, 600)
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_pruning_skips_rows_and_loses_none():
    rng = np.random.default_rng(8)
    v = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 4 + rng.normal(size=(3000, 16)) * 0.1))
    b = negatives.Bucket(np.arange(3000), np.zeros(3000), v)
    q, least = v[:50], 0.9 * (v[:50] ** 2).sum(1)
    who, row = b.candidates(q, least)
    must = np.argwhere(q @ v.T >= least[:, None])
    assert {tuple(m) for m in must.tolist()} <= set(zip(who.tolist(), row.tolist(), strict=True))
    assert len(who) < 0.8 * 50 * 3000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0], 1), (1, [1, 0], 1), (1, [1, 0], 1), (2, [0.5, 1], 2), (3, None, 2), (4, [nan, 1], 2), (5, [inf, 1], 2), (6, [None, 1], 2), (7, [0.5], 2), (8, [], 2), (None, [0.5, 0], 2), (9, [0.5, 0], None), (10, [0, 0], 3), (11, [0, 0], 3), (12, [-1, 0], 3), (20, [2, 2], 5), (13, [0.6, 0], 4)]
    assert found(spark, rows, 10) == brute(rows, 10)
    assert found(spark, rows[:1], 10) == set() == found(spark, [], 10)


def test_numbers_beyond_53_bits(spark):
    rows = [(0, [1e7, 3e6], 1), (1, [1e7, 3e6], 1), (2, [5e6, 1e6], 2), (3, [8e6, 8e6], 2), (4, [5e6, 1e6], 2), (10, [3e7, 1], 2)]
    assert found(spark, rows, 10) == brute(rows, 10) != set()


def test_query_matches_its_sql(spark):
    duck = duckdb.connect()
    duck.execute("create view embeddings as select * from '/root/testdata/sf0.1/embeddings.parquet'")
    want = duck.execute(negatives.OP13_SQL).fetchall()
    assert sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, "/root/testdata/sf0.1").collect()) == sorted(want)
