"""Hard negatives by distance keys against brute force in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.llm.common import Workspace
from corvex.llm.hard_negatives import FIRST_ROUND, HIGHEST, LOWEST, KeyedVectors, fit_pivots, hard_negatives, wanted_blocks

SCHEMA = "vec_id long, label int, embedding array<double>, at string, block string, v string, asked string"


def brute(rows, is_anchor, k=5, percent=80, scale=256):
    width = max((len(r[2]) for r in rows if r[2]), default=0)
    v = set()
    for i, label, e in (r[:3] for r in rows):
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.add((i, label, tuple(math.floor(scale * x) for x in e) + (0,) * (width - len(e))))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, e in v:
        if not is_anchor(i):
            continue
        scored = [(-dot(e, f), j, other) for j, other, f in v if j != i or other != label]
        for p, j, _ in sorted(s for s in scored if s[2] == label and s[1] != i)[:k]:
            fits = sorted(s for s in scored if s[2] != label and percent * -p <= 100 * -s[0] <= 100 * -p)
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def random_rows(n, dims, labels, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, rng.randrange(labels), [c + spread * rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


@pytest.fixture(scope="module")
def hard_rows():
    rows = random_rows(160, 6, 3, 1)
    same = rows[0][2]
    rows += [(200 + i, i % 2, same) for i in range(40)]  # one vector in many rows: ties
    rows += [(300, None, same), (310, 1, None), (320, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (330, 1, [math.nan] * 6), (340, 1, [math.inf] * 6), (None, 1, same)]
    rows += [(350, 1, []), (360, 2, [0.5]), (370, 0, [0.0] * 6), (380, 7, same), (390, 8, [-x for x in same]), rows[3], rows[10], (10, 2, same), (20, 1, [5.0] * 6)]
    return rows


@pytest.mark.parametrize("block_rows", [None, 7])
def test_against_brute_force(spark, hard_rows, block_rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in hard_rows], SCHEMA).repartition(4)
    got = hard_negatives(frame, F.col("vec_id") % 10 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(hard_rows, lambda i: i % 10 == 0)


def test_large_components_and_other_parameters(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), [rng.uniform(-1, 3) * 1e6, float(rng.randrange(-3, 9))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives(frame, F.col("vec_id") < 9, k_positive=3, k_negative=2, percent=50, block_rows=5)
    want = {r[:2]: r for r in brute(rows, lambda i: i < 9, k=3, percent=50)}
    assert got.count() and {(r.anchor_id, r.positive_id) for r in got.collect()} == set(want)


def test_empty_and_one_label(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none, F.col("vec_id") % 10 == 0).isEmpty()
    alone = spark.createDataFrame([(i, 1, [1.0]) for i in range(20)], "vec_id long, label int, embedding array<double>")
    assert hard_negatives(alone, F.col("vec_id") % 10 == 0).isEmpty()


def test_bounds_hold_and_prune():
    """Blocks left out hold no row with a score in the asked range, and clustered rows leave most blocks out."""
    rng = np.random.default_rng(2)
    rows = np.floor(256 * (rng.normal(0, 3, (12, 8))[rng.integers(0, 12, 6000)] + rng.normal(0, 0.05, (6000, 8))))
    most = float((rows**2).sum(1).max())
    pivots = fit_pivots(rows[:1000], most, 12)
    extra = np.sqrt(most - (rows**2).sum(1))
    d = np.sqrt(((np.hstack([rows, extra[:, None]])[:, None, :] - pivots[None]) ** 2).sum(2))
    near = d.argmin(1)
    order = np.lexsort((d[np.arange(len(rows)), near], near))
    block = np.concatenate([[0], np.cumsum((near[order][1:] != near[order][:-1]) | (np.arange(1, len(rows)) % 50 == 0))])
    key = d[order, near[order]]
    ids = np.unique(block)
    low, high = (np.array([f(key[block == b]) for b in ids]) for f in (np.min, np.max))
    parts = (ids, np.array([near[order][block == b][0] for b in ids]), low, high, pivots, most)
    q = rows[:40]
    scores = (q @ rows[order].T).astype(np.int64)
    least = np.sort(scores, 1)[:, -5]
    asked = wanted_blocks(parts, q, np.full(40, HIGHEST), least, 0, len(ids))
    for i, blocks in enumerate(asked):
        assert set(block[scores[i] >= least[i]]) <= set(blocks)
    assert np.mean([len(b) for b in asked]) < len(ids) / 4
    hi = least - 1
    asked = wanted_blocks(parts, q, hi, (0.8 * hi).astype(np.int64), 0, len(ids))
    for i, blocks in enumerate(asked):
        assert set(block[(scores[i] <= hi[i]) & (scores[i] >= int(0.8 * hi[i]))]) <= set(blocks)
    assert len(wanted_blocks(parts, q, np.full(40, HIGHEST), np.full(40, LOWEST), 0, FIRST_ROUND)[0]) == FIRST_ROUND


def test_rows_are_stored_in_order_of_their_key(spark):
    rows = spark.createDataFrame([(i, label, [int(256 * x) for x in e]) for i, label, e in random_rows(2000, 4, 3, 9)], "vec_id long, label long, v array<long>")
    stored = KeyedVectors(rows, Workspace(spark, "keys"), 100)
    got = [tuple(r) for r in stored.rows.orderBy("at").select("pivot", "key").collect()]
    assert got == sorted(got) and len({p for p, _ in got}) > 1 and stored.rows.groupBy("block").count().agg(F.max("count")).first()[0] <= 100
