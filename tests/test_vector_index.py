"""The index of cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.operators import vector_index as V


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (30, 16))
    v = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.15, (3000, 16))
    v[7] = 0
    rows = [(i, f"t{i % 3}", x) for i, x in enumerate(v.tolist())] + [(5000, "t0", None), (5001, "t0", [None] * 16), (None, "t1", v[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, who string, e array<double>").repartition(3), v


def brute(v, asked, k, tenants):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    out = {}
    for i in asked:
        s = np.round(u[i] @ u.T, 6)
        fits = [j for j in range(len(v)) if j != i and (not tenants or j % 3 == i % 3)]
        out[i] = sorted(fits, key=lambda j: (-s[j], j))[:k]
    return out


def queries_of(frame):
    return frame.filter("vec_id % 50 = 0 and vec_id < 3000").select(F.col("vec_id").alias("id"), F.col("who").alias("tenant"), F.col("e").alias("vector"))


@pytest.mark.parametrize("tenants", [True, False])
def test_recall_and_what_is_read(spark, clustered, tenants, tmp_path):
    frame, v = clustered
    index = V.build_vector_index(frame, "vec_id", "e", "who" if tenants else None, cells=30, k=10, path=str(tmp_path / "index"))
    assert index.rows.count() == 3000 and index.probes < 15
    want = brute(v, range(0, 3000, 50), 10, tenants)
    asked = queries_of(frame)
    every = V.search_cells(index, asked, 10, probes=30, own_tenant=tenants)
    assert {(r.query_id, r["rank"]): r.id for r in every.collect()} == {(q, i): j for q, js in want.items() for i, j in enumerate(js, 1)}
    some = V.search_cells(index, asked, 10, own_tenant=tenants).collect()
    assert sum(r.id in want[r.query_id] for r in some) >= 0.9 * sum(map(len, want.values()))
    one = V.search_cells(index, asked.filter("id = 50"), 10, own_tenant=tenants)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    read = index.rows.filter(F.col("cell").isin([r.cell for r in one.select("cell").distinct().collect()]))
    assert read.count() < 1500
    back = V.load_vector_index(spark, str(tmp_path / "index"))
    again = V.search_cells(back, asked, 10, own_tenant=tenants).collect()
    assert back.probes == index.probes and sorted(map(tuple, again)) == sorted(map(tuple, some))


def test_edges(spark, clustered):
    frame, _ = clustered
    none = V.build_vector_index(frame.limit(0), "vec_id", "e")
    assert none.rows.isEmpty() and V.search_cells(none, queries_of(frame).limit(0), 5).isEmpty()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "i long, v array<float>")
    index = V.build_vector_index(same, "i", "v")
    asked = spark.createDataFrame([(3, "", [2.0, 4.0])], "id long, tenant string, vector array<double>")
    assert [r.id for r in V.search_cells(index, asked, 4).orderBy("rank").collect()] == [0, 1, 2, 4]
