"""Change logs, deletion along references and policies."""

import random

import pytest
from pyspark.sql import functions as F

from corvex.operators import changes as G
from corvex.operators import relational as L


def test_changes_in_any_order_and_repeated(spark):
    rng = random.Random(1)
    log = [(k, t, rng.choice([None, "a", "b", "done"]), rng.choice([None, 1.0, 2.0])) for k in range(4) for t in range(12)] + [(9, 1, "x", 1.0)]
    want = {}
    for k, t, s, p in sorted(log, key=lambda r: r[1]):
        now = want.setdefault(k, [None, None])
        want[k] = [now[0] if s is None else s, now[1] if p is None else p]
    for seed in range(2):
        given = log + log[:20]
        random.Random(seed).shuffle(given)
        d = spark.createDataFrame(given, "k int, t int, status string, progress double")
        assert {r.k: [r.status, r.progress] for r in G.fold_changes(d, ["k"], ["t"], ["status", "progress"]).collect()} == want
        old = spark.createDataFrame([(0, "old", 0.0, "same"), (5, "old", None, "same")], "k int, status string, progress double, other string")
        got = {r.k: tuple(r)[1:] for r in G.apply_changes(old, d, ["k"], ["t"]).collect()}
        assert got == {0: (want[0][0] or "old", want[0][1] or 0.0, "same"), 5: ("old", None, "same")}


def test_merge_of_two_values_of_a_key_is_one_row(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, x string, y int")
    new = spark.createDataFrame([(1, None, 5), (1, "b", 1)], "k int, x string, y int")
    assert [tuple(r) for r in L.merge_latest(old, new, ["k"]).collect()] == [(1, "b", 5)]


def test_closure_over_cycles_shared_children_and_null_references(spark):
    doc = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 5), (None, 1)], "id int, parent int")
    part = spark.createDataFrame([(10, 3, 4), (11, 4, 4), (12, None, 4), (13, 4, 1), (13, 4, 1)], "part int, doc int, other int")
    link = spark.createDataFrame([(13, 4), (11, 9)], "part int, doc int")
    refs = [G.Reference("doc", ("parent",), "doc", ("id",)), G.Reference("part", ("doc",), "doc", ("id",)), G.Reference("part", ("other",), "doc", ("id",)), G.Reference("link", ("part",), "part", ("part",)), G.Reference("doc", ("id",), "link", ("doc",))]
    kept, removed = G.delete_closure({"doc": doc, "part": part, "link": link}, refs, {"doc": F.col("id") == 1})
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    # 13 refers to 1, the link refers to 13, 4 to the link, and 11 and 12 to 4.
    assert rows(kept["doc"]) == [(5, 5)] and rows(kept["part"]) == [] and rows(kept["link"]) == []
    assert rows(removed["doc"]) == rows(doc.filter("id is null or id <> 5")) and len(rows(removed["part"])) == 5
    kept, removed = G.delete_closure({"doc": doc, "part": part, "link": link}, refs[:3], {"doc": F.col("id") == 2})
    assert rows(removed["doc"]) == [(2, 1), (3, 2)] and rows(removed["part"]) == [(10, 3, 4)] and removed["link"].isEmpty()
    assert {(r.child, r.parent): r.orphans for r in G.orphans(kept, refs[:4]).collect()} == {("doc", "doc"): 0, ("part", "doc"): 0, ("link", "part"): 0}
    assert [r.orphans for r in G.orphans({"doc": doc.filter("id = 4"), "part": part}, refs[1:3]).orderBy("orphans").collect()] == [1, 2]


def test_policies(spark):
    rows = spark.createDataFrame([("ann", 1, "ok"), ("bob", 2, "ok"), (None, 3, "ok"), ("ann", 4, None)], "user_id string, n int, text string")
    p = G.Policies(G.owned("t", text=F.col("text").isNotNull()), G.Policy("shared", lambda tenant: F.lit(True), lambda tenant: F.col("user_id") == tenant))
    numbers = lambda d: sorted(r.n for r in d.collect())
    assert numbers(p.readable("t", rows, "ann")) == [1, 4] and numbers(p.readable("unknown", rows, "ann")) == []
    fine, refused = p.split("t", rows, "ann")
    assert numbers(fine) == [1] and {r.n: r.refused for r in refused.collect()} == {2: "policy", 3: "policy", 4: "text"} and fine.columns == rows.columns
    assert numbers(p.readable("shared", rows, "bob")) == [1, 2, 3, 4] and numbers(p.split("shared", rows, "bob")[0]) == [2]
    p.views({"t": rows, "shared": rows}, "bob", "bob_")
    assert [tuple(r) for r in spark.sql("SELECT a.n, count(*) FROM bob_t a, bob_shared b GROUP BY a.n").collect()] == [(2, 4)]
    for tenant in (None, ""):
        with pytest.raises(ValueError):
            p.readable("t", rows, tenant)
