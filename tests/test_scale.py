"""What a query stores and shuffles: only what it needs, and keys rather than rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvex.operators import changes as G
from corvex.operators import keyword_index as K
from corvex.plans import retrieval_queries as Q
from corvex.plugins import HashingEmbedder
from corvex.sources.storage import exists


def chunks_of(spark, n):
    return spark.createDataFrame([(i // 2, i % 2 + 1, " ".join(f"w{j}" for j in range(i % 50)) + " often often" * (i % 3)) for i in range(n)], "doc_id long, page_number long, content string")


def test_blocks_hold_each_posting_once_however_tokens_are_dealt(spark, monkeypatch):
    for name, value in (("RANGE", 500), ("TOKENS", 700), ("HELD", 60), ("BLOCK", 16), ("SAMPLED", 40)):
        monkeypatch.setattr(K, name, value)
    index = K.build_index(chunks_of(spark, 600).repartition(5), complete=False)
    assert not exists(spark, f"{index.path}/blocks") and index.stats.first()["n"] == 600 - 12 + sum(1 for i in range(0, 600, 50) if i % 3)
    want = Counter((r.doc_id, r.page_number, w, n, r.dl) for r in index.corpus.collect() for w, n in Counter(r.t).items())
    columns = ["doc_id", "page_number", "token", "tf", "dl"]
    assert Counter(map(tuple, index.postings.select(columns).collect())) == want
    assert Counter(map(tuple, K.postings_of(index.corpus).select(columns).collect())) == want
    assert index.blocks.filter("n > 16 or n <> size(items)").isEmpty()
    assert {r.token: r.df for r in index.terms.collect()} == Counter(k[2] for k in want)


def test_postings_of_a_corpus_are_not_shuffled(spark):
    index = K.build_index(chunks_of(spark, 100), complete=False)
    assert "Exchange" not in K.postings_of(index.corpus)._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_one_key_are_one(spark):
    d = spark.createDataFrame([(1, 1, "same words"), (1, 1, "same words")], "doc_id long, page_number long, content string")
    assert sorted((r.token, r.tf) for r in K.build_index(d).postings.collect()) == [("same", 2), ("words", 2)]


def test_many_tokens_are_searched_chunk_by_chunk(spark, monkeypatch):
    d = spark.createDataFrame([(i, 1, " ".join(f"w{(i * k) % 37}" for k in range(1, 4 + i % 9)) + " often-said" * (i % 2)) for i in range(300)], "doc_id long, page_number long, content string").repartition(5)
    q = spark.createDataFrame([(f"q{i}", j, f"w{i} w{j + 3} w{i} often unknown") for i in range(30) for j in range(2)] + [("none", 0, "unknown"), (None, 1, "w5 said")], "qid string, qno int, text string")
    want = sorted(map(str, K.keyword_search(K.build_index(d), q, 7).collect()))
    for name, value in (("NAMED_TOKENS", 3), ("CELLS", 2000), ("TOKENS", 60), ("PASSED", 50)):
        monkeypatch.setattr(K, name, value)
    index = K.build_index(d, complete=False)
    assert sorted(map(str, K.keyword_search(index, q, 7).collect())) == want and len(want) == 61 * 7
    assert not exists(spark, f"{index.path}/blocks") and exists(spark, f"{index.path}/weights")
    unknown = q.filter("qid = 'none'").withColumn("text", F.lit("un known to it"))
    assert K.keyword_search(index, unknown).isEmpty()
    twice = d.unionByName(d.limit(1))
    index = K.build_index(twice, complete=False)  # chunks of one key are one in blocks alone
    assert K.keyword_search(index, q, 7).count() == 61 * 7 and exists(spark, f"{index.path}/blocks")


def test_best_chunks_are_kept_block_by_block_with_ties():
    rng = np.random.default_rng(1)
    scores = np.round(rng.random((6, 400)), 1)
    doc, page = rng.permutation(400), np.ones(400, np.int64)
    best = K.Best(6, 5, 0.0)
    for lo in range(0, 400, 90):
        best.add(scores[:, lo : lo + 90], doc[lo : lo + 90], page[lo : lo + 90], 0.0)
    got = pa.Table.from_batches(best.rows("s", no=pa.array(range(6)))).to_pylist()
    for i in range(6):
        mine = sorted((-r["s"], r["doc_id"]) for r in got if r["no"] == i)
        assert mine[:5] == sorted(zip(-scores[i], doc))[:5] and len(mine) <= 10


def test_vectors_of_arrow_lists():
    embed, lists = HashingEmbedder(), [["ab", "c", "ab"], [], ["x"], ["c", "d"]]
    assert (embed.of_lists(pa.array(lists), {}) == embed(lists)).all() and (embed.of_lists(pa.array(lists).slice(1, 2), {}) == embed(lists[1:3])).all()


def test_pools_and_lists_make_only_their_own_index(spark, tiny):
    Q.INDEXES.clear()
    Q.VECTORS.clear()
    Q.u2(spark, tiny).count()
    assert not Q.VECTORS
    Q.INDEXES.clear()
    Q.r4(spark, tiny).count()
    assert not exists(spark, f"{Q.stored_index(spark, tiny).path}/blocks")


def test_closure_joins_a_leaf_below_its_explode_and_stores_keys_alone(spark):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(20)], "id long, text string")
    parts = spark.range(20).select(F.col("id").alias("doc"), F.explode(F.array_repeat(F.col("id"), 3)).alias("part"))
    kept, removed = G.delete_closure({"docs": docs, "parts": parts}, [G.Reference("parts", ("doc",), "docs", ("id",))], {"docs": F.col("id") < 5})
    assert kept["parts"].count() == 45 and removed["parts"].count() == 15
    plan = kept["parts"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftAnti")


def test_more_queries_than_a_batch_and_copies_of_a_query(spark, monkeypatch):
    import numpy as np

    from corvex.operators import vector_index as V

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 4)), 1)
    v[200:] = v[:100]
    rows = spark.createDataFrame([(i, str(i % 3), v[i].tolist()) for i in range(300)], "id long, tenant string, vector array<double>").repartition(7)
    index = V.build_vector_index(rows, "id", "vector", "tenant", cells=9)
    for name, value in (("MAX_QUERIES", 20), ("SCORES", 500), ("PAIRS", 300)):
        monkeypatch.setattr(V, name, value)
    asked = rows.filter("id % 5 = 0")
    got = {}
    for r in V.search_batches(index, asked, 7, probes=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = V.unit(v)
    want = {i: sorted((j for j in range(300) if j != i and j % 3 == i % 3), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:7] for i in range(0, 300, 5)}
    assert got == want


def test_tables_of_rows_are_small(spark):
    from corvex.sources.pdf import tables_of

    assert [len(t) for t in tables_of((("a", b"x" * 1000) for _ in range(25)), ["path", "content"], 10_000)] == [10, 10, 5]
