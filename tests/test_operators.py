"""Hand-made cases and plain-Python models of the operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvex import plugins
from corvex.functions import text as X
from corvex.functions import urls as U
from corvex.operators import chunking as C
from corvex.operators import evaluation as E
from corvex.operators import html as H
from corvex.operators import relational as L
from corvex.operators import retrieval as R
from corvex.plans import answering as A
from corvex.sources import storage as S


def values(spark, texts, f):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in d.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


# ---- text and URLs -------------------------------------------------------------------------------


def test_tokens(spark):
    got = values(spark, ["", None, "camelCase HTTPServer", "a-b-c well-known -x- --", "Élan vital_1 42 7", "state-of-the-art", "I am"], X.tokens)
    assert got == [[], [], ["camel", "case", "httpserver"], ["a-b-c", "well", "known", "well-known"], ["élan", "vital_1", "42"], ["state", "art", "state-of-the-art"], ["am"]]


def test_small_functions(spark):
    assert values(spark, ["  Hello, World! ", "42 things", "", "---"], X.identifier) == ["hello-world", "item-42-things", "default", "default"]
    assert values(spark, [' "why" ', "how?", '""'], X.question) == ["why?", "how?", "?"]
    assert values(spark, ["x" * 100, "x" * 101], X.preview) == ["x" * 100, "x" * 100 + "..."]
    assert values(spark, ["a {b} {c}", "{a {b} }", "none"], X.flat_json) == ["{b}", "{b}", ""]
    assert values(spark, ["x [1] [2] y"], X.first_array) == ["[1]"] and values(spark, ["x [1] [2] y"], X.widest_array) == ["[1] [2]"]
    assert values(spark, ["../a b/c?.pdf", "é.txt"], X.secure_filename) == ["a_b_c.pdf", "txt"]
    assert values(spark, ["a b c", " \t "], X.word_count) == [3, 0]
    assert values(spark, ["It is NOT IN THE DOCUMENTATION.", "fine", None], lambda c: X.says_any(c, X.ANSWER_DECLINES)) == [True, False, False]


def test_urls(spark):
    assert values(spark, ["http://h/a//#x", "http://h/a?b=1#c", "http://h/"], U.normalised) == ["http://h/a", "http://h/a?b=1", "http://h"]
    assert values(spark, ["https://H:80/a?b", "ftp://x"], U.base) == ["https://H:80", "ftp://x"]
    assert values(spark, ["http://x/a", "ftp://x/a", "http:///a", None], U.valid) == [True, False, False, False]
    assert values(spark, ["http://Ex.org/A_b/", "x"], U.url_slug) == ["ex-org-a-b", "web-page"]
    start = F.lit("http://h/doc/")
    got = values(spark, ["http://h/doc", "http://h/docs", "http://h/other", "http://h/doc/x.PDF", "http://hh/doc", "http://h.evil/doc"], lambda c: U.admissible(c, start))
    assert got == [True, True, False, False, True, True]  # raw prefixes: look-alike hosts pass, as the rule says
    page = F.lit("http://h/a/b.html?q#f")
    assert values(spark, ["/x", "x", "./x", "../x", "?p=2", "#t", "//o/x", "https://o/x"], lambda c: U.resolved(page, c)) == ["http://h/x", "http://h/a/x", "http://h/a/x", "http://h/x", "http://h/a/b.html?p=2", "http://h/a/b.html?q#t", "http://o/x", "https://o/x"]


# ---- chunking ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 462, 463, 512, 513, 924])
def test_fixed_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = values(spark, ["  " + "  ".join(words)], C.fixed_windows)[0]
    assert got == [" ".join(words[s : s + 512]) for s in range(0, n, 462)]


def sentences_model(text, most):
    out, now, size = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        n = len(s.split())
        if n > most:
            if now:
                out.append(" ".join(now))
            now, size = [], 0
            w = s.split()
            out += [" ".join(w[i : i + most]) for i in range(0, n, most)]
        elif now and size + n > most:
            out.append(" ".join(now))
            now, size = [s], n
        else:
            now.append(s)
            size += n
    return [c for c in [*out, " ".join(now)] if c.strip()]


def windows_model(paras, most, shared):
    out, now = [], []
    count = lambda ps: sum(len(p.split()) for p in ps)
    for p in paras:
        if count([p]) > most:
            out += ["\n\n".join(now)] if now else []
            out += sentences_model(p, most)
            now = []
            continue
        if now and count(now) + count([p]) > most:
            out.append("\n\n".join(now))
            k = 0
            while k < len(now) and count(now[len(now) - k - 1 :]) <= shared:
                k += 1
            now = now[len(now) - k :]
        now.append(p)
    return out + (["\n\n".join(now)] if now else [])


def merged_model(paras, least):
    out = []
    for p in paras:
        if out and len(out[-1].split()) < least:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_page_chunks_equal_the_model(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["p " * 40 + "\n" + "g. " * 900 + "\n" + "q " * 30, "s " * 10 + "\n" + "t " * 10 + "\n" + "u " * 300, "\n".join(["v " * 50] * 12), "\n".join(["x " * 51] * 12), "y" + " y" * 700, ""]
    got = values(spark, texts, lambda c: C.page_windows(c, r"\n+"))
    for t, chunks in zip(texts, got):
        body = t.strip()
        if not body:
            assert chunks == []
        elif len(body.split()) <= 250:
            assert chunks == [body]
        else:
            paras = [p.strip() for p in re.split(r"\n+", body) if p.strip()]
            assert chunks == windows_model(merged_model(paras, 20), 300, 50)


def test_link_pages_are_dropped(spark):
    links = "\n".join(f"* [a{i}](b)" for i in range(7))
    assert values(spark, [links + "\nx\ny\nz", links + "\nx\ny\nz\nw\nv\nu", "- [a](b)\n- [a](b)"], lambda c: F.size(C.page_windows(c))) == [0, 1, 1]


# ---- HTML ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("inner", ['<div class="x sl-markdown-content">{}</div>', '<div class="content-panel">{}</div>', '<div class="markdown-body">{}</div>', '<div class="prose">{}</div>', '<div id="content">{}</div>', "<main>{}</main>", '<div role="main">{}</div>', "<article>no</article><article>{}</article>"])
def test_content_is_found(inner):
    html = "<html><body><nav>menu</nav><p>outside</p>" + inner.format("<h2>Title</h2><p>One <b>two</b><p>three <a href='/x'>link</a> on<script>var a = '</p>';</script>") + "<footer>end</footer></body></html>"
    assert H.clean_markdown_of(html) == "## Title\n\nOne **two**\n\nthree [link](/x) on"


def test_html_details():
    assert H.clean_markdown_of("<body><ul><li>a<li>b</ul><p><a href='/n'>only a link</a></p><pre>x  y</pre><div class='toc'>t</div></body>") == "- a\n- b\n\n```\nx  y\n```"
    assert H.clean_markdown_of("") == "" and H.title_of("<title> T </title>") == "T"


def test_deep_nesting_is_no_recursion():
    deep = "<div>" * 20_000 + "<ul><li>x" * 50 + "</li></ul>" * 50 + "</div>" * 20_000
    assert H.clean_markdown_of(deep).startswith("- ")
    table = "<table><tr><th>a</th><td><ul><li>x<ul><li>y</li></ul></li></ul></td></tr></table>"
    assert H.clean_markdown_of(table) == "| a | - x\n\n- y |"


def test_fallback_cleaner(spark):
    md = "# A\n[only](x)\n## On this page\n- a\n## B\ntext\n\n\n\nend"
    assert values(spark, [md], H.clean_fallback) == ["# A\n## B\ntext\n\nend"]


# ---- retrieval -----------------------------------------------------------------------------------

CHUNKS = [(1, 1, "red fox jumps"), (2, 1, "red hen"), (3, 1, "blue whale red"), (4, 1, "  ")]


def test_bm25_by_hand(spark):
    import math

    d = spark.createDataFrame(CHUNKS, "doc_id long, page_number long, content string")
    q = spark.createDataFrame([(1, 0, "red fox fox"), (2, 0, "the of"), (3, 0, "absent")], "qid long, qno int, text string")
    got = {(r.qid, r.doc_id): r.bm25_score for r in R.keyword_search(R.build_index(d), q).collect()}
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in {"red": 3, "fox": 1, "jumps": 1, "hen": 1, "blue": 1, "whale": 1}.items()}
    mean = sum(idf.values()) / len(idf)
    part = lambda x, dl: x * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / (8 / 3)))
    assert set(got) == {(1, 1), (1, 2), (1, 3)}
    assert got[(1, 1)] == round(part(0.25 * mean, 3) + 2 * part(idf["fox"], 3), 6)
    assert got[(1, 2)] == round(part(0.25 * mean, 2), 6)


def test_questions_beyond_a_batch(spark, monkeypatch):
    d = spark.createDataFrame([(i, 1, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)], "doc_id long, page_number long, content string")
    q = spark.createDataFrame([(i, j, f"w{i} w{j + 3} w{i}") for i in range(9) for j in range(2)], "qid long, qno int, text string")
    index = R.build_index(d)
    vectors = R.store_vectors(index.corpus)
    searches = (lambda: R.keyword_search(index, q), lambda: R.dense_search(vectors, q))
    whole = [sorted(map(tuple, f().collect())) for f in searches]
    from corvex.operators import keyword_index as K

    monkeypatch.setattr(K, "MAX_QUESTIONS", 4)
    monkeypatch.setattr(K, "MAX_TOKENS", 1)
    monkeypatch.setattr(K, "NAMED_TOKENS", 3)
    assert whole == [sorted(map(tuple, f().collect())) for f in searches] and all(whole)


def test_stored_index_is_built_once_and_again_when_it_is_gone(spark, tiny):
    from corvex.plans import retrieval_queries as Q

    first, vectors = Q.stored_index(spark, tiny), Q.stored_vectors(spark, tiny)
    assert Q.stored_index(spark, tiny) is first and Q.stored_vectors(spark, tiny) is vectors
    S.remove(spark, first.corpus.inputFiles()[0].rpartition("/")[0])
    assert Q.stored_index(spark, tiny) is not first
    assert Q.stored_index(spark, tiny).corpus.count() == vectors.count()


def scanned(df):
    """Rows that each scan of df's blocks gave, and rows that came out of the filter that follows."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and "items" in node.toString():
            out.append((node.metrics().apply("numOutputRows").value(), node.toString()))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_search_reads_the_asked_tokens_alone(spark, monkeypatch):
    from corvex.operators import keyword_index as K

    monkeypatch.setattr(K, "PAGE", 1)
    d = spark.createDataFrame([(i, 1, f"common{i % 3} w{i} x{i} y{i % 900}") for i in range(2700)], "doc_id long, page_number long, content string").repartition(3)
    index = R.build_index(d)
    q = spark.createDataFrame([(1, 0, "w37 y37"), (2, 0, "x5 unknown")], "qid long, qno int, text string")
    found = scanned(R.keyword_search(index, q))
    asked = index.blocks.filter(F.col("token").isin("w37", "y37", "x5")).count()
    assert found and all("EqualTo(token" in plan or "In(token" in plan for _, plan in found)
    assert all(n <= 4 * asked for n, _ in found) and index.blocks.count() > 2000


def test_blocks_that_cannot_matter_are_left_out(spark, monkeypatch):
    """One rare word decides; the common word's blocks of long chunks are below the k-th score."""
    from corvex.operators import keyword_index as K

    monkeypatch.setattr(K, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, 1, " ".join(["common", *(["rare"] * (3 if i % 40 == 0 else 0)), *(f"f{rng.randrange(50)}" for _ in range(3 if i < 200 else 60))])) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, page_number long, content string")
    index = R.build_index(d)
    q = spark.createDataFrame([(1, 0, "common rare"), (2, 0, "f3 f4 common"), (3, 1, "rare rare"), (4, 0, "")], "qid long, qno int, text string")
    got = [tuple(r) for r in R.keyword_search(index, q, k=5).select("qid", "qno", *R.KEY, "bm25_score", "rank").collect()]
    # Plainly: all postings, added up.
    n, avgdl = index.stats.first()[:2]
    terms = {r.token: r.idf for r in index.terms.collect()}
    dl = {r[0]: len(r[2].split()) for r in rows}
    want = []
    for qid, qno, text in q.collect():
        score = {}
        for t in text.split():
            for i, _, content in rows:
                if tf := content.split().count(t):
                    score[i] = score.get(i, 0) + terms[t] * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl[i] / avgdl))
        best = sorted((-round(s, 6), i) for i, s in score.items() if round(s, 6) > 0)[:5]
        want += [(qid, qno, i, 1, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    assert n == 2000 and sorted(r[:4] + r[5:] for r in got) == sorted(r[:4] + r[5:] for r in want)
    assert all(abs(a[4] - b[4]) < 1e-5 for a, b in zip(sorted(got), sorted(want)))


def test_scorer_and_its_failure(spark):
    rows = [(q, i, f"text {i}", 0.9 - i / 100, i, f"question {q}") for q in (1, 2) for i in range(1, 51)]
    kept = spark.createDataFrame(rows, "qid long, doc_id long, content string, sim double, fused_rank int, question string")

    def scorer(questions, texts):
        if questions[0] == "question 2":
            raise RuntimeError("down")
        return [int(t.split()[1]) / 100 for t in texts]

    got = {(r.qid, r.final_rank): (r.doc_id, r.sim, r.rerank_score) for r in R.rerank(kept, scorer=scorer).collect()}
    assert [got[(1, k)] for k in range(1, 7)] == [(41 - k, (41 - k) / 100, (41 - k) / 100) for k in range(1, 7)]
    assert [got[(2, k)][0] for k in range(1, 7)] == [1, 2, 3, 4, 5, 6] and got[(2, 1)][2] is None and len(got) == 12


def test_batch_runner_gives_each_failure_its_own_row(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, "bad", "c", "  ", "d"])], "qid long, text string")

    def ask(part, index, vectors, least):
        if part.filter("text = 'bad'").count():
            raise RuntimeError("no answer to this one")
        return part.select("qid", F.upper("text").alias("answer"), F.lit(2).alias("n_chunks"))

    got = {r.qid: (r.answer, r.n_sources, r.error) for r in A.run_batch(q, None, None, ask=ask).collect()}
    assert got == {0: ("A", 2, None), 1: ("B", 2, None), 2: ("", 0, "no question"), 3: ("", 0, "no answer to this one"), 4: ("C", 2, None), 5: ("", 0, "no question"), 6: ("D", 2, None)}


def fused_of(spark, dense, sparse):
    d = spark.createDataFrame(dense, "qid long, doc_id long, page_number long, content string, url string, sim double, pool_rank int")
    s = spark.createDataFrame(sparse, "qid long, doc_id long, page_number long, content string, list_rank int")
    return {r.doc_id: (r.rrf, r.sim, r.fused_rank) for r in R.fuse(d, s).collect()}


def test_rank_fusion(spark):
    same = "p" * 200
    got = fused_of(spark, [(1, 1, 1, "a", "u", 0.9, 1), (1, 2, 1, same + "x", "u", 0.8, 2)], [(1, 3, 1, same + "y", 1), (1, 4, 1, "c", 2), (1, 4, 1, "c", 3)])
    assert got[2] == (round(1 / 62 + 1 / 61, 9), 0.8, 1) and 3 not in got
    assert got[4] == (round(1 / 62 + 1 / 63, 9), 0.0, 2)
    assert fused_of(spark, [], [(1, 3, 1, "z", 1)])[3] == (round(1 / 61, 9), 0.0, 1)


def test_threshold_and_rerank(spark):
    rows = [(1, i, sim, rrf, i) for i, (sim, rrf) in enumerate([(0.70, 0.1), (0.0, 0.1), (0.0, 0.0), (0.69, 0.1), (None, 0.1), (0.9, 0.1)])]
    d = spark.createDataFrame(rows, "qid long, doc_id long, sim double, rrf double, fused_rank int")
    kept = R.above_threshold(d)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 5}
    assert [r.doc_id for r in R.rerank(kept).orderBy("final_rank").collect()] == [5, 0, 1]
    assert [r.doc_id for r in R.rerank(kept, cap=2, n=1).collect()] == [0]
    less = R.above_threshold(d, 0.6)
    assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in less.collect()}


def test_merge_adjacent(spark):
    w = lambda n: " ".join(["w"] * n)
    rows = [
        (1, "u", 5, w(10), 0.5, 0.1, 1), (1, "u", 6, w(10), 0.9, 0.2, 2), (1, "u", 8, w(5), 0.4, 0.3, 3), (1, "v", 1, w(599), 0.3, 0.1, 4), (1, "v", 2, w(1), 0.3, 0.1, 5), (1, "v", 3, w(1), 0.3, 0.1, 6), (1, "", 4, "x", 0.0, 0.1, 7),
        (2, "d", 1, "a", 0.1, 0.1, 1), (2, "d", 1, "b", 0.1, 0.1, 2),
    ]
    d = spark.createDataFrame(rows, "qid long, url string, page_number long, content string, sim double, rrf double, final_rank int")
    got = {q: [(r.url, r.page_number, X_words(r.content), r.sim) for r in R.merge_adjacent(d).filter(F.col("qid") == q).orderBy("place").collect()] for q in (1, 2)}
    assert got[1] == [("", 4, 1, 0.0), ("u", 6, 20, 0.9), ("u", 8, 5, 0.4), ("v", 2, 600, 0.3), ("v", 3, 1, 0.3)]
    assert len(got[2]) == 2


def X_words(t):
    return len(t.split())


def test_no_hits_abstain(spark):
    q = spark.createDataFrame([(1, "zzz qqq"), (2, "red fox")], "qid long, text string")
    d = spark.createDataFrame(CHUNKS, "doc_id long, page_number long, content string")
    out = {r.qid: r for r in A.ask(q, *R.build_both(d)).collect()}
    assert out[1].abstained and out[1].n_chunks == 0 and out[1].answer == A.NOTHING
    assert not out[2].abstained and out[2].context.startswith("[1] ")


def test_tenants(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "x")], "user_id string, pdf_name string")
    assert [r.user_id for r in L.tenant_rows(d, "a").collect()] == ["a"]
    for none in (None, ""):
        with pytest.raises(ValueError):
            L.tenant_rows(d, none)


def test_plugins(spark):
    assert values(spark, ["What is it", "Compare a and b", "It fails. Why?", "Do a. Then b.", "A versus B"], plugins.classify) == ["simple", "comparison", "troubleshoot", "multi_part", "comparison"]
    assert values(spark, ["Label: MULTI_PART", "??"], plugins.label_in) == ["multi_part", "simple"]
    assert values(spark, ['ok ["a", "b"] bye', "nothing"], plugins.sub_questions_in) == [["a", "b"], None]


# ---- relational, storage, evaluation -------------------------------------------------------------


def test_ordinal_is_gapless(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [(r.k, r.i) for r in L.ordinal(d, ["k"], "i").orderBy("k").collect()] == [(k, k) for k in range(1000)]


def test_ordinal_of_many_partitions(spark):
    """More rows than the ranges are drawn from: counts and numbers must come from the same ranges."""
    d = spark.range(60_000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 60_000).cast("string")).alias("k"))
    got = [(r.k, r.i) for r in L.ordinal(d, ["k"], "i").orderBy("k").collect()]
    assert [i for _, i in got] == list(range(60_000))


def test_csv_by_position_of_many_files(spark):
    d = L.ordinal(spark.range(500).select("id", F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(' "quoted",\nnext')).alias("text")), ["id"], "i")
    path = S.shared_folder(spark, "csv")
    d.repartitionByRange(7, "i").sortWithinPartitions("i").select("text").write.csv(path, header=True, escape='"')
    back = S.csv_by_position(spark, path, "text", "i")
    assert {(r.i, r.text) for r in back.collect()} == {(r.i, r.text) for r in d.select("i", "text").collect()}


def test_merge_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, s string, n int")
    assert sorted(map(tuple, L.merge_latest(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5)]
    assert sorted(map(tuple, L.upsert(old, new, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]


def test_index_store(spark, tmp_path):
    rows = spark.createDataFrame([("u", "s", 1), ("u", "t", 2), ("v", "s", 3)], "user_id string, site_slug string, x int")
    store = S.IndexStore(spark, str(tmp_path / "i"))
    store.save(rows)
    store.save(rows.filter("x = 1").withColumn("x", F.lit(9)))
    assert sorted(r.x for r in store.load("u").collect()) == [2, 9] and [r.x for r in store.load("v", "s").collect()] == [3]
    assert store.delete("u", "s") and not store.delete("u", "s")
    assert [r.x for r in store.load("u").collect()] == [2]
    with pytest.raises(ValueError):
        store.load("")


@pytest.mark.parametrize("n", [1, 2, 4, 20])
def test_latency_elements(spark, n):
    xs = [float((i * 37) % 101 + 1) for i in range(n)]
    d = spark.createDataFrame([("s", x, None) for x in xs] + [("s", 0.0, None), ("s", 900.0, "e"), ("t", 0.0, None)], "system string, latency double, error string")
    rows = E.latencies(d).collect()
    assert len(rows) == 1
    xs.sort()
    assert (rows[0].latency_p50, rows[0].latency_p95) == (xs[n // 2], xs[int(n * 0.95)])


def test_prefix_matches_are_listed_again(spark):
    long = "q" * 70
    rag = spark.createDataFrame([(0, long + "a", "simple", "r")], "pos int, question string, question_type string, answer string")
    fin = spark.createDataFrame([(0, long + "b", None, "f")], "pos int, question string, question_type string, answer string")
    assert sorted((r.rag or "", r.fin) for r in E.merge_answers(rag, fin).collect()) == [("", "f"), ("r", "f")]


def test_quotas():
    assert sum(E.quotas(80).values()) == 80 and E.quotas(80)["simple"] == 32 and E.quotas(3) == {"simple": 1, "multi_part": 1, "troubleshoot": 1, "comparison": 1, "out_of_scope": 1}


def test_sitemaps_to_depth_two(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    urls = lambda *u: "<n:urlset xmlns:n='x'>" + "".join(f"<n:url><n:loc>{x}</n:loc></n:url>" for x in u) + "</n:urlset>"
    files = [("m0", index("m1")), ("m1", index("m2", "p")), ("m2", index("m3")), ("p", urls("http://h/a", "http://o/a")), ("m3", urls("http://h/deep"))]
    d = spark.createDataFrame(files, "sitemap string, xml string")
    got = S.sitemap_pages(spark.createDataFrame([("http://h", "m0")], "base string, sitemap string"), d)
    assert [tuple(r) for r in got.collect()] == [("http://h", "http://h/a")]


def test_crawl_depths(spark):
    page = lambda *h: "".join(f'<a class="k" href="{x}">x</a>' for x in h)
    rows = [("http://h/", page("/a", "/b#f", "/x.pdf", "http://o/")), ("http://h/a", page("/c", "/")), ("http://h/b", page("/a")), ("http://h/c", page("/d")), ("http://h/d", page("/e")), ("http://h/e", ""), ("http://o/", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    starts = spark.createDataFrame([("http://h", "http://h/")], "base string, start string")
    assert {r.url: r.depth for r in S.crawl(pages, starts, 3).collect()} == {"http://h": 0, "http://h/a": 1, "http://h/b": 1, "http://h/c": 2, "http://h/d": 3}


def test_crawl_follows_links_to_depth_5(spark):
    """The depth of the reference's crawler; the page at depth 6 is beyond it."""
    pages = spark.createDataFrame([("http://h", '<a href="/p1">')] + [(f"http://h/p{i}", f'<a href="/p{i + 1}"><a href="/">') for i in range(1, 8)], "url string, html string")
    starts = spark.createDataFrame([("http://h", "http://h")], "base string, start string")
    assert {r.url: r.depth for r in S.crawl(pages, starts).collect()} == {"http://h": 0} | {f"http://h/p{i}": i for i in range(1, 6)}


def test_stream_and_batch_chunks_agree(spark, tiny):
    from corvex import catalog

    q = catalog.queries()
    rows = lambda n: {(r.source_url, r.page_number, r.content) for r in q[n](spark, tiny).collect()}
    assert rows("stream_page_index") <= rows("c9_crawl_chunks")


def test_entry_without_training_data_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corvex", tmp_path / "corvex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
