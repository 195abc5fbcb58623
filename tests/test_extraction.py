"""The whole page's text as a fallback, written dumps, answers of parts with their images, batches with failures."""

import threading

from pyspark.sql import functions as F

from corvex.operators import html as H
from corvex.plans import answering as A
from corvex.sources import dumps as D

PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><BODY><header>Top</header><!-- no --><nav><a class="x" href="/a">A</a></nav>'
    "<h2 id='h'>Big &amp; &lt;b&gt;</h2><p>one\n  two<br/>three</p><ul><li>i</li><li><b>j</b></li></ul><script>var t='</p>';</script></BODY></html>"
)


def raw(spark, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in d.select("i", H.raw_markdown(F.col("t")).alias("v")).orderBy("i").collect()]


def test_all_text_of_a_page(spark):
    assert raw(spark, PAGE, None, "", "no tags", "&amp;lt;", "<p><p><p>a<p><p><p>b") == ["Top\n\n[A](/a)\n\n## Big & <b>\n\none two\nthree\n\n- i\n- j", None, "", "no tags", "&lt;", "a\n\nb"]
    long = raw(spark, "<script>" + "x" * 200_000 + "</script>" + "<p>w</p>" * 20_000)[0]
    assert long.count("w") == 20_000 and "x" not in long


def test_fallback_below_thirty_words(spark):
    rows = [("w " * 29, PAGE), ("w " * 30, PAGE), (None, PAGE), ("short", ""), ("short", None), (None, None), ("short", "<p>[x](y)</p>")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, h string")
    got = [r.v for r in d.select("i", H.page_markdown(F.col("m"), F.col("h")).alias("v")).orderBy("i").collect()]
    whole = "Top\n\n## Big & <b>\n\none two\nthree\n\n- i\n- j"
    assert got == [whole, "w " * 30, whole, "short", "short", "", ""]


def test_extracted_pages_fall_back(spark):
    menu = "<title>M</title><nav>" + "<p>only the menu has text</p>" * 2 + "</nav><main><p>few</p></main>"
    full = "<title></title><main><p>" + "word " * 40 + "</p></main><nav>menu</nav>"
    d = spark.createDataFrame([(1, "http://h/a", menu), (2, "http://h/b", full), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.markdown) for r in H.extracted(d.filter("page_id < 3")).collect()}
    assert got[1] == ("M", "only the menu has text\n\nonly the menu has text\n\nfew") and got[2] == ("/b", ("word " * 40).strip())
    assert {r.page_id: r.markdown for r in H.extracted(d.filter("page_id < 3"), fallback=False).collect()}[1] == "few"


def test_dumps_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("http://H.org/x/y", "T", "a b\n\"c\"  é", "<p>"), ("http://h.org/x-y", None, None, None), (None, "N", "", "z")], "url string, title string, m string, h string")
    D.write_dumps(d, {"fit": F.col("m"), "html": F.col("h")}, str(tmp_path / "d"))
    got = {(r.url, r.kind): (r.name, r.words, r.chars, r.body) for r in D.read_dumps(spark, str(tmp_path / "d")).collect()}
    head = "# {}\nSource: {}\nMethod: fit\nWords: {}\n\n---\n\n{}"
    assert got[("http://H.org/x/y", "fit")] == ("h-org-x-y__fit.md", 4, 10, head.format("T", "http://H.org/x/y", 4, "a b\n\"c\"  é"))
    assert got[("http://H.org/x/y", "html")] == ("h-org-x-y__html.html", 1, 3, "<p>")
    assert got[("http://h.org/x-y", "fit")] == ("h-org-x-y__fit.md", 0, 0, head.format("", "http://h.org/x-y", 0, ""))
    assert got[(None, "html")] == ("page__html.html", 1, 1, "z") and len(got) == 6
    one = D.read_dumps(spark, str(tmp_path / "d"), "html")
    assert one.count() == 3 and all("kind=html" in f for f in one.select(F.input_file_name().alias("f")).distinct().toPandas().f)
    sizes = {r.url: (r.fit_words, r.html_chars) for r in D.compared(D.read_dumps(spark, str(tmp_path / "d"))).collect()}
    assert sizes == {"http://H.org/x/y": (4, 3), "http://h.org/x-y": (0, 0), None: (0, 1)}


def test_parts_are_combined_with_their_images(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "bad"), (4, None)], "qid long, text string")
    parts = spark.createDataFrame([(1, 1, "b", "B"), (1, 0, "a", None), (3, 0, "c", "C"), (4, 0, None, "D")], "qid long, qno int, text string, answer string")
    chunks = [(1, 1, 1, "image", 7, "cap7", "data/i\\7.png"), (1, 0, 2, "image", 5, "cap5", "x/data/5.png"), (1, 0, 1, "image", 4, "no", "img/4.png"), (1, 0, 3, "text", 3, "no", "data/3.png"), (1, 0, 4, "image", 2, None, None), (1, 1, 2, "image", 5, "cap5", "x/data/5.png"), (2, 0, 1, "image", 1, "c", "data/1.png")]
    chunks = spark.createDataFrame(chunks, "qid long, qno int, place int, type string, page_number long, content string, image_path string")
    combine = lambda question, said: F.when(question == "bad", None).otherwise(said)
    got = {r.qid: (r.answer, [tuple(i) for i in r.images]) for r in A.combine_answers(q, parts, chunks, combine).collect()}
    five = ("x//static/5.png", 5, "cap5")
    assert got[1] == ("Sub-question: a\nAnswer: \n\nSub-question: b\nAnswer: B", [five, ("/static/i/7.png", 7, "cap7"), five])
    assert got[2] == (A.NO_PARTS, []) and got[3] == (A.NOT_COMBINED, []) and got[4] == ("Sub-question: \nAnswer: D", [])


def test_failed_batches_are_cut_and_asked_side_by_side(spark):
    q = spark.createDataFrame([(i, "bad" if i % 9 == 4 else f"t{i}") for i in range(30)], "qid long, text string")
    lock, running, most, calls = threading.Lock(), [0], [0], [0]

    def ask(part, index, vectors, least):
        with lock:
            running[0], calls[0] = running[0] + 1, calls[0] + 1
            most[0] = max(most[0], running[0])
        try:
            if part.filter("text = 'bad'").count():
                raise RuntimeError("no answer")
        finally:
            with lock:
                running[0] -= 1
        return part.select("qid", F.upper("text").alias("answer"), F.lit(1).alias("n_chunks"))

    got = {r.qid: (r.answer, r.error) for r in A.run_batch(q, None, None, ask=ask, pieces=4).collect()}
    assert got == {i: ("", "no answer") if i % 9 == 4 else (f"T{i}", None) for i in range(30)}
    assert 1 < most[0] <= 4 and calls[0] < 30
    assert A.run_batch(q.limit(0), None, None, ask=ask).count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
