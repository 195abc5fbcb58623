import pytest

from corvex.service import Service


def test_service(spark, tmp_path):
    s = Service(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("My File.pdf", "red fox jumps over. " * 30), ("other.pdf", "blue whale sings. " * 30)], "name string, text string")
    s.add_documents("ann", docs)
    s.add_documents("ann", docs)
    s.add_documents("bob", docs.limit(1))
    assert sorted(r.pdf_name for r in s.processed("ann").collect()) == ["my-file", "other"]
    assert s.table("chunks").filter("user_id = 'ann'").count() == 2
    html = "<title>T</title><main><p>" + "green parrot talks all day. " * 20 + "</p></main>"
    s.add_pages("ann", spark.createDataFrame([("https://h.org/a", html), ("https://h.org/b", html.replace("green parrot", "small turtle"))], "url string, html string"))
    assert [(r.pdf_name, r.chunks_count) for r in s.sites("ann").collect()] == [("h-org", 2)]
    q = spark.createDataFrame([(1, "red fox"), (2, "green parrot talks day"), (3, "zzz")], "qid long, text string")
    out = {r.qid: r for r in s.ask("ann", q).collect()}
    assert "red fox" in out[1].answer and "parrot" in out[2].answer and out[3].abstained
    assert {r.qid: r.abstained for r in s.ask("bob", q).collect()} == {1: False, 2: True, 3: True}
    assert [(r.conversation_id, r.n_messages) for r in s.conversations("ann").collect()] == [(3, 2), (2, 2), (1, 2)]
    assert [r.role for r in s.messages("ann", 1).collect()] == ["user", "assistant"]
    assert s.delete_document("ann", "my-file") and not s.delete_document("ann", "my-file")
    assert {(r.user_id, r.pdf_name) for r in s.table("chunks").collect()} == {("ann", "other"), ("ann", "h-org"), ("bob", "my-file")}
    assert s.delete_conversation("ann", 1) and s.messages("ann", 1).isEmpty() and not s.messages("bob", 1).isEmpty()
    job = s.table("jobs").filter("user_id = 'ann' and pdf_name = 'other'").first()
    assert s.status("ann", job.job_id).first().progress == 1.0 and s.status("bob", job.job_id).isEmpty()
    for call in (lambda: s.documents(""), lambda: s.ask(None, q), lambda: s.add_documents("", docs)):
        with pytest.raises(ValueError):
            call()


def test_indexes_are_kept_until_chunks_change(spark, tmp_path):
    s = Service(spark, str(tmp_path / "store"))
    s.add_documents("ann", spark.createDataFrame([("a.pdf", "red fox jumps over. " * 30), ("b.pdf", "blue whale sings. " * 30)], "name string, text string"))
    q = spark.createDataFrame([(1, "red fox"), (2, "blue whale sings")], "qid long, text string")
    found = lambda **k: {r.qid: r.abstained for r in s.ask("ann", q, **k).collect()}
    assert found() == {1: False, 2: False} == found() and s.handles.built == 1
    assert found(pdf_name="a") == {1: False, 2: True} and s.handles.built == 2
    again = Service(spark, str(tmp_path / "store"))
    assert {r.qid for r in again.ask("ann", q).collect()} == {1, 2} and (again.handles.built, again.handles.loaded) == (0, 1)
    s.delete_document("ann", "a")
    assert found() == {1: True, 2: False} and s.handles.built == 3
    s.add_documents("ann", spark.createDataFrame([("c.pdf", "red fox again. " * 30)], "name string, text string"))
    assert found() == {1: False, 2: False} and s.handles.built == 4


def test_handles_are_bounded_and_invalidated(spark, tmp_path):
    from corvex.plans.handles import IndexHandles

    h = IndexHandles(spark, str(tmp_path), most=2)
    chunks = lambda: spark.createDataFrame([(1, 1, "red fox")], "doc_id long, page_number long, content string")
    for site in ("s", "t", "u"):
        h.get("ann", site, 1, chunks)
    assert [k[1] for k in h.held] == ["t", "u"] and h.built == 3
    h.get("ann", "s", 1, chunks)
    assert (h.built, h.loaded) == (3, 1) and [k[1] for k in h.held] == ["u", "s"]
    assert h.invalidate("ann", "s") and not h.invalidate("ann", "s")
    h.get("ann", "s", 1, chunks)
    assert h.built == 4
    with pytest.raises(ValueError):
        h.get("", "s", 1, chunks)


def test_a_crash_between_versions_leaves_a_table(spark, tmp_path):
    s = Service(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, 0, "user", "hi", "ann")], "conversation_id long, turn int, role string, content string, user_id string")
    s.append("messages", rows)
    point, s._point = s._point, lambda *a: (_ for _ in ()).throw(RuntimeError("down"))
    with pytest.raises(RuntimeError):
        s.delete_conversation("ann", 1)
    s._point = point
    assert s.messages("ann", 1).count() == 1
    s.append("messages", rows.withColumn("turn", rows.turn + 1))
    assert s.messages("ann", 1).count() == 2 and s.delete_conversation("ann", 1) and s.messages("ann", 1).isEmpty()
