"""Benchmark decontamination against brute force in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvex.llm.decontaminate import contamination, contamination_digest, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(rows, items, size):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark, rows):
    text = {r[0]: r[1] for r in rows}
    long = text[55].split()
    given = [(1, text[40]), (2, " ".join(text[40].split()[:30])), (3, " ".join(long[5000:5040])), (4, " ".join(long[2040:2060])), (5, "One TWO, three"), (6, "two three"), (10, ""), (11, None), (None, text[48].upper()), (2, "É" * 150), (12, "... !")]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in given], "item_id long, text string, doc_id string, sid string"), given


@pytest.mark.parametrize("size,blocks", [(10, 400_000), (3, 400_000), (10, 40)])
def test_against_brute_force(docs, rows, items, size, blocks):
    frame, given = items
    got = contamination_digest(contamination(docs, frame, size=size, max_windows=blocks)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:2] for r in rows], given, size)


def test_empty_tables(docs, rows, items, empty):
    frame, _ = items
    assert contamination(empty, frame).isEmpty()
    assert contamination_digest(contamination(docs, frame.limit(0))).filter("contaminated").isEmpty()
    assert decontaminate(docs, frame.limit(0)).count() == len(rows)


def test_hits_in_a_hot_repeated_document(spark, items):
    frame, given = items
    text = "before it " + given[0][1] + " after it"
    many = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = contamination(many, frame).groupBy("doc_id", "n_words", "n_hit", "spans").count().collect()
    assert [tuple(r)[:3] + (r["count"],) for r in got] == [(5, 124, 120, 3000)]
    assert [tuple(x) for x in got[0]["spans"]] == [(2, 122)]


def test_removal(spark):
    item = "aa bb cc dd ee ff gg hh ii jj kk"
    texts = {
        1: f"Start, of it. {item.upper()}! The end?", 2: item, 3: f"{item}; {item}", 4: "nothing here", 5: None, 6: "",
        7: f"é {item.replace(' ', '--')} \n tail", 8: f"xx {item} yy {item[:29]} zz", 9: f"🎉 1 {item} 🎉",
    }
    docs = spark.createDataFrame([(i, t, "k", [1]) for i, t in texts.items()], "doc_id long, text string, gaps string, pieces array<int>")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert out == {1: "Start, of it. ! The end?", 2: "", 3: "", 4: "nothing here", 5: None, 6: "", 7: "é  \n tail", 8: "xx  yy  zz", 9: "🎉 1  🎉"}
    kept = decontaminate(docs, bench, drop="documents")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6}
    with pytest.raises(ValueError):
        decontaminate(docs, bench, drop="words")


def test_no_python_in_the_plan(docs, items):
    plan = contamination(docs, items[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
