"""Phrase collocations against brute force in plain Python, and the kernels of its keys."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvex.llm import phrases as P
from corvex.llm.phrases import LEAST_BITS, bit_of, bitmap_of, packed, phrases, radix_order, run_lengths, tokens, unpacked

SCHEMA = "doc_id long, text string, lang string, key string, id string, n string, score string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, covered=80, top=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in good.items():
            if 100 * inside[p] >= covered * a:
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["la", "le", "É", "über", "x", "New", "YORK", "city", "of", "the", "end", "🎉", "a-b", "\x00\x1c"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! ", " \x0b"]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(n))
    rows = [(line(rng.randrange(60)), rng.choice(["en", "fr", None])) for _ in range(200)]
    rows += [("the new york city hall opens", "en")] * 35 + [("the New York city of light", "en")] * 34 + [("aa aa aa aa aa aa", "fr")] * 12
    rows += [(line(9000), "en"), ("", "fr"), (None, None), (None, "en"), (" . ", "de"), ("x" * 5000, "de"), ("one two three", "one document")]
    return rows


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(None if i % 5 else i, t, lang, "k", "i", "n", "s") for i, (t, lang) in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"least": 5, "top": 40}, {"least": 3, "longest": 3}, {"least": 2, "covered": 101, "max_words": 4}])
def test_against_brute_force(frame, texts, options):
    plain = {k: v for k, v in options.items() if k != "max_words"}
    got = sorted(tuple(r) for r in phrases(frame, **options).collect())
    want = brute(texts, **plain)
    assert want and got == want


def test_empty(spark, frame):
    assert phrases(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert phrases(frame, least=10**6).isEmpty()


def test_one_phrase_in_most_places(spark):
    rows = spark.range(4000).select(F.lit("hot pair here").alias("text"), F.lit("en").alias("lang"))
    assert [tuple(r) for r in phrases(rows).collect()] == [("en", 1, "hot pair here", 4000, 4000, 4000, 12000, 1_000_000)]


def test_keys():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 5, (4000, 2)).astype(np.uint64) << rng.integers(0, 60, (4000, 2)).astype(np.uint64)
    assert key[radix_order(key)].tolist() == sorted(key.tolist())
    distinct, count = run_lengths(key)
    assert dict(zip(map(tuple, distinct.tolist()), count.tolist())) == Counter(map(tuple, key.tolist()))
    assert run_lengths(np.concatenate([distinct, distinct]), np.concatenate([count, count]))[1].tolist() == (2 * count).tolist()
    binary = packed(key)
    assert unpacked(binary).tolist() == key.tolist() and unpacked(binary.slice(5, 7)).tolist() == key[5:12].tolist()
    assert sorted(binary.to_pylist()) == [bytes(np.array(k, ">u8").tobytes()) for k in sorted(key.tolist())]
    assert tokens("A b,Çc\r\n d\x1ce  f".encode()) == [b"a", b"b", b"\xff", "Çc".encode(), b"\xff", b"\xff", b"d\x1ce", b"f"]


def test_bitmap_holds_every_key(spark):
    key = np.random.default_rng(4).integers(0, 2**63, (500, 2)).astype(np.uint64)
    bits, raw = bitmap_of(spark.createDataFrame(pa.table({"key": packed(key)}).to_pandas()), len(key))
    bit, table = bit_of(key, bits), np.frombuffer(raw, np.uint8)
    assert bits == LEAST_BITS and all(table[b >> 3] >> (b & 7) & 1 for b in bit.tolist()) and int(np.unpackbits(table).sum()) == len(set(bit.tolist()))


def test_rows_and_batches_are_small_and_lose_no_ngram(monkeypatch):
    """What one row, one Parquet page of 100 rows or one batch holds has a bound, however long the texts are."""
    monkeypatch.setattr(P, "PASSED", 1000)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    held = SimpleNamespace(value=pa.table({"lang": ["en"] * 300, "word": [w.encode() for w in words], "id": range(1, 301)}))
    texts = [" ".join(rng.choice([*words, "rare", "."]) for _ in range(n)) for n in (50_000, 3, 4096, 0, 8191, 4095, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["en"] * len(texts)), pa.array(texts)], names=["at", "lang", "text"])
    rows = [r for b in P._encode(held)([batch]) for r in b.to_pylist()]
    assert max(len(r["ids"]) for r in rows) <= 4 * (P.ROW_IDS + P.LONGEST - 1) and len({(r["at"], r["part"]) for r in rows}) == len(rows) > 10
    numbers = {w: i for i, w in enumerate(words, 1)}
    ids = [numbers.get(t, 0) for text in texts for t in [*text.split(), "."]]
    assert sum(r["n"] for r in rows) == len(ids)
    some = [pa.RecordBatch.from_pylist(rows[i : i + 7], pa.schema({"n": pa.int64(), "ids": pa.binary()})) for i in range(0, len(rows), 7)]
    for n in (2, 3, 4):
        out = list(P._count(n, SimpleNamespace(value=None), b"")([b.slice(0) for b in some]))
        assert max(b.num_rows for b in out) <= 1000
        got = Counter()
        for b in out:
            for key, f in zip(unpacked(b.column("key")).tolist(), b.column("f").to_pylist()):
                got[tuple(key)] += f
        grams = np.array([ids[i : i + n] + [0] * (4 - n) for i in range(len(ids) - n + 1) if all(ids[i : i + n])], np.uint64)
        assert got == Counter(map(tuple, (grams[:, ::2] << np.uint64(32) | grams[:, 1::2]).tolist()))


def test_words_of_texts_are_counted_and_passed_on_as_lists(monkeypatch):
    monkeypatch.setattr(P, "COUNTED", 5)
    texts = ["Aa b\tB. é-é aa", "", " ;; ", "b\x0bb\u00a0c ÀA"] * 3
    want = Counter((lang, w.decode()) for lang in ("en", "fr") for t in texts for w in P.tokens(t.encode()) if w != P.MARK)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts) + ["fr"] * len(texts)), pa.array(texts * 2)], names=["lang", "text"])
    got = Counter()
    for b in P._count_words([batch, batch.slice(0, 0)]):
        for r in b.to_pylist():
            got[r["lang"], r["word"]] += r["f"]
    assert got == want
    assert P.word_array([t.encode() for t in texts]).to_pylist() == [w for t in texts for w in [*P.tokens(t.encode()), P.MARK]]
    ids = np.arange(1, 5001, dtype=np.uint32)
    rows = pa.RecordBatch.from_arrays([pa.array([5000]), pa.array([ids.tobytes()], pa.binary())], names=["n", "ids"])
    count = P._count(2, SimpleNamespace(value=None), P.packed(P.key_of(ids, np.array([1000, 3000]), 2)).buffers()[2].to_pybytes())
    lists = [r for b in P._listed(count)([rows]) for r in b.to_pylist()]
    assert [r["part"] for r in lists] == [0, 1, 2] and sum(len(r["keys"]) for r in lists) == 16 * 4999 == 2 * sum(len(r["counts"]) for r in lists)
    summed = list(P._sum(1)([pa.RecordBatch.from_pylist(lists * 2, pa.schema({"part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()})).select(["keys", "counts"])]))
    assert sum(b.num_rows for b in summed) == 4999 and all(set(b.column("f").to_pylist()) == {2} for b in summed)
