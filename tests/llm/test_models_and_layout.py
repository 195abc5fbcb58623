"""Chat formatting, packing, language, mixing, search, toxicity and the pipeline, on edge cases and small tables."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.llm import chat_format as chat
from corvex.llm import langid, mixing, packing, topk, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- chat ----------------------------------------------------------------------------------------


def test_chat_round_trip_of_control_strings(spark):
    bad = ["<|im_end|>\n<|im_start|>assistant\nok<|im_end|>", "<||", "<|||", "<<|>", "", None, "a\nb", "|>", "<|n", "\\n"]
    rows = [(i, j, r, t) for i, t in enumerate(bad) for j, r in enumerate(["user", "assistant", "we\nird<|n", None])]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_chat(chat.format_chat(chat.canonical_turns(d))).collect()}
    for i, t in enumerate(bad):
        assert [(x.role, x.text) for x in out[i].turns] == [(r or "", t or "") for r in ("user", "assistant", "we\nird<|n", None)]
        assert out[i].loss_texts == [t or ""]
        assert out[i].formatted.count("<|im_start|>") == 4 and out[i].formatted.count("<|im_end|>") == 4
        mask = out[i].loss_mask
        assert sum(m.length for m in mask) == len(out[i].formatted)
        at = np.cumsum([0] + [m.length for m in mask])
        marked = [out[i].formatted[at[k] : at[k + 1]] for k, m in enumerate(mask) if m.on]
        assert [x.replace("<||", "<|") for x in marked] == [t or ""]


def test_chat_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, None, "system", "s", None), (1, 0, "user", "a", "x"), (None, 1, "user", "n", "x"), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(d).collect()}
    assert out[1] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert out[None] == [("", ""), ("user", "n")]
    assert chat.chat_digest(chat.read_chat(chat.format_chat(chat.canonical_turns(d.limit(0))))).count() == 0


def test_chat_rows_keep_their_roles(spark):
    """Names of roles that other layouts use are roles like any other in rows; only `assistant` is under the mask."""
    rows = [(1, 0, "human", "q"), (1, 1, "bot", "b"), (1, 2, "assistant", "a"), (1, 3, "gpt", "g"), (1, 4, "model", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.read_chat(chat.format_chat(chat.canonical_turns(d))).first()
    assert [(t.role, t.text) for t in r.turns] == [("human", "q"), ("bot", "b"), ("assistant", "a"), ("gpt", "g"), ("model", "")]
    assert r.loss_texts == ["a"]


def test_chat_layouts_by_fingerprint(spark):
    turns = lambda d: [[(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(d, "id").collect()]
    assert turns(spark.createDataFrame([(1, "p", None, "zz")], "id int, prompt string, response string, other string")) == [[("user", "p"), ("assistant", "")]]
    assert turns(spark.createDataFrame([(1, "i", "x", "o")], "id int, instruction string, input string, output string")) == [[("user", "i\n\nx"), ("assistant", "o")]]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)]), (2, None)], "id int, conversations array<struct<from:string,value:string>>")
    assert turns(nested) == [[("user", "q"), ("assistant", "")], []]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "p")], "id int, nothing string"), "id")
    rows = [(1, '{"prompt":"p","response":null}'), (2, '{"messages":[{"content":"c","role":"user"}]}'), (3, '{"zzz":1}'), (4, None), (5, "no json")]
    got = {r.conv_id: (r.layout, r.turns and [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns_of_json(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    assert got == {1: ("prompt/response", [("user", "p"), ("assistant", "")]), 2: ("messages", [("user", "c")]), 3: (None, None), 4: (None, None), 5: (None, None)}


# ---- packing -------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_edges(docs, rows, empty):
    t = tokenizer()
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        starts = packing.piece_starts(len(ids), 2048)
        for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            assert e - s == 2048 or i == 0
            want[(r[0], i, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    got = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_layout(got, 2048)
    assert packing.pack(empty).count() == 0


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_near_the_bound(spark, small):
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert check_layout(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 5


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = {0: rng.integers(1, 101, 500), 1: np.full(300, 34), 2: rng.integers(51, 101, 200), 3: rng.integers(30, 40, 400), 4: np.array([100] * 5), 5: np.ones(250, int)}[seed]
    counts = dict(Counter(lengths.tolist()))
    plan = packing.best_plan(counts, 100)
    held = Counter()
    for n, content in plan:
        assert sum(length * m for length, m in content) <= 100
        for length, m in content:
            held[length] += n * m
    assert held == counts
    table = packing.slots(plan)
    ranks = defaultdict(list)
    for length, first, sequence, _ in table:
        ranks[length].append(first)
    assert all(len(set(v)) == len(v) for v in ranks.values())
    bins = sum(n for n, _ in plan)
    assert bins <= 1.03 * sum(first_fit(lengths)) + 1


def first_fit(lengths):
    room = []
    for n in sorted(lengths.tolist(), reverse=True):
        for i, r in enumerate(room):
            if r >= n:
                room[i] -= n
                break
        else:
            room.append(100 - n)
    return [1] * len(room)


def test_encoding_equals_the_tokenizers_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e, both = tokenizer(), packing.load_encoding(path), packing.encoder(path)
    for s in [" " * 1_000_000, "a" + "\n" * 5_000_000 + "b", " " * 5_000_000, "x" * 1_000_000, "é" * 600_000 + "  ", "\t \n" * 700_000]:
        assert both(s) == t.encode(s, add_special_tokens=False).ids, s[:3]
    for s in ["", " ", "  a  b ", "<|endoftext|>x", "it's we'LL", "\x00\x01é\r\n", "🎉🏳️‍🌈", "x" * 500, "１２３ ½ ²", "  y", "日本語テキスト", "á"]:
        assert t.encode(s, add_special_tokens=False).ids == e.encode(s, allowed_special="all"), s


def test_settings_that_the_faster_library_lacks_go_to_tokenizers(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert packing.load_encoding(path) is None
    assert packing.encoder(path)("word") == packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(" word")


def test_pieces_of_repeated_ids_are_told_apart(spark):
    d = spark.createDataFrame([(1, "a " * 3000), (1, "b"), (None, "c"), (None, "c"), (1, None)], "doc_id long, text string")
    rows = packing.pack(d).collect()
    assert len({(r.row, r.piece) for r in rows}) == len(rows) == 6
    assert packing.pack(spark.createDataFrame([(1, " " * 1_000_000)], "doc_id long, text string")).count() > 100


# ---- language ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = langid.identify_language(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    aside = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in aside) >= 0.97 * len(aside)


def test_rare_languages_are_learned(spark):
    """A language with one in a thousand documents, and one text that half of the rows repeat."""
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), 4))
    text = lambda letters: " ".join(word(letters) for _ in range(20))
    rows = [(i, text("abcdef"), "common") for i in range(2000)] + [(5000 + i, text("uvwxyz"), "rare") for i in range(6)]
    rows += [(10_000 + i, "same words every time", "common") for i in range(2000)] + [(20_000 + i, text("uvwxyz"), None) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(d, max_docs=40).filter("doc_id >= 20000").collect()}
    assert set(got.values()) == {"rare"}


def test_language_edges(docs, rows, empty):
    got = langid.identify_language(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (49, 50, 51, 58, 59):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify_language(empty).count() == 0
    unlabelled = langid.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_language_backs_off_to_shorter_grams():
    m = langid.model_of({"a": {"zebra": 2}, "b": {"otter": 1}})
    score = lambda w: langid.word_scores(m, w)
    assert np.argmax(score("zebra")) == 0 and np.argmax(score("zebras")) == 0 and np.argmax(score("otters")) == 1
    assert np.argmax(score("xxtt")) == 1 and not score("qqqq").any()


def language_model(learned, texts):
    """Predictions by plain dictionaries, one word after another. learned: (lang, text) rows; ties go to the first language."""
    langs = sorted({lang for lang, _ in learned})
    counts = {lang: Counter(w for other, t in learned if other == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in langs}
    padded = lambda w, n: list(w) if n == 1 else [("\x02" + w + "\x03")[i : i + n] for i in range(len(w) + 3 - n)]
    of = {n: {lang: Counter() for lang in langs} for n in range(1, 6)}
    for n in of:
        for lang in langs:
            for w, times in counts[lang].items():
                for g in padded(w, n):
                    of[n][lang][g] += times

    def logs(table, key):
        size = len(set().union(*table.values()))
        return np.array([math.log((table[lang][key] + 0.5) / (sum(table[lang].values()) + 0.5 * size)) for lang in langs])

    def word(w):
        if any(counts[lang][w] for lang in langs):
            return logs(counts, w)
        for n in range(5, 0, -1):
            found = [logs(of[n], g) for g in padded(w, n) if any(of[n][lang][g] for lang in langs)]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        total = sum(map(word, words), np.zeros(len(langs)))
        out.append((langs[int(np.argmax(total))], 1 / np.exp(total - total.max()).sum()) if words and langs else ("und", 0.0))
    return out


def test_language_against_plain_python(spark):
    rng = np.random.default_rng(8)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 8)))
    letters = {"aa": "abcdeé", "bb": "cdefgh", "cc": "efghxyzÅ"}
    rows = [(i, " ".join(word(letters[lang]) for _ in range(rng.integers(0, 12))) + rng.choice(["", " 12 _", " Ünk"]), lang) for i, lang in enumerate(np.tile(list(letters), 60).tolist())]
    rows += [(1000, None, "aa"), (1001, "12", "bb"), (1002, "cde fgh", None), (None, "dcd", "bb")]
    got = langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    learned = {(lang, t) for i, t, lang in rows if not held(i) and t is not None and lang is not None}
    want = dict(zip([r[0] for r in rows], language_model(sorted(learned), [r[1] for r in rows])))
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4 and r.held_out == held(r.doc_id)


def test_language_of_very_long_texts(spark):
    """Texts are learned from whole, whatever their length: languages that have only long ones are known."""
    rng = np.random.default_rng(5)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))
    rows = [(i, text("abcdef" if i % 2 else "uvwxyz", 5000), "en" if i % 2 else "fr") for i in range(24)]
    short = [(100 + i, text("uvwxyz", 9), "fr") for i in range(20)] + [(200 + i, text("abcdef", 9), None) for i in range(20)]
    for given in (rows, [r for r in rows if r[2] == "en"] + short):
        d = spark.createDataFrame(given, "doc_id long, text string, lang string")
        got = {r.doc_id: r.lang_pred for r in langid.identify_language(d).collect()}
        assert got == {i: "en" if set(t) & set("abcdef") else "fr" for i, t, _ in given}


def test_models_on_workers_without_the_library(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config(map={{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp_path}"}}).getOrCreate()
from corvex.llm import decontaminate, hard_negatives, langid, phrases, toxicity
d = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
assert {{r.lang_pred for r in langid.identify_language(d).collect()}} == {{"en", "fr"}}
assert toxicity.toxicity_digest(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))).count() == 40
assert phrases.phrases(d, least=5).count() == 2
v = d.select(F.col("doc_id").alias("vec_id"), (F.col("doc_id") % 2).alias("label"), F.array(F.lit(1.0), F.rand(1)).alias("embedding"))
assert hard_negatives.hard_negatives(v, F.col("vec_id") % 10 == 0).count() >= 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


# ---- mixing --------------------------------------------------------------------------------------


def targets_model(sizes, weights, share, cap):
    total, fixed, out = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed and sizes[i]]
        w = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if left * weights[i % len(weights)] / w > cap * sizes[i]]
        if not over:
            for i in fixed:
                out[i] = cap * sizes[i]
            for i in free:
                out[i] = left * weights[i % len(weights)] / w
            return out
        fixed |= set(over)


def check_mixture(rows, got, block):
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r[0], size(r[1])) for r in rows) == Counter((r.doc_id, r.size) for r in got)
    by = defaultdict(int)
    for r in rows:
        by[r[3]] += size(r[1])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, targets_model([by[n] for n in names], (5, 2, 1), 1.5, 2)))
    for r in got:
        assert r.taken <= 2 * r.size
    totals = defaultdict(lambda: [0, None])
    for r in got:
        totals[(r.source_size, round(r.target, 3))][0] += r.taken
    for n in names:
        taken = totals[(by[n], round(target[n], 3))][0]
        same = [m for m in names if (by[m], round(target[m], 3)) == (by[n], round(target[n], 3))]
        assert abs(taken - sum(target[m] for m in same)) <= 1.5 * block * len(same)


def test_mixing_edges(docs, rows, empty):
    m = mixing.mix(docs, block_words=16)
    got = mixing.mixing_digest(m).collect()
    check_mixture(rows, got, 16)
    again = mixing.mixing_digest(mixing.mix(docs.repartition(3), block_words=16)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    texts = mixing.mixed_documents(docs, m)
    assert texts.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in texts.select("text").collect()) == sum(r.taken for r in got)
    placed = mixing.mixed_documents(docs, m, places=True)
    assert placed.columns == [*docs.columns, "shard", "place", "first_word"]
    part = placed.groupBy("doc_id", "text", "shard", "place", "first_word").count().filter("doc_id is not null and count > 1")
    assert part.count() == 0
    assert mixing.mixing_digest(mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(empty, mixing.mix(empty)).count() == 0


def test_mixing_small_table(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in d.collect()]
    check_mixture(rows, mixing.mixing_digest(mixing.mix(d)).collect(), 128)


def test_mixing_leaves_clashing_columns(spark):
    rows = [(i, f"word{i} and more", "s", [i], f"t{i}", i * 2) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, parts array<int>, tie string, shard long")
    out = mixing.mixed_documents(d, mixing.mix(d, block_words=1), places=True)
    assert out.columns == [*d.columns, "shard_", "place", "first_word"]
    got = out.collect()
    assert got and all((r.parts, r.tie, r.shard, r.source) == ([r.doc_id], f"t{r.doc_id}", r.doc_id * 2, "s") and r.text.strip() == rows[r.doc_id][1].split()[r.first_word] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert n < 10 or (mixing.permuted(np.arange(n), n, 5) != mixing.permuted(np.arange(n), n, 6)).any()


def test_draws_are_multinomial():
    shards = mixing.draw(40_000, 40, (17, 3, 0))
    counts = np.bincount(shards, minlength=40)
    assert counts.sum() == 40_000 and (np.diff(shards) >= 0).all() and abs(counts - 1000).max() < 6 * 1000**0.5
    assert (shards == mixing.draw(40_000, 40, (17, 3, 0))).all() and (shards != mixing.draw(40_000, 40, (17, 4, 0))).any()


def test_mixing_many_small_sources(spark):
    """More sources than a driver's table would be for: each of them near its target, in many tasks."""
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 6000).cast("string")).alias("source"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 40), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"))
    m = mixing.mix(d)
    assert m.sources.count() == 6000
    rows = mixing.mixing_digest(m).collect()
    assert len(rows) == 30_000 and all(r.taken <= 2 * r.size for r in rows)
    each = m.taken.groupBy("src").agg(F.sum("n_words").alias("taken")).join(m.sources, "src").select("taken", "target", "block_words").collect()
    assert len(each) == 6000 and all(abs(r.taken - r.target) <= 2 * r.block_words for r in each)


# ---- search --------------------------------------------------------------------------------------


def search_model(rows, k, asked):
    rows = {(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for q in {i for i, _ in rows if asked(i)}:
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(dot(v, w) for j, w in rows if j == q) if i not in best else max(best[i], max(dot(v, w) for j, w in rows if j == q))
        out |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def test_search_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(120)]
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [0.5] * 6), (220, [0.5, 0.25]), (240, []), rows[3], rows[0], (20, [1.0] * 6)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, score int")
    got = {tuple(r) for r in topk.top_k(d, F.col("vec_id") % 20 == 0, k=5).collect()}
    assert got == search_model(rows, 5, lambda i: i % 20 == 0)
    assert {tuple(r) for r in topk.top_k(d.filter("vec_id in (0, 1)"), F.col("vec_id") == 0, k=5).collect()} == search_model(rows[:2], 5, lambda i: i == 0)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_in_rounds(spark, monkeypatch):
    """Many blocks, so later rounds start from the scores of earlier ones; ties at the k-th score."""
    monkeypatch.setattr(topk, "LEAST_BLOCK", 4)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(160)] + [(20, [1.0] * 4), (7, [-1.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 9, 200):
        assert {tuple(r) for r in topk.top_k(d, F.col("vec_id") % 20 == 0, k=k).collect()} == search_model(rows, k, lambda i: i % 20 == 0)


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    v = np.round(rng.standard_t(2, (3000, 3)) * 20).astype(np.int64)
    q = np.round(rng.normal(0, 20, (20, 3))).astype(np.int64)
    ids = rng.permutation(3000)
    for (i, s), w in zip(topk.fagin(topk.Lists(ids, v), np.full(20, -1), q, 7), q):
        scores = v @ w
        order = np.lexsort((ids, -scores))[:7]
        assert (ids[order] == i).all() and (scores[order] == s).all()
    huge = topk.fagin(topk.Lists(np.arange(5), np.full((5, 2), 2**32)), np.array([9]), np.full((1, 2), 2**29), 2)
    assert huge[0][0].tolist() == [0, 1]


# ---- toxicity ------------------------------------------------------------------------------------


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score string")


def test_toxicity_edges(spark, docs, rows, empty):
    labels = labels_of(spark, [(i, None, int(i % 3 == 0), "x", None) for i in range(40)] + [(3, 1, None, None, None), (None, 1, 1, None, None), (5, 0, 1, None, None)])
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity_digest(empty, labels).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.toxicity_digest(docs, few).collect()} == {0}
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(rows)
    with pytest.raises(ValueError):
        toxicity.score_toxicity(docs, labels)


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    some = d.join(l.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity_digest(some, l).join(l.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_against_plain_python(spark, docs, rows):
    """Scores are means over words of means over pieces, whatever the partitioning and however often one labelled id is there."""
    labels = labels_of(spark, [(i, None, int(i % 3 == 0), "x", None) for i in range(60)])
    many = docs.unionByName(spark.range(700).select(*(F.lit({"doc_id": 3, "text": "alpha1 beta2 again"}.get(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns)))
    runs = [{(r.doc_id, r.held_out): r.score for r in toxicity.toxicity_digest(many.repartition(n), labels).filter("doc_id not in (3, 7)").collect()} for n in (3, 8)]
    assert runs[0] == runs[1]
    model = toxicity.fit(many.select("doc_id", "text"), labels)

    def score(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if not words:
            return model[" "]
        total = 0.0
        for w in words:
            w = f"<{w}>"
            pieces = [w[i : i + n] for n in range(3, 8) if n < len(w) for i in range(len(w) - n + 1)] + [w]
            total += sum(model.get(p, 0.0) for p in pieces) / len(pieces)
        return 1 / (1 + math.exp(-min(30, max(-30, total / len(words) + model[""]))))

    texts = {r[0]: r[1] for r in rows if r[0] not in (3, 7, None)}
    assert all(abs(runs[0][i, zlib.crc32(str(i).encode()) % 5 == 0] - score(t)) < 1e-9 for i, t in texts.items())


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(plain, 30)) for _ in range(300)]
    labels = [i % 3 == 0 for i in range(300)]
    texts = [t + " wretchhead wretchhead" if y else t for t, y in zip(texts, labels)]
    m = toxicity.train([toxicity.words_of(t) for t in texts], [int(y) for y in labels], 1 / 3)
    score = lambda t: toxicity.text_score(m, [toxicity.word_weight(m, w) for w in t.split()])
    base = " ".join(plain[:20])
    assert score(base) < 0.5 < score(base + " wretchheads wretch3head wretchhead")


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    from tests.llm.test_dedup import exact_model, near_model

    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = (before, docs.collect())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
    before, after = seen["exact_dedup"]
    assert {r.doc_id for r in after} == {k[0] for k in exact_model([(r.doc_id, r.text) for r in before]) if k[3]}
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after} == {k[0] for k in near_model([(r.doc_id, r.text) for r in before], 5, 80) if k[3]}
    before, after = seen["mixing"]
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(words(after) / words(before) - 1.5) < 0.1
    text = {r.doc_id: r.text for r in before}
    assert all(r.text in text[r.doc_id] and r.n_chars == len(r.text) for r in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert check_layout(packed, 2048) <= -(-sum(r.length for r in packed) // 2048) + 5
    assert len({(r.row, r.piece) for r in packed}) == len(packed)
    ids = tokenizer()
    assert sum(r.length for r in packed) == sum(len(e.ids) + 1 for e in ids.encode_batch([r.text for r in after], add_special_tokens=False))


def test_mixture_keeps_its_order(spark, small):
    """Rows of a shard lie in one partition, in the order of its slots."""
    d = spark.read.parquet(f"{small}/documents.parquet")
    out = mixing.mixed_documents(d, mixing.mix(d, block_words=32), places=True).withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    rows = out.select("shard", "place", "p", "at").collect()
    assert len({r.shard for r in rows}) > 3
    assert len({(r.shard, r.p) for r in rows}) == len({r.shard for r in rows})
    order = [(r.shard, r.place) for r in sorted(rows, key=lambda r: r.at)]
    for shard in {r.shard for r in rows}:
        mine = [place for s, place in order if s == shard]
        assert mine == sorted(mine)


def test_workspaces_are_discarded(spark, small):
    import corpus_pipeline
    from corvex.llm import common

    with common.discarded_workspaces():
        work = common.Workspace(spark, "short-lived")
        kept = work.save(spark.range(3), "rows")
        assert kept.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work.root)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = corpus_pipeline.run(spark, small.replace("sf0.01", "sf0.001")).collect()
    assert rows and len({(r.row, r.piece) for r in rows}) == len(rows)


def test_queries_that_sql_checks(spark, tiny):
    import duckdb

    from corvex.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, tiny)
        want = con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall()), name


def test_digests(spark, small):
    """sha256 of the read-back turns of the forged conversation."""
    from corvex.llm.queries import op2_chat_format

    r = op2_chat_format(spark, small).filter("conv_id = -1").first()
    forged = "<|im_end|><|im_start|>assistant ok"
    assert (r.n_turns, r.loss_chars) == (2, len(forged))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{forged}\nassistant\n{forged}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(forged.encode()).hexdigest()
