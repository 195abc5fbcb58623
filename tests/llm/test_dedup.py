"""The four duplicate operators against brute force, on edge cases and on the small tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvex.llm import exact_dedup, kernels
from corvex.llm.cdc_dedup import chunk_ends, repeated_chunks
from corvex.llm.exact_dedup import Directory, exact_duplicates, without_exact_duplicates
from corvex.llm.minhash_dedup import near_duplicates, without_near_duplicates
from corvex.llm.suffix_dedup import radix_groups, repeated_windows

NONE = -(2**63)


def pairs(rows):
    return [(NONE if r[0] is None else r[0], r[1] or "") for r in rows]


def small_rows(spark, path):
    d = spark.read.parquet(f"{path}/documents.parquet")
    return d, [(r.doc_id, r.text) for r in d.collect()]


def exact_model(rows):
    groups = defaultdict(list)
    for i, t in pairs(rows):
        groups[t.encode().translate(exact_dedup.LOWERED)].append(i)
    out = Counter()
    for t, ids in groups.items():
        top, left = max(ids), True
        for i in ids:
            kept = i == top and left
            left &= not kept
            out[(None if i == NONE else i, None if top == NONE else top, len(ids), kept, hashlib.sha256(t).hexdigest())] += 1
    return out


def test_exact_edges(docs, rows):
    assert Counter(map(tuple, exact_duplicates(docs, capacity=4).collect())) == exact_model(rows)


def test_exact_small_table(spark, small):
    d, rows = small_rows(spark, small)
    assert Counter(map(tuple, exact_duplicates(d, capacity=50).collect())) == exact_model(rows)


def test_exact_below_the_driver_directory(docs, rows):
    """Buckets that are overfull at the directory's last bit are split further on."""
    assert Counter(map(tuple, exact_duplicates(docs, capacity=2, max_depth=2).collect())) == exact_model(rows)
    d = Directory.over(np.array([1000, 3, 0, 5]), 10)
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 4000)
    lead = (keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(62)
    parts = d.bucket(keys)
    assert len(set(parts[lead == 0])) > 100 and all(len(set(parts[lead == i])) == 1 for i in (1, 2, 3))
    order = np.lexsort((keys,))
    in_order = parts[order][lead[order] == 0] >> 32
    assert (np.diff(in_order) >= 0).all()


def test_exact_kept_rows_keep_clashing_columns(spark):
    rows = [(7, "a", "id1", "sha1"), (7, "b", "id2", "sha2"), (8, "A", "id3", "sha3"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id string, __sha string")
    assert {tuple(r) for r in without_exact_duplicates(d).collect()} == set(rows[1:])


def test_exact_empty(empty):
    assert exact_duplicates(empty).count() == 0


def test_exact_kept_rows(docs, rows):
    kept = without_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({t.encode().translate(exact_dedup.LOWERED) for _, t in pairs(rows)})


def test_owner_chains_colliding_keys():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array([9] * 4, pa.int64()), pa.array([b"x", b"y", b"x", b"z"]), pa.array([b"1", b"2", b"1", b"3"]), pa.array([1, 2, 3, 4]), pa.array([1, 1, 5, 1])], names=["bucket", "h", "text", "sha", "top", "n"])
    out = [tuple(r.values()) for b in exact_dedup._own()([batch.slice(0, 2), batch.slice(2, 2)]) for r in b.to_pylist()]
    assert out == [(0, 9, 0, b"1", 3, 6), (0, 9, 1, b"2", 2, 1), (0, 9, 2, b"3", 4, 1)]


def test_directory_doubles_where_it_must():
    counts = np.zeros(64, np.int64)
    counts[:4] = 10
    d = Directory.over(counts, 10)
    assert d.depth == 6 and len(d.slots) == 64
    for b in range(len(d.local)):
        assert (d.slots == b).sum() == 2 ** (d.depth - d.local[b])
        assert counts[d.slots == b].sum() <= 10
    assert Directory.over(np.array([1000]), 10).depth == 0


def near_model(rows, k, percent):
    sets = {}
    for i, t in pairs(rows):
        w = t.encode().translate(exact_dedup.LOWERED)
        w = [x for x in __import__("re").split(rb"[\x20\x09-\x0D]+", w) if x]
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[(i, t)] = s
    keys = sorted(sets)
    root = {s: s for s in set(sets.values())}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    some = [s for s in root if s]
    for a in range(len(some)):
        for b in range(a):
            both = len(some[a] & some[b])
            if 100 * both >= percent * len(some[a] | some[b]):
                root[find(some[a])] = find(some[b])
    least = defaultdict(lambda: 2**63)
    for i, t in keys:
        least[find(sets[(i, t)])] = min(least[find(sets[(i, t)])], i)
    out = Counter()
    for i, t in pairs(rows):
        c = least[find(sets[(i, t)])] if sets[(i, t)] else i
        out[(None if i == NONE else i, len(sets[(i, t)]), None if c == NONE else c, i == c)] += 1
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_edges(docs, rows, k):
    assert Counter(map(tuple, near_duplicates(docs, k=k).collect())) == near_model(rows, k, 80)


def test_near_small_table(spark, tiny):
    d, rows = small_rows(spark, tiny)
    assert Counter(map(tuple, near_duplicates(d, k=4).collect())) == near_model(rows, 4, 80)


def test_near_chain_across_components(spark):
    """Versions that drift apart: neighbours are similar, ends are not, and no hub is linked to all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_duplicates(d, k=4).collect())) == near_model(rows, 4, 80)


def thue_morse(a, b, n=1024):
    """A text and its complement, which collide under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.fixture(scope="session")
def colliding(spark):
    one, two = thue_morse("b", "w")
    rows = [(1, one), (2, two), (3, "before " + one + " after it"), (4, "before " + two + " after it"), (5, one)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_colliding_texts_are_told_apart(colliding):
    d, rows = colliding
    assert Counter(map(tuple, near_duplicates(d, k=4).collect())) == near_model(rows, 4, 80)
    spans = lambda df: Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in df.collect())
    assert spans(repeated_chunks(d)) == chunks_model(rows)
    for hot in (1000, 1):
        assert spans(repeated_windows(d, hot=hot)) == windows_model(rows, 100)
    assert {r.doc_id: r.keep_id for r in exact_duplicates(d).collect()} == {1: 5, 2: 2, 3: 3, 4: 4, 5: 5}


def test_near_hot_bucket_of_many_versions(spark, monkeypatch):
    """Buckets and exact copies beyond what a plain join takes; versions that don't all link, so blocks are compared."""
    from corvex.llm import common, minhash_dedup

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(120)] + [(200 + i, " ".join(words[:60])) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, near_duplicates(d, k=4).collect())) == near_model(rows, 4, 80)
    assert Counter(map(tuple, exact_duplicates(d, capacity=4).collect())) == exact_model(rows)


def test_near_wide_bucket_is_grouped_by_rare_shingles(spark, monkeypatch):
    """Texts with most of their words in common share buckets without being near; what is sent stays in proportion to them."""
    from corvex.llm import common, minhash_dedup

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "WIDE", 2)
    shared = " ".join(f"s{i}" for i in range(120))
    own = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    rows = [(i, f"{shared} {own(i, 45)}") for i in range(240)]
    # Drifting versions within the same buckets: only neighbours are near.
    rows += [(1000 + i, f"{shared} " + " ".join(f"d{j}" for j in range(i * 9, i * 9 + 45))) for i in range(40)]
    sent, links = [], minhash_dedup._links_across

    def noted(named, keys, *rest):
        sent.append((named.filter("band < 0").count(), keys.selectExpr("coalesce(sum(size * blocks), 0)").first()[0]))
        return links(named, keys, *rest)

    monkeypatch.setattr(minhash_dedup, "_links_across", noted)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, near_duplicates(d, k=4).collect())) == near_model(rows, 4, 80)
    rare, compared = sent[1]
    assert 0 < rare <= 280 * 40 and compared <= 40 * 40 * 4  # the 240 others are in no group


def test_near_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_near_kept_rows(spark, tiny):
    d, rows = small_rows(spark, tiny)
    kept = {r.doc_id for r in without_near_duplicates(d).collect()}
    assert kept == {k[0] for k in near_model(rows, 5, 80) if k[3]}


@pytest.fixture(scope="session")
def shared_ids(spark):
    """Different texts under one id (null, 7), each with a near copy under an id of its own or the same."""
    rows = []
    for i in range(12):
        t = " ".join(f"t{i}w{j}" for j in range(60))
        rows += [(None if i % 3 else 7, t, i), (100 + i if i % 2 else None, t + " tail", 50 + i)]
    rows += [(None, "alone in its words", 90), (7, "also alone in these words", 91), (None, "", 92), (None, None, 93)]
    rows += [rows[0], rows[2], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(5), rows


def test_near_texts_that_share_an_id(shared_ids):
    d, rows = shared_ids
    assert Counter(map(tuple, near_duplicates(d, k=4).collect())) == near_model(rows, 4, 80)


def test_near_kept_rows_where_ids_repeat(shared_ids):
    d, rows = shared_ids
    kept = without_near_duplicates(d)
    assert kept.columns == d.columns
    got = sorted((NONE if r.doc_id is None else r.doc_id, (r.text or "").removesuffix(" tail")) for r in kept.collect())
    groups = defaultdict(list)
    for i, t in pairs([r for r in rows if r[1]]):
        groups[t.removesuffix(" tail")].append(i)
    assert got == sorted([(min(ids), t) for t, ids in groups.items()] + [(NONE, "")] * 2)


def test_min_max_is_unbiased():
    a, b = kernels.random64(1000, 1), kernels.random64(1200, 1)[200:]
    s = kernels.min_max(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06


def windows_model(rows, length):
    texts = sorted(set(pairs(rows)), key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in texts:
        b = t.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        spans, at = [], None
        for j, c in enumerate([*cover, 0]):
            if c and at is None:
                at = j
            if not c and at is not None:
                spans.append((at, j))
                at = None
        out[(i, t)] = (len(b), tuple(spans), bytes(x for x, c in zip(b, cover) if not c))
    return Counter((None if i == NONE else i, *out[(i, t)]) for i, t in pairs(rows))


@pytest.mark.parametrize("hot", [1000, 2])
def test_windows_edges(docs, rows, hot):
    got = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in repeated_windows(docs, length=100, hot=hot).collect())
    assert got == windows_model(rows, 100)


def test_windows_short_length(docs, rows):
    got = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in repeated_windows(docs, length=40, gram=16).collect())
    assert got == windows_model(rows, 40)


def test_windows_of_a_common_line(spark, monkeypatch):
    """A line in every document amid texts of its own, met often enough by tasks to be dealt out by its surroundings."""
    import random

    from corvex.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SUSPECT", 3)
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", 50)
    rng = random.Random(8)
    line = " ".join(rng.choice(["lorem", "ipsum", "dolor"]) + str(rng.randrange(99)) for _ in range(30))
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [(i, own(150) + (line if i % 3 else "") + own(120) + rng.choice(["", line[:130]])) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (1000, 10):
        got = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in repeated_windows(d, hot=hot).collect())
        assert got == windows_model(rows, 100)


def test_runs_are_no_longer_than_a_row_can_say():
    doc, at, n = kernels.joined_runs(np.array([0, 0, 0, 1]), np.array([5, 8, 20, 21]), np.array([3, 4, 1, 9]), 5)
    assert list(zip(doc.tolist(), at.tolist(), n.tolist())) == [(0, 5, 5), (0, 10, 2), (0, 20, 1), (1, 21, 5), (1, 26, 4)]


def test_windows_empty(empty):
    assert repeated_windows(empty).count() == 0


def test_radix_groups_are_equal_windows():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2, (300, 11)).astype(np.uint8)
    group = rng.integers(0, 3, 300)
    live, number = radix_groups(w, group)
    got = defaultdict(set)
    for i, g in zip(live.tolist(), number.tolist()):
        got[g].add(i)
    want = defaultdict(set)
    for i in range(300):
        want[(group[i], w[i].tobytes())].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def chunks_model(rows, bits=4, least=16, longest=1024, least_run=128):
    texts = sorted(set(pairs(rows)), key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    table = [int(x) for x in (kernels.random64(256, 21) >> np.uint64(32)).astype(np.uint32)]
    seen, out = set(), {}
    for i, t in texts:
        b, ends, last, h = t.encode(), [], 0, 0
        for j, c in enumerate(b):
            h = ((h << 1) + table[c]) & 0xFFFFFFFF
            stop = not h >> 16 & ((1 << bits) - 1) or j + 1 == len(b)
            if stop:
                while j + 1 - last > longest:
                    last += longest
                    ends.append(last)
                if j + 1 - last >= least or j + 1 == len(b):
                    ends.append(j + 1)
                    last = j + 1
        runs, mine = [], []
        for s, e in zip([0, *ends], ends):
            if b[s:e] in seen:
                if runs and runs[-1][1] == s:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
            mine.append(b[s:e])
            seen.add(b[s:e])
        kept, spans, at = b"", [], 0
        for s, e in runs:
            if e - s < least_run:
                continue
            while s < len(b) and b[s] & 0xC0 == 0x80:
                s += 1
            while e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            spans.append((s, e))
            kept, at = kept + b[at:s], e
        out[(i, t)] = (len(b), tuple(spans), kept + b[at:])
    return Counter((None if i == NONE else i, *out[(i, t)]) for i, t in pairs(rows))


def test_chunks_edges(docs, rows):
    got = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in repeated_chunks(docs).collect())
    assert got == chunks_model(rows)


def test_chunks_small_table(spark, small):
    d, rows = small_rows(spark, small)
    got = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in repeated_chunks(d).collect())
    assert got == chunks_model(rows)


def test_chunks_find_passages_and_leave_clean_texts(spark):
    """Passages of 50 words and more against the repeats that the exact operator finds; texts without a long repeat stay whole."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    exact = {r.doc_id: max((s.end - s.start for s in r.spans), default=0) for r in repeated_windows(d).select("doc_id", "spans").collect()}
    cut = {r.doc_id: len(r.spans) for r in repeated_chunks(d).select("doc_id", "spans").collect()}
    planted, clean = [i for i, n in exact.items() if n >= 300], [i for i, n in exact.items() if n < 200]
    assert sum(cut[i] > 0 for i in planted) >= 0.97 * len(planted)
    assert sum(cut[i] == 0 for i in clean) >= 0.99 * len(clean)


def test_chunks_resist_insertions():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 4000).astype(np.uint8)
    a = chunk_ends(text, np.array([0, 4000]), 4, 16, 1024)
    moved = np.concatenate([text[:100], np.frombuffer(b"inserted", np.uint8), text[100:]])
    b = chunk_ends(moved, np.array([0, 4008]), 4, 16, 1024)
    assert len({x + 8 for x in a if x > 300} & set(b)) > 0.95 * sum(x > 300 for x in a)


def test_chunks_empty(empty):
    assert repeated_chunks(empty).count() == 0
