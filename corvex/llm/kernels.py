"""Numpy kernels over Arrow buffers: byte strings, words, shingles and their hashes.

Two kinds of hashes. Those that decide whether things are equal are BLAKE2b digests: of words, of
chunks, of the bytes around an anchor. Those of Prefix come from sums of a polynomial modulo 2**64
over randomised byte values, so any range costs two look-ups; such a hash may only group or order
what is compared afterwards, as texts can be made that collide under it.
"""

from __future__ import annotations

import ctypes
import re
import sys
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one kernel call; a longer document is a call of its own.
SLICE = 1 << 20


def cached(key, make):
    """What make() returned first in this Python worker."""
    store = sys.__dict__.setdefault("_corvex_llm_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def released(run):
    """A function of Arrow batches that gives freed memory back at its end, as workers live on for other stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return whole


def mix64(x):
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int):
    """n fixed pseudorandom 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of documents of at most limit bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def _powers(n: int):
    store = sys.__dict__.setdefault("_corvex_llm_cache", {})
    have = store.get("powers")
    if have is None or len(have[0]) < n:
        base = 0x5851F42D4C957F2D
        size = max(n, SLICE + 1)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        store["powers"] = have = tuple(out)
    return have


class Prefix:
    """Hashes of ranges of one byte string."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self.down = _powers(len(data) + 1)
        table = random64(256, seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64(x)


def byte_classes():
    lower, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    space[[9, 10, 11, 12, 13, 32]] = True
    return lower, space


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each document's place among them."""
    _, space = byte_classes()
    is_space = space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = is_space[:-1], is_space[1:]
    start = np.flatnonzero(~is_space & (before | edge[:-1]))
    end = np.flatnonzero(~is_space & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Distinct words that a worker remembers the numbers of, before it starts afresh; bytes of text cut into words at once.
REMEMBERED, PIECE = 150_000, 4 << 20


class WordNumbers(dict):
    """The first 64 bits of a word's BLAKE2b digest, by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


def word_numbers(raw: bytes, known: WordNumbers) -> np.ndarray:
    """Numbers of the words [^\\x20\\x09-\\x0D]+ of a text in order."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        gap = GAP.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = gap.end() if gap else len(raw)
        found = raw[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
        at = end
    return np.concatenate(out)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Hashes of the k-word shingles in order, and each document's place among them.

    ASCII capitals count as small letters. A document of 1 to k-1 words has its whole sequence as
    its one shingle; one without words has none. Words have strong hashes, which are mixed one after
    another, so no two sequences collide but by chance.
    """
    known = cached("word numbers", WordNumbers)
    raw = data.tobytes().translate(LOWERED)
    texts = [word_numbers(raw[s:e], known) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    counts = np.array([len(t) for t in texts], np.int64)
    place = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n = int(place[-1])
    h = np.zeros(n + k, np.uint64)
    if n:
        np.concatenate(texts, out=h[:n])
    left = np.repeat(place[1:], counts) - np.arange(n)
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = mix64(x + np.where(left > j, h[j : n + j], np.uint64(j + 1)))
    whole = np.zeros(n, bool)
    whole[place[:-1][counts > 0]] = True
    x = x[(left >= k) | whole]
    sizes = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    return x, np.concatenate([[0], np.cumsum(sizes)])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def min_max(x: np.ndarray, places: np.ndarray, n_hashes: int) -> np.ndarray:
    """Per document, the minimum and the maximum under each of n_hashes permutations, interleaved."""
    full = np.diff(places) > 0
    out = np.zeros((len(full), 2 * n_hashes), np.uint32)
    if full.any():
        at = places[:-1][full]
        for p, (a, b) in enumerate(zip(random64(n_hashes, 5) | np.uint64(1), random64(n_hashes, 6))):
            v = ((x * a + b) >> np.uint64(32)).astype(np.uint32)
            out[full, 2 * p] = np.minimum.reduceat(v, at)
            out[full, 2 * p + 1] = np.maximum.reduceat(v, at)
    return out


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column from the rows of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width values: prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row i, the numbers starts[i], starts[i] + 1, ... (counts[i] of them); and the rows they are of."""
    row = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(len(row)) - before[row] + starts[row], row


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """BLAKE2b digests, of 128 bits, of ranges of raw."""
    return [blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())]


def digest_columns(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two columns of signed 64-bit numbers."""
    both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def joined_runs(doc: np.ndarray, at: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining ranges (in order, n long from at) of one document as one, none longer than most: doc, at, n."""
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
    start = np.flatnonzero(new)
    doc, at, n = doc[start], at[start], np.add.reduceat(n, start) if len(n) else n
    part, row = spread(np.zeros(len(n), np.int64), -(-n // most))
    return doc[row], at[row] + part * most, np.minimum(n[row] - part * most, most)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs; runs that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([new[1:], [True]])]
