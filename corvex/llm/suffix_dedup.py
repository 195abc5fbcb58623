"""Repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

Only the first `length` bytes of a suffix count, so the sort stops there, and the groups of equal
suffixes are exactly the repeated windows. Every pass splits groups by a further digit and drops
those of one member:

1. First digit: the window's anchor, the sub-string of `gram` bytes with the least hash in it. Equal
   windows have the same anchor at the same offset. Neighbouring windows with the same anchor go as
   one row, which makes some 3 rows for 100 bytes. This digit only groups; a collision splits later.
2. Second digit: all bytes that a row's windows cover, as a BLAKE2b digest of 128 bits. Within equal
   rows all but the first are repeats as a whole; the first goes on, unless its anchor is unique now.
3. What is left (rows that agree in part, at the edges of repeats) is sorted by its bytes, eight at
   a time. Anchors with more than `hot` such rows are first split into their windows, each with a
   hash of all its bytes for its group, and go through the same sort.

No digit makes a large group of what many documents share. An input task that meets a row, or a hot
anchor's window, again in a later document knows it for a repeat, and passes on runs of those, dealt
out at random. An anchor that a task meets with many different surroundings (a line that a third of
the documents hold) has its further rows dealt out by the second digit at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot, numbered_texts
from .cutting import BITS, COUNT, cut
from .kernels import Prefix, digest_columns, digests, joined_runs, mix64, released, signed, slices, sliding_min, spread, text_buffers

DIGIT = 8
#: Rows that an input task remembers to recognise repeats, before it starts afresh.
REMEMBERED = 100_000
#: Rows of an anchor in a task's counters that make it suspect of being common; the counters; rows between their resets.
SUSPECT, COUNTERS, COUNTED = 32, 1 << 20, 8_000_000
#: Kinds of rows: dealt out by their anchor, by their second digit, and known repeats.
BY_ANCHOR, BY_CONTEXT, REPEAT = 0, 1, 2


class Common:
    """Anchors that a task has met with many surroundings, and two of those surroundings for each.

    Rows of such an anchor are dealt out by their second digit once two different ones have been
    dealt out by the anchor, so that nobody takes the anchor for unique.
    """

    def __init__(self):
        self.counters, self.rows, self.met = np.zeros(COUNTERS, np.int32), 0, {}

    def kinds(self, anchors: np.ndarray, contexts: list[bytes]) -> np.ndarray:
        out = np.full(len(anchors), BY_ANCHOR, np.int8)
        if self.rows > COUNTED:
            self.counters[:], self.rows = 0, 0
        if len(self.met) > REMEMBERED:
            self.met = {}
        at = (anchors.view(np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64)
        self.counters += np.bincount(at, minlength=COUNTERS).astype(np.int32)
        self.rows += len(anchors)
        for i in np.flatnonzero(self.counters[at] >= SUSPECT).tolist():
            met = self.met.setdefault(int(anchors[i]), set())
            if contexts[i] in met:
                continue
            if len(met) == 2:
                out[i] = BY_CONTEXT
            else:
                met.add(contexts[i])
        return out


def dealt_at_random(uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    return signed(mix64(uid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)))


def known_repeats(known: dict[bytes, int], found: list[bytes], uid: np.ndarray) -> np.ndarray:
    """Which of the rows, in order of place, equal one of an earlier document, or an earlier one of the same."""
    out = np.zeros(len(found), bool)
    for i, (digest, u) in enumerate(zip(found, uid.tolist())):
        if known.get(digest, u + 1) <= u:
            out[i] = True
        else:
            known[digest] = u
    return out


def _anchors(length: int, gram: int):
    def out(kind, h, c1, c2, uid, packed):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, h, c1, c2, uid, packed)], names=["kind", "h", "c1", "c2", "uid", "packed"])

    width = length - gram + 1

    def run(batches):
        known, common = {}, Common()
        for batch in batches:
            batch = batch.sort_by("uid")
            all_data, offsets = text_buffers(batch.column("text"))
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                data, off = all_data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = len(data) - length + 1
                if n <= 0:
                    continue
                at = np.arange(len(data) - gram + 1)
                grams = Prefix(data).hash(at, at + gram)
                bits = np.uint64(max(20, len(data).bit_length()))
                keys = (grams >> bits << bits) | at.astype(np.uint64)
                anchor = (sliding_min(keys, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
                doc = np.repeat(np.arange(j - i), np.diff(off))[:n]
                inside = np.arange(n) + length <= off[doc + 1]
                new = inside.copy()
                new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
                last = inside.copy()
                last[:-1] &= new[1:] | ~inside[1:]
                first, last = np.flatnonzero(new), np.flatnonzero(last)
                if not len(first):
                    continue
                d = doc[first]
                n, at, uid = last - first + 1, first - off[d], uids[i:j][d]
                h, found = signed(grams[anchor[first]]), digests(data.tobytes(), first, last + length)
                if len(known) > REMEMBERED:
                    known = {}
                again = known_repeats(known, found, uid)
                go = np.flatnonzero(~again)
                kind = np.full(len(h), REPEAT, np.int8)
                kind[go] = common.kinds(h[go], [found[g] for g in go.tolist()])
                c1, c2 = digest_columns(found)
                yield out(kind[go], h[go], c1[go], c2[go], uid[go], (at << BITS | n)[go])
                if again.any():
                    d, at, n = joined_runs(d[again], at[again], n[again], COUNT)
                    uid, zero = uids[i:j][d], np.zeros(len(d), np.int64)
                    yield out(np.full(len(d), REPEAT, np.int8), zero, dealt_at_random(uid, at), zero, uid, at << BITS | n)

    return released(run)


def _second_digit():
    """Rows come ordered by kind, anchor, context, document and place. whole: repeats of the first of their kind."""

    def out(whole, h, uid, packed):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), whole)), pa.array(h), pa.array(uid), pa.array(packed)], names=["whole", "h", "uid", "packed"])

    def run(batches):
        last = held = None  # the last row's digits; the last first-of-its-kind, and whether it shares its anchor
        for batch in batches:
            kind, h, c1, c2, uid, packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "h", "c1", "c2", "uid", "packed"))
            done = kind == REPEAT
            if done.any():
                yield out(True, h[done], uid[done], packed[done])
                kind, h, c1, c2, uid, packed = (c[~done] for c in (kind, h, c1, c2, uid, packed))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
            if last is not None:
                new[0] = (kind[0], h[0], c1[0], c2[0]) != last
            last = (kind[-1], h[-1], c1[-1], c2[-1])
            if not new.all():
                yield out(True, h[~new], uid[~new], packed[~new])
            common = new & (kind == BY_CONTEXT)
            if common.any():
                yield out(False, h[common], uid[common], packed[common])
            alone = new & (kind == BY_ANCHOR)
            h, uid, packed = h[alone], uid[alone], packed[alone]
            if not len(h):
                continue
            shared = np.zeros(len(h), bool)
            same = h[1:] == h[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            if held is not None:
                if held[0] == h[0]:
                    shared[0] = held[3] = True
                if held[3]:
                    yield out(False, *(np.array([x], np.int64) for x in held[:3]))
            held = [h[-1], uid[-1], packed[-1], shared[-1]]
            shared[-1] = False
            if shared.any():
                yield out(False, h[shared], uid[shared], packed[shared])
        if held is not None and held[3]:
            yield out(False, *(np.array([x], np.int64) for x in held[:3]))

    return released(run)


def _contexts(length: int):
    """Bytes of the rows' windows; for hot anchors, a row of its own for each window, unless it is a known repeat."""
    schema = pa.schema([("again", pa.bool_()), ("h", pa.int64()), ("uid", pa.int64()), ("packed", pa.int64()), ("body", pa.binary())])

    def out(again, h, uid, packed, bodies):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), again)), pa.array(h), pa.array(uid), pa.array(packed), bodies], schema=schema)

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            batch = batch.sort_by("uid")
            data, off = text_buffers(batch.column("text"))
            rows = batch.column("rows")
            parts, counts = rows.flatten(), np.diff(rows.offsets.to_numpy())
            h, packed, large = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("h", "packed", "large"))
            doc = np.repeat(np.arange(len(rows)), counts)
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            at, n = packed >> BITS, packed & COUNT
            few = np.flatnonzero(~large)
            for lo in range(0, len(few), 20_000):
                i = few[lo : lo + 20_000]
                start = off[doc[i]] + at[i]
                bodies = [data[s:e].tobytes() for s, e in zip(start.tolist(), (start + n[i] + length - 1).tolist())]
                yield out(False, h[i], uids[doc[i]], packed[i], pa.array(bodies, pa.binary()))
            many = np.flatnonzero(large)
            many = many[np.lexsort((at[many], doc[many]))]
            for lo in range(0, len(many), 2000):
                if len(known) > REMEMBERED:
                    known = {}
                i = many[lo : lo + 2000]
                place, row = spread(at[i], n[i])
                d = doc[i][row]
                start = off[d] + place
                bodies = [data[s : s + length].tobytes() for s in start.tolist()]
                found = digests(b"".join(bodies), np.arange(len(bodies)) * length, np.arange(1, len(bodies) + 1) * length)
                again = known_repeats(known, found, uids[d])
                group, _ = digest_columns(found)
                yield out(False, group[~again], uids[d][~again], (place << BITS | 1)[~again], pa.array([b for b, a in zip(bodies, again.tolist()) if not a], pa.binary()))
                if again.any():
                    d, place, run_of = joined_runs(d[again], place[again], np.ones(again.sum(), np.int64), COUNT)
                    yield out(True, np.zeros(len(d), np.int64), uids[d], place << BITS | run_of, pa.nulls(len(d), pa.binary()))

    return released(run)


def radix_groups(windows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal another one of their group, and numbers of the groups of equal ones.

    windows: a row of bytes each. Most significant digit first; after each digit, groups of one go.
    """
    live = np.arange(len(windows))
    for at in range(0, windows.shape[1] + DIGIT, DIGIT):  # the pass before the first digit drops groups of one
        if at:
            piece = np.zeros((len(live), DIGIT), np.uint8)
            part = windows[live, at - DIGIT : at]
            piece[:, : part.shape[1]] = part
            digit = piece.view(np.uint64).ravel()
            order = np.lexsort((digit, group))
            live, group, digit = live[order], group[order], digit[order]
            new = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            order = np.argsort(group, kind="stable")
            live, group = live[order], group[order]
            new = group[1:] != group[:-1]
        number = np.concatenate([[0], np.cumsum(new)])[: len(live)]
        many = np.bincount(number, minlength=1)[number] > 1 if len(live) else np.zeros(0, bool)
        live, group = live[many], number[many]
        if not len(live):
            break
    return live, group


def _radix(length: int, gram: int):
    """Rows come ordered by anchor; the groups of an anchor are sorted by their bytes."""

    def solve(h, uid, packed, bodies):
        at, n = packed >> BITS, packed & COUNT
        flat = np.frombuffer(b"".join(bodies), np.uint8)
        base = np.concatenate([[0], np.cumsum(n + length - 1)])[:-1]
        repeat_uid, repeat_start = [], []
        keys = np.unique(h, return_inverse=True)[1]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        bounds, size = [0], 0
        for c, e in zip(cuts, np.append(cuts[1:], len(keys))):  # whole anchors, some 40,000 windows at a time
            if size > 40_000:
                bounds.append(c)
                size = 0
            size += int(n[c:e].sum())
        for lo, hi in zip(bounds, [*bounds[1:], len(keys)]):
            start, row = spread(base[lo:hi], n[lo:hi])
            row = row + lo
            windows = np.lib.stride_tricks.sliding_window_view(flat, length)[start]
            live, group = radix_groups(windows, keys[row])
            place = (at[row] + start - base[row])[live]
            who = uid[row][live]
            order = np.lexsort((place, who, group))
            again = np.zeros(len(order), bool)
            again[1:] = group[order][1:] == group[order][:-1]
            repeat_uid.append(who[order][again])
            repeat_start.append(place[order][again])
        u, s = np.concatenate(repeat_uid), np.concatenate(repeat_start)
        order = np.lexsort((s, u))
        u, s = u[order], s[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (s[1:] - s[:-1] > length)
        end = np.concatenate([new[1:], [True]]) if len(u) else new
        return pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(s[new]), pa.array(s[end] + length)], names=["uid", "start", "end"])

    def run(batches):
        held = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "uid", "packed")] + [batch.column("body").to_pylist()]
            if not batch.num_rows:
                continue
            if held is not None:
                part = [np.concatenate([a, b]) for a, b in zip(held[:3], part[:3])] + [held[3] + part[3]]
            done = int(np.searchsorted(part[0], part[0][-1]))
            held = [c[done:] for c in part]
            if done:
                yield solve(*(c[:done] for c in part))
        if held is not None:
            yield solve(*held)

    return released(run)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, hot: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans, kept (binary).

    Removes each byte covered by a string of `length` bytes that also starts earlier: in a document
    of smaller id, or in the same one before. Judged on the input; matches lie within one document.
    Null text counts as empty; texts shorter than `length` stay whole. A null id sorts before all
    others. Rows of the same id and text are one document and get the same result; different texts
    of one id are ordered by their SHA-256. Other columns of docs, whatever their names, are not
    read. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "suffix")
    texts, once = numbered_texts(docs, id_col, text_col, work)
    anchors = once.mapInArrow(_anchors(length, gram), "kind byte, h long, c1 long, c2 long, uid long, packed long")
    owner = F.when(F.col("kind") == BY_ANCHOR, F.col("h")).otherwise(F.col("c1"))
    sorted_rows = anchors.repartition(owner).sortWithinPartitions("kind", "h", "c1", "c2", "uid", "packed")
    rows = work.save(sorted_rows.mapInArrow(_second_digit(), "whole boolean, h long, uid long, packed long"), "second_digit")

    start, n = F.shiftright("packed", BITS), F.col("packed").bitwiseAND(COUNT)
    as_cuts = lambda df: df.select("uid", start.alias("start"), (start + n + length - 1).alias("end"))
    rest = rows.filter("not whole").select("h", "uid", "packed")
    large = work.save(rest.groupBy("h").agg(F.count("*").alias("rows"), F.lit(True).alias("large")).filter(F.col("rows") > hot), "hot")
    marked = join_hot(rest, large, ["h"], "left", counted="rows").withColumn("large", F.coalesce("large", F.lit(False)))
    per_text = marked.groupBy("uid").agg(F.collect_list(F.struct("h", "packed", "large")).alias("rows"))
    contexts = once.join(per_text, "uid").select("uid", "text", "rows").mapInArrow(_contexts(length), "again boolean, h long, uid long, packed long, body binary")
    contexts = work.save(contexts, "contexts")
    bodies = contexts.filter("not again").select("h", "uid", "packed", "body").repartition("h").sortWithinPartitions("h")
    cuts = as_cuts(rows.filter("whole")).unionByName(as_cuts(contexts.filter("again")))
    return cut(texts, cuts.unionByName(bodies.mapInArrow(_radix(length, gram), "uid long, start long, end long")))
