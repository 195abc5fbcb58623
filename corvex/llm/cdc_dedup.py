"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: each step shifts the hash left by one bit and adds a
value for the byte, so bits 16 to 19 depend on the last 20 bytes alone. Where they are all zero a
chunk ends, unless it would be shorter than `least_chunk`; the cut points move along with the text
when something is inserted before them. Chunks are repeats when their digest (BLAKE2b, 128 bits)
occurs in a document of smaller id, or earlier in the same one. Runs of adjacent repeats of
`least_run` bytes or more are removed; shorter ones, common phrases and lines, stay.

Texts are cut once. An input task that meets a digest again in a later document knows it for a
repeat, and passes on runs of those, dealt out at random; so a chunk that a third of the documents
share reaches its digest's owner as few rows from each task. Owners see the others in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, numbered_texts
from .cutting import BITS, COUNT, cut
from .kernels import digest_columns, digests, joined_runs, mix64, random64, released, signed, slices, text_buffers

#: Digests that an input task remembers to recognise repeats, before it starts afresh.
REMEMBERED = 250_000
#: The lowest of the hash's bits that end a chunk.
LOW_BIT = 16


def gear_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte, from zero at the start of each document.

    Sums over 2, 4, ... 32 bytes by doubling; older bytes have left the 32 bits.
    """
    h = (random64(256, 21) >> np.uint64(32)).astype(np.uint32)[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            older = np.where(place[step:] >= step, h[:-step] << np.uint32(step), np.uint32(0))
            h = h.copy()
            h[step:] += older
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, longest: int) -> list[int]:
    """Ends of chunks in order; every document's end is one, if it has bytes."""
    mask = np.uint32(((1 << bits) - 1) << LOW_BIT)
    edge = (gear_hash(data, offsets) & mask) == 0
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = edge
    ends_here = offsets[1:][np.diff(offsets) > 0]
    stops[ends_here] = True
    final = set(ends_here.tolist())
    out, last = [], 0
    for e in np.flatnonzero(stops).tolist():
        while e - last > longest:
            last += longest
            out.append(last)
        if e - last >= least or e in final:
            out.append(e)
            last = e
    return out


def _chunks(bits: int, least: int, longest: int):
    def out(whole, d1, d2, uid, packed):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(d1), whole), d1, d2, uid, packed)], names=["whole", "d1", "d2", "uid", "packed"])

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            batch = batch.sort_by("uid")
            all_data, offsets = text_buffers(batch.column("text"))
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                data, off = all_data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not len(data):
                    continue
                end = np.array(chunk_ends(data, off, bits, least, longest), np.int64)
                start = np.concatenate([[0], end[:-1]])
                doc = np.searchsorted(off, start, "right") - 1
                found, uid = digests(data.tobytes(), start, end), uids[i:j][doc]
                if len(known) > REMEMBERED:
                    known = {}
                again = np.zeros(len(found), bool)
                for row, (digest, u) in enumerate(zip(found, uid.tolist())):
                    if known.get(digest, u + 1) <= u:
                        again[row] = True
                    else:
                        known[digest] = u
                d1, d2 = digest_columns(found)
                at, n = start - off[doc], end - start
                yield out(False, d1[~again], d2[~again], uid[~again], (at << BITS | n)[~again])
                if again.any():
                    d, at, n = joined_runs(doc[again], at[again], n[again], COUNT)
                    uid = uids[i:j][d]
                    dealt = signed(mix64(uid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)))
                    yield out(True, dealt, np.zeros(len(at), np.int64), uid, at << BITS | n)

    return released(run)


def _again():
    """Rows come ordered by digest, document and place; all but the first of a digest are repeats."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, d1, d2, uid, packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "d1", "d2", "uid", "packed"))
            new = np.ones(len(d1), bool)
            new[1:] = (whole[1:] != whole[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            if last is not None:
                new[0] = (whole[0], d1[0], d2[0]) != last
            last = (whole[-1], d1[-1], d2[-1])
            pick = whole | ~new
            start = packed[pick] >> BITS
            yield pa.RecordBatch.from_arrays([pa.array(uid[pick]), pa.array(start), pa.array(start + (packed[pick] & COUNT))], names=["uid", "start", "end"])

    return released(run)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, least_chunk: int = 16, longest_chunk: int = 1024, least_run: int = 128) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans, kept (binary, valid UTF-8).

    spans are the removed runs, drawn in to whole characters. A run loses up to a chunk at either end
    of a repeated passage, so one of 50 words or more has least_run bytes left of it. Chunks are some least_chunk + 2**bits
    bytes long. Null text counts as empty. A null id sorts before all others. Rows of the same id
    and text are one document and get the same result; different texts of one id are ordered by
    their SHA-256. Other columns of docs, whatever their names, are not read. An empty table gives
    an empty result.
    """
    if longest_chunk > COUNT:
        raise ValueError(f"longest_chunk is {COUNT} at most")
    work = Workspace(docs.sparkSession, "chunks")
    texts, once = numbered_texts(docs, id_col, text_col, work)
    chunks = once.mapInArrow(_chunks(bits, least_chunk, longest_chunk), "whole boolean, d1 long, d2 long, uid long, packed long")
    owned = chunks.repartition("d1").sortWithinPartitions("whole", "d1", "d2", "uid", "packed")
    repeats = work.save(owned.mapInArrow(_again(), "uid long, start long, end long"), "repeats")
    return cut(texts, repeats, least_run, whole_characters=True)
