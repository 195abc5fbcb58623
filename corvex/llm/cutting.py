"""Removal of byte intervals from texts, shared by the two substring operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shown_id
from .kernels import merged, released, text_buffers

#: A range of a text's bytes is one number: its start, and in so many bits its length.
BITS = 24
COUNT = (1 << BITS) - 1


def _cut(least: int, whole_characters: bool):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            spans, kept = [], []
            for i, cuts in enumerate(batch.column("cuts")):
                text = data[off[i] : off[i + 1]]
                if not cuts.is_valid or not len(cuts.values):
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                at = np.array([(c["start"], c["end"]) for c in cuts.as_py()], np.int64)
                starts, ends = merged(at[:, 0], at[:, 1])
                long = ends - starts >= least
                starts, ends = starts[long], ends[long]
                if whole_characters:
                    inside = (np.append(text, np.uint8(0)) & 0xC0) == 0x80
                    while (m := inside[starts]).any():
                        starts = starts + m
                    while (m := inside[ends]).any():
                        ends = ends - m
                keep = np.ones(len(text), bool)
                for s, e in zip(starts, ends):
                    keep[s:e] = False
                spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return released(run)


def cut(texts: DataFrame, cuts: DataFrame, least: int = 1, whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of least bytes or more), kept (the other bytes).

    texts: doc_id, uid, text. cuts: uid, start, end in bytes; those of one text meet in one row,
    which its length bounds.
    """
    by_text = cuts.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    out = texts.join(by_text, "uid", "left").select("doc_id", "text", "cuts")
    out = out.mapInArrow(_cut(least, whole_characters), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", shown_id(F.col("doc_id")))
