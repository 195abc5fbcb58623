"""PDF scans, over files made from the documents: 400 words a page, and an image of a size that depends on the id."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import pdf as P
from ..sources.pdf import write_pdf
from .text_queries import sql_words


def _made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        for doc, text in zip(b.doc_id, b.text):
            words = (text or "").split()
            side = 8 + int(doc) % 80
            pixels = random.Random(int(doc)).randbytes(side * side * 3)
            yield f"doc-{doc}", write_pdf([" ".join(words[i : i + 400]) for i in range(0, max(1, len(words)), 400)], [(side, side, pixels)])


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return P.tables_of(_made(batches), ["path", "content"])


def files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(_write, "path string, content binary")


@query("s1_pdf_text", f"""
    SELECT 'doc-' || doc_id AS path, s // 400 + 1 AS page_number, md5(array_to_string(w[s + 1:s + 400], ' ')) AS content_md5, len(w[s + 1:s + 400]) AS word_count
    FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 400)) AS s FROM (SELECT doc_id, {sql_words("text")} AS w FROM documents) WHERE len(w) > 0)""")
def s1(spark, sf):
    c = P.pdf_chunks(files(spark, sf))
    return c.select("path", "page_number", F.md5("content").alias("content_md5"), F.col("word_count").cast("long").alias("word_count"))


@query("s2_pdf_images", """
    SELECT 'doc-' || doc_id AS path, 1::BIGINT AS page_number, 0 AS image_index, side AS width, side AS height, 'png' AS format, side * side AS n_pixels
    FROM (SELECT doc_id, (8 + doc_id % 80)::INTEGER AS side FROM documents) WHERE side >= 59""")
def s2(spark, sf):
    """Random pixels don't compress, so from 59 pixels a side an image has the 10 KB that are asked for. Tests hold the pixels."""
    return P.pdf_images(files(spark, sf)).select("path", "page_number", "image_index", "width", "height", "format", (F.col("width") * F.col("height")).alias("n_pixels"))
