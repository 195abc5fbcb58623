"""Models behind the retrieval plan, each with a deterministic offline default.

A plugin is a function on columns or texts; another model is another function of the same shape.
"""

from __future__ import annotations

from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import WS, strip, widest_array

DIMS = 256


class Embedder(Protocol):
    """Token lists to rows of vectors."""

    dims: int

    def __call__(self, tokens: list[list[str]]) -> np.ndarray: ...


class HashingEmbedder:
    """Token counts by the first 16 bits of the token's MD5, modulo the dimensions; no tokens: the zero vector."""

    dims = DIMS

    def __call__(self, tokens):
        out, known = np.zeros((len(tokens), self.dims)), {}
        for i, row in enumerate(tokens):
            for t in row:
                if t not in known:
                    known[t] = int.from_bytes(md5(t.encode()).digest()[:2], "big") % self.dims
                out[i, known[t]] += 1
        return out

    def of_lists(self, tokens: pa.ListArray, known: dict[str, int]) -> np.ndarray:
        """The same vectors of an Arrow array of token lists. known: places of tokens, which is added to and emptied at 100,000."""
        words, place = tokens.flatten().dictionary_encode(), []
        for t in words.dictionary.to_pylist():
            at = known.get(t)
            if at is None:
                if len(known) >= 100_000:
                    known.clear()
                at = known[t] = int.from_bytes(md5(t.encode()).digest()[:2], "big") % self.dims
            place.append(at)
        place = np.array(place, np.int64)
        row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        cells = row * self.dims + place[words.indices.to_numpy()]
        return np.bincount(cells, minlength=len(tokens) * self.dims).reshape(len(tokens), self.dims).astype(np.float64)


class Scorer(Protocol):
    """Questions and candidate texts, row by row, to relevance scores; it may fail."""

    def __call__(self, questions: list[str], texts: list[str]) -> np.ndarray: ...


def scores(scorer: Scorer):
    """A scorer as a function on two columns: null for the rows of a batch that it failed on."""

    def run(question: pd.Series, text: pd.Series) -> pd.Series:
        out = np.full(len(question), np.nan)
        for _, at in question.reset_index(drop=True).groupby(question.reset_index(drop=True)).groups.items():  # a request is one question's
            try:
                out[at] = scorer(question.iloc[at].tolist(), text.iloc[at].tolist())
            except Exception:  # noqa: BLE001  whatever the model raises, the question falls back
                out[at] = np.nan
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return F.pandas_udf(run, "double")


def classify(question: Column) -> Column:
    """One of the four labels, by rule; a model's reply is read by label_in()."""
    return (
        F.when(question.rlike(r"(?i)\b(compare|versus|vs|difference)\b"), "comparison")
        .when(question.rlike(r"(?i)\b(error|fail|crash|exception)"), "troubleshoot")
        .when(F.size(F.split(strip(question), rf"(?<=[.!?]){WS}")) >= 2, "multi_part")
        .otherwise("simple")
    )


def label_in(reply: Column) -> Column:
    """The first label that the reply holds; simple if none."""
    low, out = F.lower(strip(reply)), F.lit("simple")
    for label in ("comparison", "troubleshoot", "multi_part", "simple"):
        out = F.when(F.contains(low, F.lit(label)), label).otherwise(out)
    return out


def sub_questions(question: Column) -> Column:
    """The first three sentences."""
    return F.slice(F.filter(F.split(strip(question), rf"(?<=[.!?]){WS}"), lambda s: s != ""), 1, 3)


def sub_questions_in(reply: Column) -> Column:
    """The JSON array of strings in a reply; null if there is none."""
    return F.from_json(F.nullif(widest_array(reply), F.lit("")), "array<string>")


def answer(first_chunk: Column) -> Column:
    """An extract of the best chunk in place of a generated answer."""
    return F.concat(F.lit("[1] "), F.substring(first_chunk, 1, 100))


def combine(question: Column, parts: Column) -> Column:
    """The answers of a question's parts as they stand, in place of one that a model makes of them; null is a failure."""
    return parts


def caption(page: Column) -> Column:
    """What stands for an image that no model has described."""
    return F.concat(F.lit("Image from page "), page.cast("string"))
