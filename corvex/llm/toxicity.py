"""Toxicity from bags of subword embeddings, averaged into a linear softmax.

A word is the mean of the vectors of its pieces, the word itself and its character n-grams, so a
misspelling or an unseen inflection shares most vectors with the words it comes from; a text is the
mean of its words. The vectors and the softmax are trained together in numpy (AdaGrad over
mini-batches of bags) by one task on a bounded sample. Pieces whose share of documents does not
differ clearly between the labels have the zero vector. As the softmax has two sides, a trained
model comes down to one number a piece, its vector's part of the difference; texts are scored with
those.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, known_id, shown_id, unused
from .kernels import released
from .langid import held_out_of

WORD = r"[^\W_]+"
SHORTEST, LONGEST = 3, 7
#: A piece has a vector if its log odds between the labels are so many standard deviations from 0; what is
#: left beyond them scales its share.
DEVIATIONS = 2.5
#: Counters of the pieces' documents; a collision can only blur a piece's odds.
COUNTERS = 1 << 20
DIM = 4
#: The mean is multiplied by this before the softmax: a toxic word in fifty moves it by a fiftieth only.
GAIN = 200.0
RATE = 0.1
DECAY = 0.03
INIT = 0.01
EPOCHS, LEAST_STEPS = 10, 700
#: Labelled documents that the model is fitted on, at most, of each label: those with the least hash of their id.
MAX_PER_LABEL = 1500
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 150_000
BIAS, PRIOR = "", " "


def pieces_of(word: str) -> list[str]:
    """The word between its ends' marks, and its n-grams of SHORTEST to LONGEST characters."""
    padded = f"<{word}>"
    size = len(padded)
    out = [padded[i : i + n] for n in range(SHORTEST, min(LONGEST, size - 1) + 1) for i in range(size - n + 1)]
    out.append(padded)
    return out


def words_of(text: str) -> Counter:
    return Counter(re.findall(WORD, text.lower()))


def train(docs: list[Counter], labels: list[int], share_toxic: float, epochs: int = EPOCHS, seed: int = 7) -> dict[str, float]:
    """Weights of pieces, with BIAS, and PRIOR for texts without words. docs: words of the texts."""
    labels = np.array(labels, np.int64)
    if not labels.any() or labels.all():
        return {BIAS: 20.0 if len(labels) and labels.all() else -20.0, PRIOR: float(labels.mean()) if len(labels) else 0.0}
    rng = np.random.default_rng(seed)
    seen, known = np.zeros((2, COUNTERS), np.float32), {}
    for words, label in zip(docs, labels):
        for w in words:
            if w not in known:
                known[w] = np.array([zlib.crc32(p.encode()) % COUNTERS for p in pieces_of(w)], np.int32)
        if words:
            seen[label, np.unique(np.concatenate([known[w] for w in words]))] += 1
    odds = np.log((seen[1] + 1) / np.float32(labels.sum() + 2)) - np.log((seen[0] + 1) / np.float32((1 - labels).sum() + 2))
    certain = np.abs(odds) - DEVIATIONS * np.sqrt(1 / (seen[1] + 1) + 1 / (seen[0] + 1))
    scale = np.where(certain > 0, certain, 0).astype(np.float32)
    strength = {p: float(n) for w, at in known.items() for p, n in zip(pieces_of(w), scale[at]) if n}
    kept = [BIAS, *sorted(strength)]  # the first is in every bag, with no share
    number = {p: i for i, p in enumerate(kept)}
    scale = np.array([strength.get(p, 0.0) for p in kept], np.float32)
    del seen, odds, certain, known
    bags = []
    for words in docs:
        total, bag = max(1, sum(words.values())), Counter({0: 0.0})
        for w, n in words.items():
            pieces = pieces_of(w)
            for p in pieces:
                if (i := number.get(p)) is not None:
                    bag[i] += n / total / len(pieces)
        piece = np.fromiter(bag, np.int32)
        bags.append((piece, np.fromiter(bag.values(), np.float32) * scale[piece] * np.float32(GAIN)))
    del docs
    use = np.array([i for i, (piece, _) in enumerate(bags) if len(piece)])
    rng.shuffle(use)
    use, aside = use[len(use) // 5 :], use[: len(use) // 5]
    vectors = rng.normal(0, INIT, (len(kept), DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full(x.shape, 1e-4, np.float32) for x in (vectors, out, bias)]
    for _ in range(max(epochs, -(-LEAST_STEPS * 32 // max(1, len(use))))):
        rng.shuffle(use)
        for at in range(0, len(use), 32):
            batch = use[at : at + 32]
            flat, share = (np.concatenate([bags[i][k] for i in batch]) for k in (0, 1))
            doc = np.repeat(np.arange(len(batch)), [len(bags[i][0]) for i in batch])
            mean = np.add.reduceat(vectors[flat] * share[:, None], np.searchsorted(doc, np.arange(len(batch))), axis=0)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            used, inverse = np.unique(flat, return_inverse=True)
            back = (p @ out.T)[doc] * share[:, None]
            step = np.stack([np.bincount(inverse, back[:, k], len(used)) for k in range(DIM)], 1).astype(np.float32)
            step += DECAY / len(batch) * vectors[used]
            squares[0][used] += step**2
            vectors[used] -= RATE * step / np.sqrt(squares[0][used])
            for x, g, q in ((out, mean.T @ p, squares[1]), (bias, p.sum(0), squares[2])):
                q += g**2
                x -= RATE * g / np.sqrt(q)
    weights, shift = GAIN * scale * (vectors @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0])
    # The fifth of the sample that was set aside tells where to part the labels, at their true shares.
    logits = np.array([float((vectors @ (out[:, 1] - out[:, 0]))[bags[i][0]] @ bags[i][1]) + shift for i in aside])
    y = labels[aside]
    if len(y) and y.any() and not y.all():
        weight = np.where(y == 1, share_toxic / y.mean(), (1 - share_toxic) / (1 - y.mean()))
        order = np.argsort(logits)
        logits, y, weight = logits[order], y[order], weight[order]
        errors = np.concatenate([[0], np.cumsum(weight * (y == 1))]) + np.concatenate([np.cumsum((weight * (y == 0))[::-1])[::-1], [0]])
        best = np.flatnonzero(errors <= errors.min() + 1e-9)
        edges = np.concatenate([[logits[0] - 2], (logits[1:] + logits[:-1]) / 2, [logits[-1] + 2]])
        shift -= float(np.median(edges[best]))
    return dict(zip(kept, weights.tolist())) | {BIAS: shift, PRIOR: share_toxic}


def _train(share_toxic: float):
    def run(batches):
        rows = [(doc, zlib.crc32(text.encode()), int(toxic), words_of(text)) for part in batches for doc, text, toxic in zip(part.doc_id, part.text, part.toxic)]
        rows.sort(key=lambda r: r[:3])
        model = train([r[3] for r in rows], [r[2] for r in rows], share_toxic)
        yield pd.DataFrame({"piece": list(model), "weight": list(model.values())})

    return released(run)


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> dict[str, float]:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) that are not held out.

    It learns from at most max_per_label documents of each label, in one task. A document with
    several labels counts as toxic if one of them says so; null labels and ids are left out. Of an
    id with several texts the one with the least SHA-256 is learned from, once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out_of("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return train([], [], 0.0)
    some = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label) for t in (0, 1)]
    chosen = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    rows = chosen.select("doc_id", "text", "toxic").repartition(1).mapInPandas(_train(share), "piece string, weight double").toPandas()
    return dict(zip(rows.piece, rows.weight))


def word_weight(model: dict[str, float], word: str) -> float:
    """The mean over the word's pieces, most of which weigh nothing."""
    pieces = pieces_of(word)
    return sum(x for x in map(model.get, pieces) if x is not None) / len(pieces)


def text_score(model: dict[str, float], weights: list[float]) -> float:
    mean = math.fsum(weights) / len(weights)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, mean + model[BIAS]))))


def _score(model_of, score_col: str):
    def run(batches):
        model, find = model_of.value, re.compile(WORD).findall
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                words = find(text.lower()) if text else []
                if not words:
                    scores.append(model[PRIOR])
                    continue
                if len(known) > REMEMBERED:
                    known = {}
                for w in set(words).difference(known):
                    known[w] = word_weight(model, w)
                scores.append(text_score(model, [known[w] for w in words]))
            names = [*(c for c in batch.schema.names if c != "text"), "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, score_col])

    return released(run)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, score_col: str = "score") -> DataFrame:
    """The rows and columns of docs with a score: 0 to 1, higher where label 1 is likelier.

    Null text and text without words get the share of toxic documents among those with a label (0 if
    none). A document is never its own evidence: labels and other columns are not read in scoring.
    score_col must be no column of docs. Repeated rows are scored alike. An empty table gives an
    empty result.
    """
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score_col} already")
    spark = docs.sparkSession
    Workspace(spark, "toxicity")
    model = spark.sparkContext.broadcast(fit(docs, labels, max_per_label))
    order = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*order, "text"])
    rows = docs.withColumn("text", F.col("text").cast("string")).select(*(F.col(f"`{c}`") for c in [*order, "text"]))
    return rows.mapInArrow(_score(model, score_col), f"{fields}, `{score_col}` double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rows = docs.select(known_id("doc_id").alias("doc_id"), "text")
    out = score_toxicity(rows, labels)
    return out.select(shown_id(F.col("doc_id")).alias("doc_id"), held_out_of("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with all columns of docs."""
    score = unused("score", docs.columns)
    return score_toxicity(docs, labels, score_col=score).filter(F.col(score) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
