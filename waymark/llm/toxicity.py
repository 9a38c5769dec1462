"""Toxicity: character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the whole lower-cased text, hashed into a
fixed number of buckets. Document frequencies of every bucket by class come from all
labelled training rows; the log ratio of the smoothed frequencies scales each feature. The weights of
the logistic regression on the scaled features are fitted on a bounded sample of
labelled rows (at most SAMPLE_PER_CLASS of each class, chosen by hash of the id; of a text only the buckets with a ratio are kept), and both
classes weigh equally in it. Buckets of fewer than MIN_DOCS documents, or whose toxic documents differ from their expected number by less than
SIGNIFICANCE standard deviations, have ratio 0 and so no weight: it is part of the method. Scoring is one pass over the documents.

Defined results: a null text counts as empty; an empty text gets the score of
a text without features; repeated label rows of an id count once, toxic if any says so; labels that are
null are ignored; without training rows of both classes every text gets the smoothed
share of the toxic class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import give_back_memory, id_remainder, materialize, text_batches, whole_rows

BUCKETS = 1 << 20
SIZES = (4, 5)
#: Bound of the sample for the weights, by class.
SAMPLE_PER_CLASS = 2500
#: Buckets with fewer training documents carry no weight.
MIN_DOCS = 3
#: Labelled ids (under 50 bytes each in memory) up to which they are sent to every task; more are joined by a shuffle of the texts.
BROADCAST_LABELS = 2_000_000
#: Documents added to each bucket before the ratio is taken.
SMOOTHING = 10.0
#: Standard deviations by which a bucket's toxic documents must differ from their expected number to carry weight.
SIGNIFICANCE = 3.0
BLOCKS = 32
FIT_CHUNK = 200
THRESHOLD = 0.7


class Grams:
    """Distinct hashed character n-grams of one text at a time."""

    def __init__(self, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES):
        self.buckets, self.sizes = buckets, sizes
        self.last = np.zeros(buckets, dtype=np.int32)

    def of(self, text: str | None) -> np.ndarray:
        cp = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        parts = []
        for n in self.sizes:
            if len(cp) < n:
                continue
            h = np.full(len(cp) - n + 1, n, dtype=np.uint32)
            for j in range(n):
                h *= np.uint32(0x9E3779B1)
                h ^= cp[j : len(cp) - n + 1 + j]
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            parts.append((h >> np.uint32(7)) & np.uint32(self.buckets - 1))
        if not parts:
            return np.zeros(0, dtype=np.int32)
        h = np.concatenate(parts)
        order = np.arange(len(h), dtype=np.int32)
        self.last[h] = order
        return h[self.last[h] == order].astype(np.int32)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training documents by class, and by class and bucket. labelled: (text, label)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, found, docs = Grams(), np.zeros((2, BUCKETS), dtype=np.int64), [0, 0]
        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                found[label][grams.of(text)] += 1
                docs[label] += 1
        step = BUCKETS // BLOCKS
        give_back_memory()
        yield pd.DataFrame([(c, j, docs[c] if j == 0 else 0, found[c][j * step : (j + 1) * step].tobytes()) for c in (0, 1) if docs[c] for j in range(BLOCKS)], columns=["label", "block", "docs", "counts"])

    def total(key, b: pd.DataFrame) -> pd.DataFrame:
        counts = sum((np.frombuffer(x, dtype=np.int64) for x in b["counts"]), np.zeros(BUCKETS // BLOCKS, dtype=np.int64))
        return pd.DataFrame([(*key, int(b["docs"].sum()), counts.tobytes())], columns=["label", "block", "docs", "counts"])

    schema = "label int, block int, docs long, counts binary"
    rows = labelled.mapInPandas(count, schema).groupBy("label", "block").applyInPandas(total, schema).collect()  # 64 rows of fixed size
    docs, found = np.zeros(2), np.zeros((2, BUCKETS))
    step = BUCKETS // BLOCKS
    for r in rows:
        docs[r.label] += r.docs
        found[r.label][r.block * step : (r.block + 1) * step] = np.frombuffer(r.counts, dtype=np.int64)
    return docs, found


def log_ratios(docs: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of toxic and other documents with a bucket; 0 for buckets that are rare or do not stand out."""
    prior = SMOOTHING * docs / max(1.0, docs.sum())  # shared out by class size, so that an unseen bucket has ratio 0
    share = (found + prior[:, None]) / np.maximum(docs, 1.0)[:, None]
    seen, toxic = found.sum(axis=0), docs[1] / max(1.0, docs.sum())
    stands_out = np.abs(found[1] - seen * toxic) >= SIGNIFICANCE * np.sqrt(seen * toxic * (1 - toxic))
    return np.where((seen >= MIN_DOCS) & stands_out, np.log(share[1] / share[0]), 0.0).astype(np.float32)


def fit_weights(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression on present buckets scaled by their ratios: accelerated gradient steps. The weight of a bucket, and the intercept."""
    seen = np.zeros(len(ratios), dtype=bool)
    for k, x in enumerate(rows):
        rows[k] = x[ratios[x] != 0]
        seen[rows[k]] = True
    used = np.flatnonzero(seen)
    number = np.cumsum(seen, dtype=np.int32) - 1
    r = ratios[used].astype(np.float64)
    chunks = []  # a bounded number of documents at a time, so that no array spans the sample
    for a in range(0, len(rows), FIT_CHUNK):
        part = rows[a : a + FIT_CHUNK]
        chunks.append((slice(a, a + len(part)), number[np.concatenate(part)], np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part])))
        rows[a : a + FIT_CHUNK] = [len(x) for x in part]
    sizes = np.array(rows)

    def margins(w, b):
        v = w * r
        return np.concatenate([np.bincount(doc, weights=v[flat], minlength=at.stop - at.start) for at, flat, doc in chunks]) + b

    def gather(g):
        return sum((np.bincount(flat, weights=g[at][doc], minlength=len(used)) for at, flat, doc in chunks), np.zeros(len(used)))

    scale = np.sqrt(np.maximum(1, sizes)).mean()
    # per-feature step from the curvature bound of its own frequency
    w, b = np.zeros(len(used)), 0.0
    step_w = 1.0 / (0.25 * r * r * gather(weight) * scale + l2)
    step_b = 1.0 / 0.25
    vw, vb, tw, tb = w, b, w, b
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margins(vw, vb), -30, 30)))
        g = (p - y) * weight
        gw = r * gather(g) + l2 * vw
        tw2, tb2 = vw - 0.3 * step_w * gw, vb - 0.3 * step_b * g.sum()
        m = k / (k + 3)
        vw, vb = tw2 + m * (tw2 - tw), tb2 + m * (tb2 - tb)
        tw, tb = tw2, tb2
    out = np.zeros(len(ratios), dtype=np.float32)
    out[used] = tw * r
    return out, float(tb)


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept. docs: (doc_id, text); labels: (doc_id, toxic) of the rows to learn from.

    The ratios use every labelled row; the two classes weigh equally in the fit.
    """
    spark = docs.sparkSession
    text_batches(docs)
    marks = materialize(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")), "tox-labels")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    size, found = class_counts(texts.join(sent, "doc_id").select("text", "label"))
    if not size.all():
        share = (size[1] + 1) / (size.sum() + 2)
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share)))
    ratios = log_ratios(size, found)
    picks = [marks.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for c in (0, 1)]
    sample = _bounded(texts, picks, sample_per_class).select("text", "label")
    known = spark.sparkContext.broadcast(ratios)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, rows, y = Grams(), [], []
        for b in batches:
            rows += [x[known.value[x] != 0] for x in map(grams.of, b["text"])]  # a text of any length keeps only buckets that carry weight
            y += list(b["label"])
        if rows:
            y = np.array(y, dtype=np.float64)
            weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
            w, b0 = fit_weights(rows, y, known.value, weight)
            yield pd.DataFrame({"weights": [w.tobytes()], "intercept": [b0]})

    fitted = sample.repartition(1).mapInPandas(fit, "weights binary, intercept double").collect()  # one row, the bounded sample in one task
    return np.frombuffer(fitted[0].weights, dtype=np.float32), float(fitted[0].intercept)


def _bounded(texts: DataFrame, picks: list[DataFrame], most: int) -> DataFrame:
    """Rows of texts (doc_id, text) of the picked ids (doc_id, label; most at most of each class), with label: at most so many of a class. Only where ids have several rows, these are told apart by their texts."""
    rows = texts.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
    if all(r["count"] <= most for r in rows.groupBy("label").count().collect()):
        return rows
    keys = rows.select("doc_id", "label", F.xxhash64("text").alias("h")).distinct()
    first = [keys.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most) for c in (0, 1)]
    return texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(first[0].unionByName(first[1])), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])


def score(docs: DataFrame, weights: np.ndarray, intercept: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and score: probability-like toxicity from 0 to 1 of the whole text."""
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    @F.pandas_udf("double")
    def tox(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, (w, b0) = Grams(), model.value
        for s in batches:
            z = np.array([b0 + float(w[grams.of(t)].sum(dtype=np.float64)) for t in s])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        give_back_memory()

    return docs.withColumn("score", tox(F.col(text_col).cast("string")))


def learn_rows(labels: DataFrame) -> DataFrame:
    """Label rows that may be learnt from: crc32 of the id modulo 3 is not 1."""
    return labels.filter(id_remainder(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights, intercept = train(docs.select("doc_id", "text"), learn_rows(labels))
    return score(docs.select("doc_id", "text"), weights, intercept).select(
        "doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of docs, unchanged, whose text scores below the threshold. learn_from: the labelled documents, docs by default."""
    weights, intercept = train((docs if learn_from is None else learn_from).select("doc_id", "text"), learn_rows(labels))
    kept = score(whole_rows(docs, text=F.col("text")), weights, intercept)
    return kept.filter(F.col("score") < threshold).select("row.*")
