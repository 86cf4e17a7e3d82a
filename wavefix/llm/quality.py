"""Quality scores by positive-unlabelled learning.

Trusted positives (documents labelled good) and unlabelled web text train a logistic
model that minimises the non-negative unbiased risk

    prior * risk(positives, +1) + max(0, risk(unlabelled, -1) - prior * risk(positives, -1));

where the second term turns negative its gradient is reversed, so the model cannot
fit the positives out of the unlabelled text. The class prior is estimated from the
labels. Inputs are the text's byte-pair profile and a few ratios, nothing else.

The inputs' means and scales are those of the positives. The unlabelled risk is that of all documents
that aren't held out: the fit itself runs in one task on at most ``POSITIVES`` labelled positives and ``UNLABELLED``
documents, those of least hashed id, but a second round shifts its unlabelled risk by the difference between
all documents and that sample in risk and gradient, both at the first round's model (the surrogate
likelihood of distributed estimation). Where the sample is the whole table the shift is nil. Scoring is a map.

Defined results: a null text is scored as an empty one; without any positive label
every score is 0.5; a null label is no label; a document with several labels
counts as positive if any is; rows that repeat are scored alike; an empty table
gives no rows; other columns, language and source included, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import CHUNK, gram_hashes, mix, scratch, word_hashes, word_spans

POSITIVES, UNLABELLED = 6_000, 12_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 512
STEPS, RATE, DECAY = 300, 0.05, 1e-4

_BIN = (mix(np.arange(1, 65537, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64)
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"()-?"), 1):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _k
_KIND[128:] = 7
KINDS = 8
WIDTH = BINS + KINDS + 4


def features(texts: list[bytes]) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        _fill(out[first:end], texts[first:end])
        first = end
    return out


def _fill(out: np.ndarray, texts: list[bytes]) -> None:
    n = len(texts)
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(n), sizes)
    pair = _BIN[(data[:-1].astype(np.int64) << 8) | data[1:]]
    own = doc[:-1] == doc[1:]
    counts = np.bincount((doc[:-1] * BINS + pair)[own], minlength=n * BINS).reshape(n, BINS)
    length = sizes[:, None]
    out[:, :BINS] = np.sqrt(counts / length)
    out[:, BINS : BINS + KINDS] = np.bincount(doc * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS) / length
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, 3)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    last = BINS + KINDS
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            out[i, last] = np.log1p(b - a)
            out[i, last + 1] = (ends[a:b] - starts[a:b]).mean() / 10
            out[i, last + 2] = (words[a + 1 : b] == words[a : b - 1]).sum() / (b - a)
            if b - a >= 3:
                out[i, last + 3] = 1 - len(np.unique(grams[a : b - 2])) / (b - a - 2)


def unlabelled_risk(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums over rows of features: the loss of calling them negative, its gradient by weights and bias, and the rows."""
    z = ((x - model[1, :-1]) / model[2, :-1]).astype(np.float32)
    at = z @ model[0, :-1].astype(np.float32) + model[0, -1]
    slope = 1 / (1 + np.exp(-at))
    return np.concatenate(([np.logaddexp(0, at).sum()], slope @ z, [slope.sum(), len(x)])).astype(np.float64)


def fit(x: np.ndarray, positive: np.ndarray, prior: float, shift: np.ndarray) -> np.ndarray:
    """Weights, bias, and the positives' means and scales (rows of a matrix) of the model of least risk; zeros without positives.

    ``shift`` (a level, then a slope for each weight and the bias) is added to the unlabelled risk.
    """
    weights, bias = np.zeros(WIDTH), 0.0
    model = np.zeros((3, WIDTH + 1))
    if positive.any() and not positive.all():
        mean, scale = x[positive].mean(axis=0), x[positive].std(axis=0) + 0.01
        model[1, :-1], model[2, :-1] = mean, scale
        z = ((x - mean) / scale).astype(np.float32)
        p, u = z[positive], z[~positive]
        m1, m2 = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        for step in range(1, STEPS + 1):
            at_p, at_u = p @ weights.astype(np.float32) + bias, u @ weights.astype(np.float32) + bias
            good, bad, unl = (1 / (1 + np.exp(-v)) for v in (-at_p, at_p, at_u))  # slopes of the three risks
            shifted = shift[0] + shift[1:] @ np.append(weights, bias)
            negative = np.logaddexp(0, at_u).mean() + shifted - prior * np.logaddexp(0, at_p).mean()
            g_p, g_u = prior * bad / len(p), unl / len(u)
            by = (-prior * good / len(p) - g_p, g_u) if negative >= 0 else (g_p, -g_u)
            grad = np.append(p.T @ by[0].astype(np.float32) + u.T @ by[1].astype(np.float32) + DECAY * weights, by[0].sum() + by[1].sum())
            grad = grad + shift[1:] if negative >= 0 else grad - shift[1:]
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - move[-1]
    model[0] = np.append(weights, bias)
    return model


def score(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = (x - model[1, :-1]) / np.where(model[2, :-1] > 0, model[2, :-1], 1)
    return 1 / (1 + np.exp(-np.clip(z @ model[0, :-1] + model[0, -1], -30, 30)))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def whole_risk(docs: DataFrame, model: np.ndarray) -> np.ndarray:
    """``unlabelled_risk`` of all documents that aren't held out; one short vector leaves a task."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(WIDTH + 3)
        for pdf in batches:
            total += unlabelled_risk(model, features([t.encode("utf-8", "replace") for t in pdf["text"]]))
        yield pd.DataFrame({"v": [total]})

    rows = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(part, "v array<double>")
    sums = rows.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return np.array([r["v"] for r in sums])


def trained(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The model fitted on rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = float(np.clip((good + 1) / (n + 2), 0.05, 0.98))
    # Both lists of ids are limited, so they may be broadcast; texts don't move.
    positives = known.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).withColumn("positive", F.lit(True))
    # A bound on the hash, four times wider than needed, keeps what tasks send for the limit from growing with their number.
    widest = min((1 << 64) - 1, (UNLABELLED << 66) // max(docs.count(), 1)) - (1 << 63)
    unlabelled = docs.where(~held_out(F.col("doc_id")) & (F.xxhash64("doc_id") <= widest)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    rows = docs.select("doc_id", "text").join(F.broadcast(positives.union(unlabelled)), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "positive", "doc_id")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = features([t.encode("utf-8", "replace") for t in pdf["text"]])
            yield pd.DataFrame({"one": 1, "doc_id": pdf["doc_id"], "positive": pdf["positive"], "x": [r.tobytes() for r in x]})

    def fitted(sample: DataFrame, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model, and its unlabelled risk and gradient on the sample."""

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["positive", "doc_id"], kind="stable")
            x, positive = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1), pdf["positive"].to_numpy()
            model = fit(x, positive, prior, shift)
            risk = unlabelled_risk(model, x[~positive]) if model[2].any() else np.zeros(WIDTH + 3)
            return pd.DataFrame({"model": [model.tobytes()], "risk": [risk.tobytes()]})

        found = sample.groupBy("one").applyInPandas(train, "model binary, risk binary").first()
        return (np.frombuffer(found["model"]).reshape(3, -1), np.frombuffer(found["risk"])) if found else (np.zeros((3, WIDTH + 1)), np.zeros(WIDTH + 3))

    with scratch(docs.sparkSession, "quality") as written:
        sample = written(rows.mapInPandas(describe, "one int, doc_id long, positive boolean, x binary"))
        model, part = fitted(sample, np.zeros(WIDTH + 2))
        if not model[2].any():  # no positive in the table
            return model
        whole = whole_risk(docs, model)
        shift = whole[:-1] / whole[-1] - part[:-1] / part[-1]
        shift[0] -= shift[1:] @ model[0]
        return fitted(sample, shift)[0]


def scorer(model: np.ndarray) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(score(model, features([t.encode("utf-8", "replace") for t in text])))

    return lambda text: quality(F.coalesce(text, F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = scorer(trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
