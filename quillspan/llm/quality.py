"""Quality classifier: supervised subword embeddings.

A document's features are its words and the character n-grams of its bytes, hashed to BUCKETS rows
of an embedding table. Their average goes through a softmax over the two labels; table and output
are trained by numpy stochastic gradient descent. As the output is linear in the average, the
trained model is kept as one number a bucket, and scoring a text is a mean of those numbers.

Training uses at most SAMPLE labelled rows (a documented bound; chosen by a hash of doc_id) whose
crc32(doc_id as text) mod FOLDS is not HELD_OUT. Scores cover all rows and whole texts; neither
labels, lang, source nor doc_id enter a score.

Cases: a null or empty text has no features and gets the score of the bias; labels that are null or
not 0 or 1 are ignored, as are labels without a text; a doc_id with several labels counts with each;
without labels the score is 0.5, with one class only the smoothed share of it; repeated rows are
scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUCKETS, DIM, GRAMS = 1 << 18, 8, (2, 4)
SAMPLE, EPOCHS, RATE, SEED = 6000, 4, 0.5, 7
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
_BLOCK = 1 << 20
_POWERS = (np.uint32(2654435761) ** np.arange(64, dtype=np.uint32)).astype(np.uint32)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt)) * np.uint32(2246822519)
    h ^= h >> np.uint32(15)
    h *= np.uint32(3266489917)
    return (h >> np.uint32(14)) & np.uint32(BUCKETS - 1)


def features(data: bytes):
    """Arrays of bucket numbers: n-grams of each size, then words; long texts come in blocks."""
    for at in range(0, len(data), _BLOCK):
        b = np.frombuffer(data[at : at + _BLOCK + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        fresh = min(_BLOCK, len(data) - at)
        for n in GRAMS:
            m = min(len(b) - n + 1, fresh)
            if m > 0:
                h = b[:m].copy()
                for j in range(1, n):
                    h = h * np.uint32(16777619) ^ b[j : j + m]
                yield _mixed(h, n)
        own = b[:fresh]
        inside = own > 32
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(starts):
            place = np.arange(fresh) - np.repeat(starts, np.diff(np.append(starts, fresh)))[-fresh:] if starts[0] == 0 else np.arange(fresh) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, fresh)))])
            yield _mixed(np.add.reduceat(np.where(inside, own * _POWERS[place & 63], 0).astype(np.uint32), starts), 1)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """(one number a bucket, bias): the log odds of label 1 are the mean of its buckets' numbers plus the bias."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # Two arrays of all texts instead of two for each, so that the driver gets their memory back whole.
    idxs, shares, cut = bytearray(), bytearray(), [0]
    for t in texts:
        found = list(features(t.encode()))
        idx, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0))
        idxs += idx.astype(np.uint32).tobytes()
        shares += (c / max(c.sum(), 1)).astype(np.float32).tobytes()
        cut.append(cut[-1] + len(idx))
    idxs, shares = np.frombuffer(idxs, np.uint32), np.frombuffer(shares, np.float32)
    steps, done = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(labels)):
            idx, share = idxs[cut[k] : cut[k + 1]], shares[cut[k] : cut[k + 1]]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = table[idx]
            mean = share @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[y[k]] -= 1
            back = out @ err
            out -= rate * np.outer(mean, err)
            bias -= rate * err
            # The same step for each bucket that occurs, as its share of the mean is small.
            table[idx] = rows - rate * np.minimum(share * 100, 1)[:, None] * back
    w = out[:, 1] - out[:, 0]
    return table @ w, float(bias[1] - bias[0])


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    rows = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & (fold() != HELD_OUT)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # At most ``sample`` rows on this side.
    got = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").filter("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("text", "quality").collect()
    return train([r.text for r in got], [r.quality for r in got])


def scorer(spark, model: tuple[np.ndarray, float]):
    """A pandas function text -> score; the broadcast model has BUCKETS numbers."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        value, bias = held.value
        out = np.full(len(texts), bias)
        for i, t in enumerate(texts):
            total = n = 0.0
            for f in features((t or "").encode()):
                total, n = total + float(value[f].sum(dtype=np.float64)), n + len(f)
            out[i] += total / n if n else 0.0
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return score


def scored(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """documents with score added."""
    return documents.withColumn("score", scorer(documents.sparkSession, model)("text"))
