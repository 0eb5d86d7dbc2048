"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each word, each pair of neighbouring words and each run of three and
of four characters (the border of a word counts as one), hashed into a fixed number of buckets; a softmax over the average
gives the class probabilities. Vectors and output weights are trained together by stochastic gradient descent in NumPy.
A word that repeats the one before it counts as one feature, whatever the word, so that repetition is learnt as such.

Cases: a null or empty text has no features and scores the model's prior; a text of any length is taken in slices, whose
features are summed; rows keep their number, so repeated rows give repeated results; without labels of both classes the
score is the share of label 1 (0.5 without any). Columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SLICE, blocks, borders, bounded_sample, give_back, mix, small_batches, tidy, word_hashes

#: The feature of a word that repeats the one before it.
REPEAT = np.uint64(0x5A4D)
#: How many labelled documents, and bytes of their text, the model is fitted on at most.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 3000, 32 << 20


@dataclass
class QualityModel:
    """After training the vectors are only needed as their products with the output weights: one logit for each bucket."""

    logits: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, data, at in blocks(texts):
            n = len(at) - 1
            total, count = np.zeros(n), np.zeros(n)
            for row, bucket in features(data, at, len(self.logits)):
                total += np.bincount(row, self.logits[bucket], minlength=n)
                count += np.bincount(row, minlength=n)
            out[lo : lo + n] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))
        return out


def features(data: np.ndarray, at: np.ndarray, buckets: int):
    """(row, bucket) of the features of a block, in parts."""
    mask, none = np.uint64(buckets - 1), np.uint64(0)
    starts, ends = borders(data, at, NOT_SPACE)
    row = np.searchsorted(at, starts, "right") - 1
    word = word_hashes(data, starts, ends, False)
    same = row[1:] == row[:-1]
    yield row, (word & mask).astype(np.int64)
    pair = np.where(word[1:] == word[:-1], REPEAT, mix(word[1:] + word[:-1] * np.uint64(3)))
    yield row[1:][same], (pair[same] & mask).astype(np.int64)
    for lo in range(0, len(data), SLICE):
        # Characters of the slice, with some before and behind it; each is its bytes as one number, 0 beyond its word.
        a = max(0, lo - 8)
        part = data[a : lo + SLICE + 16]
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        if not len(lead):
            continue
        size = np.diff(np.append(lead, len(part)))
        code = part[lead].astype(np.uint64)
        for k in range(1, 4):
            more = size > k
            code[more] |= part[lead[more] + k].astype(np.uint64) << np.uint64(8 * k)
        code = np.where(NOT_SPACE[part[lead]], code, 0)
        text = np.searchsorted(at, lead + a, "right") - 1
        near = np.append(text[1:] == text[:-1], False)  # whether the next character is of the same text
        after = np.where(near, np.append(code[1:], none), 0)
        before = np.where(np.append(False, near[:-1]), np.append(none, code[:-1]), 0)
        second = np.where(near, np.append(after[1:], none), 0)
        three = mix(before * np.uint64(0x9E3779B1) + (code << np.uint64(17)) + after * np.uint64(0x85EBCA6B))
        four = mix(three + second * np.uint64(0xC2B2AE35) + np.uint64(1))
        own = (lead + a >= lo) & (lead + a < lo + SLICE) & (code != 0)
        yield text[own], (three[own] & mask).astype(np.int64)
        own &= after != 0
        yield text[own], (four[own] & mask).astype(np.int64)


def _bags(batches, buckets: int):
    """Each training document as its distinct buckets and their shares."""
    for batch in batches:
        ys, texts, out = batch.column("y"), batch.column("text"), []
        for lo, data, at in blocks(texts):
            n = len(at) - 1
            row, bucket = map(np.concatenate, zip(*features(data, at, buckets), strict=True))
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(n + 1))
            for i in range(n):
                b, c = np.unique(bucket[order[cut[i] : cut[i + 1]]], return_counts=True)
                out.append((ys[lo + i].as_py(), b.astype(np.int32).tobytes(), (c / max(1, c.sum())).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["y", "bucket", "share"])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, dim: int = 8, epochs: int = 8, least_steps: int = 600, rate: float = 0.5, batch: int = 32, seed: int = 7, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> QualityModel:
    """Fit on a bounded sample of labelled documents; learn is a condition on the column id. There are epochs passes over it, or more for least_steps steps. What reaches the driver is at most buckets pairs for each of max_rows documents."""
    small_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    sample = bounded_sample(docs, labels, label, learn, id_col, text_col, max_rows, max_bytes, False)
    rows = sample.mapInArrow(tidy(lambda it: _bags(it, buckets)), "y int, bucket binary, share binary").collect()
    rows.sort(key=lambda r: (r.y, r.bucket))
    ys = np.array([r.y for r in rows], np.float64)
    if not len(ys) or ys.min() == ys.max():
        prior = np.clip((ys.sum() + 0.5) / (len(ys) + 1), 0.01, 0.99)
        return QualityModel(np.zeros(buckets, np.float32), float(np.log(prior / (1 - prior))))
    bags = [(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.share, np.float32)) for r in rows]
    del rows
    model = _train(bags, ys.astype(np.int64), buckets, dim, max(epochs, -(-least_steps * batch // len(bags))), rate, batch, seed)
    del bags
    give_back()
    return model


def _train(bags: list, ys: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, batch: int, seed: int) -> QualityModel:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (buckets, dim)).astype(np.float32)
    out, bias = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            sizes = np.array([len(bags[i][0]) for i in part])
            bucket, share = np.concatenate([bags[i][0] for i in part]), np.concatenate([bags[i][1] for i in part])
            full = sizes > 0
            weighted = vectors[bucket] * share[:, None]
            mean = np.zeros((len(part), dim), np.float32)
            if full.any():
                mean[full] = np.add.reduceat(weighted, (np.cumsum(sizes) - sizes)[full], axis=0)
            logit = mean @ out + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), ys[part]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ out.T
            np.add.at(vectors, bucket, (-lr * 8) * np.repeat(back, sizes, axis=0) * share[:, None])
            out -= lr * (mean.T @ p) / len(part)
            bias -= lr * p.mean(0)
            step += 1
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every whole text, one row for each row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = held.value.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, predicted int")


def keep_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores threshold or more."""
    small_batches(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(held.value.scores(b.column(at)) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
