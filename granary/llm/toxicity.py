"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets.

Tokens are runs of letters, digits and bytes beyond ASCII, lower-cased A-Z. Labels are of documents, so the tags of their
tokens are latent: a clean document has no toxic token, a toxic one has one at least. They are found by expectation
maximisation. To begin with, a toxic document has one toxic token in all, shared out over its tokens by the odds that
toxic documents rather than clean ones have its features; where all are alike, as in a phrase of ordinary words, evenly. In
each turn the field is trained on these expected tags and pairs of tags, and expects new ones: its marginals divided by its
probability that the document has a toxic token, where a share of labels may be wrong.

The field has two tags; its emissions are hashed prefixes (3 to 8 bytes), suffix, whole token, and the token with each of its
neighbours; its transitions are the pairs of tags. It is trained by gradient ascent on the conditional log-likelihood of
sentences of up to 64 tokens, with the expected counts of forward-backward; training documents of equal tokens count once, and
features of a single document don't. A document's score is a logistic function, fitted on the training documents, of the
log-odds of the chain that some token is toxic and the log of the expected number of toxic tokens.

Cases: a null or empty text has no token and scores 0; rows keep their number; without labels of both classes, or
without a feature that two training documents share, all scores are 0. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, SLICE, Hashes, blocks, borders, bounded_sample, give_back, long_hash, mix, slices, small_batches, tidy, word_hashes

PREFIXES = (3, 4, 5, 6, 8)
#: Columns of a token's features: whole token, prefixes, suffix of three bytes, the neighbours' prefixes of five bytes.
WHOLE, SUFFIX, BEFORE, AFTER, WIDTH = 0, 1 + len(PREFIXES), 2 + len(PREFIXES), 3 + len(PREFIXES), 4 + len(PREFIXES)
#: Labelled documents of each class, and bytes of their text, that the field is fitted on at most.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 800, 4 << 20
SPAN = 64
#: Tokens whose features are held at once when texts are scored, and bits of a feature by which documents that have it are counted.
AT_ONCE, ODDS_BITS = 1 << 15, 22


def token_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row and (tokens, WIDTH) feature hashes; 0 stands for none."""
    starts, ends = borders(data, at, ALNUM)
    row = np.searchsorted(at, starts, "right") - 1
    return starts, ends, row, _features(data, starts, ends, row)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    f, size = np.zeros((len(starts), WIDTH), np.uint64), ends - starts
    if not len(starts):
        return f
    f[:, WHOLE] = word_hashes(data, starts, ends, True)
    head, five = np.minimum(size, 8), np.empty(len(starts), np.uint64)
    for lo, hi in slices(starts, ends):
        # Only the ends of a token that is longer than a slice are hashed here.
        a, cut = int(starts[lo]), int(ends[hi - 1]) - int(starts[lo]) > SLICE
        s, n = starts[lo:hi] - a, head[lo:hi]
        h = Hashes(data[a : a + 8] if cut else data[a : ends[hi - 1]], True)
        for k, width in enumerate(PREFIXES, 1):
            long = n >= width
            f[lo:hi, k][long] = mix(h.of(s[long], s[long] + width) + np.uint64(width))
        five[lo:hi] = mix(h.of(s, s + np.minimum(n, 5)))
        if cut:
            f[lo, SUFFIX] = mix(np.array([long_hash(data[ends[lo] - 3 : ends[lo]], True)], np.uint64) + np.uint64(100))[0]
        else:
            long, e = n >= 3, ends[lo:hi] - a
            f[lo:hi, SUFFIX][long] = mix(h.of(e[long] - 3, e[long]) + np.uint64(100))
    same = row[1:] == row[:-1]
    pair = mix(mix(five[:-1][same]) ^ five[1:][same])
    f[1:, BEFORE][same] = mix(pair + np.uint64(101))
    f[:-1, AFTER][same] = mix(pair + np.uint64(102))
    return f


@dataclass
class ToxicityModel:
    """weights: log-odds of the tag "toxic" for each bucket; step: 2 x 2 transition scores; first: bias; link: of the document's score."""

    weights: np.ndarray
    step: np.ndarray
    first: float
    link: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))

    def marginals(self, f: np.ndarray, row: np.ndarray) -> np.ndarray:
        return chain(self._emissions(f), row, self.step)

    def _emissions(self, f: np.ndarray) -> np.ndarray:
        bucket = (f & f.dtype.type(len(self.weights) - 1)).astype(np.int32)
        emit = np.zeros(len(f))
        for k in range(WIDTH):
            emit += np.where(f[:, k] != 0, self.weights[bucket[:, k]], 0)
        return emit + self.first

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of the tokens of texts of any length; features are made for AT_ONCE tokens at a time, with a neighbour on each side."""
        emit = np.empty(len(starts))
        for lo in range(0, len(starts), AT_ONCE):
            a, b = max(0, lo - 1), min(len(starts), lo + AT_ONCE + 1)
            emit[lo : lo + AT_ONCE] = self._emissions(_features(data, starts[a:b], ends[a:b], row[a:b])[lo - a :][:AT_ONCE])
        return emit

    def tagged(self, texts: pa.Array):
        """(first row, starts, ends, row, marginals, offsets, data, rows) of each block."""
        for lo, data, at in blocks(texts):
            starts, ends = borders(data, at, ALNUM)
            row = np.searchsorted(at, starts, "right") - 1
            yield lo, starts, ends, row, chain(self.emissions(data, starts, ends, row), row, self.step), at, data, len(at) - 1

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, _, _, row, p, _, _, n in self.tagged(texts):
            out[lo : lo + n] = self.link_of(*summary(row, p, self.step, n))
        return out

    def link_of(self, odds: np.ndarray, count: np.ndarray, any_: np.ndarray) -> np.ndarray:
        z = self.link[0] + self.link[1] * odds + self.link[2] * count
        return np.where(any_, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)


def summary(row: np.ndarray, p: np.ndarray, step: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: log-odds that a token is toxic (within 12 of 0), log of the expected number, whether it has tokens."""
    none = log_none(p, row, step, n)
    odds = np.log(np.maximum(-np.expm1(none), 1e-12)) - none
    return np.clip(odds, -12, 12), np.log1p(np.bincount(row, p, minlength=n)), np.bincount(row, minlength=n) > 0


def chain(emit: np.ndarray, row: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals of the tag "toxic" by forward-backward over all rows at once.

    The tokens are one chain in which a row's first token forgets what was before. It is cut into columns of equal
    length: one pass multiplies the 2 x 2 matrices of each column, a short loop carries vectors across columns, and a
    second pass runs forward and backward within the columns.
    """
    n = len(emit)
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n) / 2))
    cols = -(-n // length)
    pad = cols * length
    e = np.ones(pad)
    e[:n] = np.exp(np.clip(emit, -30, 30))
    reset = np.zeros(pad, bool)
    reset[0] = True
    reset[1:n] = row[1:] != row[:-1]
    reset[n:] = True
    e, reset = e.reshape(cols, length).T, reset.reshape(cols, length).T  # by step, then by column
    t = np.exp(step)

    def onward(a0, a1, k):
        """A row vector times the matrix of step k: transition (or start), then emission."""
        b0, b1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[k]
        s = a0 + a1
        b0, b1 = np.where(reset[k], s, b0), np.where(reset[k], s * e[k], b1)
        return b0, b1

    def scaled(*xs):
        top = np.maximum.reduce(xs)
        return [x / top for x in xs]

    one, zero = np.ones(cols), np.zeros(cols)
    m = [one, zero, zero, one]  # rows of the product of a column's matrices
    for k in range(length):
        m = scaled(*onward(m[0], m[1], k), *onward(m[2], m[3], k))
    into, back = np.empty((2, cols)), np.empty((2, cols))
    v = (1.0, 1.0)
    for c in range(cols):
        into[:, c] = v
        v = (v[0] * m[0][c] + v[1] * m[2][c], v[0] * m[1][c] + v[1] * m[3][c])
        s = v[0] + v[1]
        v = (v[0] / s, v[1] / s)
    v = (1.0, 1.0)
    for c in range(cols - 1, -1, -1):
        back[:, c] = v
        v = (m[0][c] * v[0] + m[1][c] * v[1], m[2][c] * v[0] + m[3][c] * v[1])
        s = v[0] + v[1]
        v = (v[0] / s, v[1] / s)
    alpha0, alpha1 = np.empty_like(e), np.empty_like(e)
    a0, a1 = into
    for k in range(length):
        a0, a1 = scaled(*onward(a0, a1, k))
        alpha0[k], alpha1[k] = a0, a1
    out, (b0, b1) = np.empty_like(e), back
    for k in range(length - 1, -1, -1):
        x, y = alpha0[k] * b0, alpha1[k] * b1
        out[k] = y / (x + y)
        c1 = e[k] * b1
        fresh = b0 + c1
        b0, b1 = scaled(np.where(reset[k], fresh, t[0, 0] * b0 + t[0, 1] * c1), np.where(reset[k], fresh, t[1, 0] * b0 + t[1, 1] * c1))
    return out.T.reshape(-1)[:n]


def _tokens(batches):
    """Each training document as its label and feature hashes."""
    for batch in batches:
        ys, out = batch.column("y"), []
        for lo, data, at in blocks(batch.column("text")):
            _, _, row, f = token_features(data, at)
            cut = np.searchsorted(row, np.arange(len(at)))
            f = f.astype(np.uint32)  # buckets and odds need no more bits
            out += [(ys[lo + i].as_py(), f[cut[i] : cut[i + 1]].tobytes()) for i in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["y", "f"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, **training) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents, up to max_rows and max_bytes of each class; learn is a condition on the column id, training as in fit_field."""
    small_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    sample = bounded_sample(docs, labels, label, learn, id_col, text_col, max_rows, max_bytes, True)
    rows = sample.mapInArrow(tidy(_tokens), "y int, f binary").collect()
    rows = list({(r.y, r.f): r for r in sorted(rows, key=lambda r: (r.y, r.f))}.values())
    ys, feats = np.array([r.y for r in rows], np.int64), [np.frombuffer(r.f, np.uint32).reshape(-1, WIDTH) for r in rows]
    del rows
    model = fit_field(feats, ys, **training)
    give_back()
    return model


def fit_field(feats: list[np.ndarray], ys: np.ndarray, *, buckets: int = 1 << 18, turns: int = 8, epochs: int = 1, least_steps: int = 40, rate: float = 0.2, noise: float = 0.05, min_docs: int = 2, sharpness: float = 2.0, missed: float = 6.0, seed: int = 11) -> ToxicityModel:
    """The field of documents, each as its tokens' features, and their labels, by expectation maximisation over the tags; feats is used up."""
    if not len(ys) or ys.min() == ys.max() or not sum(map(len, feats)):
        return ToxicityModel(np.zeros(buckets, np.float32), np.zeros((2, 2)), -30.0)
    lens = np.array([len(f) for f in feats])
    spans = sum(-(-n // SPAN) for n in lens)
    odds = document_odds(feats, ys, min_docs)
    if not np.isfinite(odds).any():
        return ToxicityModel(np.zeros(buckets, np.float32), np.zeros((2, 2)), -30.0)
    for i, f in enumerate(feats):
        feats[i] = np.where(np.isfinite(odds[_odds_bits(f)]), f, f.dtype.type(0))
    model = ToxicityModel(np.zeros(buckets, np.float32), np.zeros((2, 2)), -float(np.log(max(2.0, lens[ys == 1].mean()))))
    tags, pairs = soft_start(feats, ys, odds, sharpness)
    for turn in range(turns):
        model = _train(feats, tags, pairs, model, max(epochs, -(-least_steps * 64 // spans)), rate, seed + turn)
        tags, pairs = expected(model, feats, ys, noise) if turn + 1 < turns else ([], [])
    row = np.repeat(np.arange(len(feats)), lens)
    p = np.concatenate([model.marginals(f, np.zeros(len(f), np.int64)) for f in feats])
    odds, count, any_ = summary(row, p, model.step, len(feats))
    model.link = _logistic(np.stack([odds, count], 1)[any_], ys[any_], missed)
    return model


def document_odds(feats: list[np.ndarray], ys: np.ndarray, min_docs: int) -> np.ndarray:
    """By the last ODDS_BITS bits of a feature, the smoothed log-odds of toxic documents against clean ones to have it; -inf for features of fewer than min_docs documents.

    A feature that fewer documents have could only tell these documents apart, so training leaves it out.
    """
    counts = np.zeros((2, 1 << ODDS_BITS), np.uint16)
    for f, y in zip(feats, ys, strict=True):
        own = np.sort(_odds_bits(f[f != 0]))
        counts[y, own[np.append(True, own[1:] != own[:-1])] if len(own) else own] += 1
    held = np.flatnonzero(counts[0] + counts[1] >= min_docs)
    good, bad = counts[:, held].astype(float)
    out = np.full(1 << ODDS_BITS, -np.inf, np.float32)
    out[held] = np.log((bad + 0.5) / (ys.sum() + 1)) - np.log((good + 0.5) / (len(ys) - ys.sum() + 1))
    return out


def _odds_bits(f: np.ndarray) -> np.ndarray:
    return (f & f.dtype.type((1 << ODDS_BITS) - 1)).astype(np.int32)


def soft_start(feats: list[np.ndarray], ys: np.ndarray, odds: np.ndarray, sharpness: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tags and pairs to begin with: a toxic document has one toxic token, its tokens by their own best feature's odds; where all are alike each is as likely."""
    tags, pairs = [], []
    for f, y in zip(feats, ys, strict=True):
        q = np.zeros(len(f))
        if y and len(f):
            best = np.maximum(np.where(f != 0, odds[_odds_bits(f)], -1.0).max(1), -1.0)
            q = np.exp(sharpness * (best - best.max()))
            q /= q.sum()
        a, b = q[:-1], q[1:]
        tags.append(q)
        pairs.append(np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b], 1).reshape(-1, 2, 2).astype(np.float32))
    return tags, pairs


def log_none(p: np.ndarray, row: np.ndarray, step: np.ndarray, n: int) -> np.ndarray:
    """Of each document, the log of the chain's probability that no token is toxic: the first token's, then each one's after a clean one."""
    if not len(p):
        return np.zeros(n)
    clean = np.log1p(-np.minimum(p, 1 - 1e-12))
    after = np.empty(len(p))
    after[0] = clean[0]
    after[1:] = np.where(row[1:] == row[:-1], np.log(np.maximum(_pairs(p, step)[:, 0, 0], 1e-300)) - clean[:-1], clean[1:])
    return np.bincount(row, np.minimum(after, 0), minlength=n)


def expected(model: ToxicityModel, feats: list[np.ndarray], ys: np.ndarray, noise: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tags and pairs of tags of each document, expected by the field given its label.

    A clean document has no toxic token. A toxic one has one at least, so its marginals are divided by the probability of that;
    noise is the share of documents without a toxic token that are labelled toxic, and leaves such a document as it is read.
    """
    tags, pairs = [], []
    for f, y in zip(feats, ys, strict=True):
        zero = np.zeros(len(f), np.int64)
        if not y or not len(f):
            none = np.zeros((max(0, len(f) - 1), 2, 2), np.float32)
            none[:, 0, 0] = 1
            tags.append(np.zeros(len(f)))
            pairs.append(none)
            continue
        p = model.marginals(f, zero)
        clean = np.exp(log_none(p, zero, model.step, 1)[0])
        scale = 1 / (1 - clean + noise * clean)
        own = _pairs(p, model.step) * scale
        tags.append(np.minimum(p * scale, 1.0))
        own[:, 0, 0] = np.maximum(0, 1 - own[:, 0, 1] - own[:, 1, 0] - own[:, 1, 1])
        pairs.append(own.astype(np.float32))
    return tags, pairs


def _gradients(f: np.ndarray, y: np.ndarray, seen: np.ndarray, row: np.ndarray, w: np.ndarray, step: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Buckets and their gradients, and those of the transitions and the bias: what is expected given the labels less what the field expects.

    y are the tags of the tokens of features f, from 0 to 1; seen the sum of their pairs.
    """
    bucket, on = (f & f.dtype.type(len(w) - 1)).astype(np.int32), f != 0
    p = chain((w[bucket] * on).sum(1) + first, row, step)
    diff = y - p
    used, place = np.unique(bucket[on], return_inverse=True)
    grad = np.bincount(place, np.repeat(diff[:, None], WIDTH, 1)[on], minlength=len(used))
    return used, grad, seen - _pairs(p, step)[row[1:] == row[:-1]].sum(0), diff.sum()


def _train(feats: list[np.ndarray], tags: list[np.ndarray], pairs: list[np.ndarray], model: ToxicityModel, epochs: int, rate: float, seed: int) -> ToxicityModel:
    """Adagrad on spans of SPAN tokens, 64 at a time, from the weights of model."""
    rng = np.random.default_rng(seed)
    spans = [(i, lo) for i, f in enumerate(feats) for lo in range(0, len(f), SPAN)]
    w, step, first = model.weights.astype(float), model.step.copy(), model.first
    g2, step2, first2 = np.full(len(w), 1e-2), np.full((2, 2), 1.0), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for lo in range(0, len(order), 64):
            part = [spans[i] for i in order[lo : lo + 64]]
            f = np.concatenate([feats[i][a : a + SPAN] for i, a in part])
            y = np.concatenate([tags[i][a : a + SPAN] for i, a in part])
            row = np.repeat(np.arange(len(part)), [min(SPAN, len(feats[i]) - a) for i, a in part])
            seen = np.sum([pairs[i][a : a + SPAN - 1].sum(0) for i, a in part], 0)
            used, grad, turn, bias = _gradients(f, y, seen, row, w, step, first)
            grad -= 1e-4 * w[used]
            g2[used] += grad**2
            w[used] += rate * grad / np.sqrt(g2[used])
            d = turn / 64 - 1e-3 * step
            step2 += d**2
            step += rate * d / np.sqrt(step2)
            d = bias / 64
            first2 += d**2
            first += rate * d / np.sqrt(first2)
    return ToxicityModel(w.astype(np.float32), step, float(first))


def _pairs(p: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Expected pairs of tags at each pair of neighbours, of the marginals p: the joint that has both marginals and the field's odds ratio.

    In a chain of two tags the joint of neighbours is fixed by its marginals and the cross ratio of the transition.
    """
    a, b = p[:-1], p[1:]
    r = np.exp(step[0, 0] + step[1, 1] - step[0, 1] - step[1, 0])
    if abs(r - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (a + b) * (r - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * r * (r - 1) * a * b, 0))) / (2 * (r - 1))
    both = np.clip(both, np.maximum(0, a + b - 1), np.minimum(a, b))
    return np.stack([1 - a - b + both, b - both, a - both, both], 1).reshape(-1, 2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, missed: float) -> np.ndarray:
    """Newton's method with a small ridge; the toxic class weighs missed times the clean one, as the field knows training documents better than others."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    weigh = np.where(y == 1, 0.5 * missed / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.3, 0.3])
        move = np.linalg.solve(h, x.T @ (weigh * (y - p)) - np.array([1e-3, 0.3, 0.3]) * beta)
        beta += move
        if np.abs(move).max() < 1e-6:
            break
    return beta


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, token_threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted, spans) of every whole text; spans are the offsets, in code points, of tokens whose marginal is token_threshold or more, neighbours joined, with the largest marginal. In a text that is predicted toxic, half the marginal of its likeliest token suffices: tokens that always stand together share out what one of them explains."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            score, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, starts, ends, row, p, at, data, n in held.value.tagged(batch.column(1)):
                score[lo : lo + n] = held.value.link_of(*summary(row, p, held.value.step, n))
                top = np.zeros(n)
                np.maximum.at(top, row, p)
                least = np.where(score[lo : lo + n] >= threshold, np.minimum(token_threshold, top / 2), token_threshold)
                toxic = p >= least[row]
                hot = np.flatnonzero(toxic)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(hot) else None
                for i in hot:
                    base = lead[at[row[i]]]
                    a, b, own = int(lead[starts[i]] - base), int(lead[ends[i]] - base), spans[lo + row[i]]
                    if own and i and row[i - 1] == row[i] and toxic[i - 1]:
                        own[-1] = {"begin": own[-1]["begin"], "end": b, "p": max(own[-1]["p"], float(p[i]))}
                    else:
                        own.append({"begin": a, "end": b, "p": float(p[i])})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], [id_col, "score", "predicted", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {id_kind}, score double, predicted int, spans array<struct<begin:int,end:int,p:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below threshold."""
    small_batches(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(held.value.scores(b.column(at)) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
