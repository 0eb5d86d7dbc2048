"""LM scoring: a class bigram model whose classes come from exchange clustering.

Words are lower-cased A-Z runs of non-space bytes; each text ends with an end token. The counts of all words are gathered
over the whole corpus, by 64-bit hash. Classes are found in two steps:

1. The `items` most frequent words, 256 groups of the other words (by their last two bytes) and the end token are clustered
   on the driver: exchange clustering moves one of them at a time to the class that raises the likelihood of their bigrams
   most, until a pass moves none or `passes` are over. The other words begin in the class of their group.
2. Then every word of the head is exchanged by itself, `rounds` times: the counts of (word, class before) and (word, class
   after) are gathered by word in a shuffle, and each word goes to the class that raises the likelihood most with all others
   as they are, its two sides counted apart. Half of the words may move in a round, as they move at the same time; what is
   kept is the classes of the round with the greatest likelihood. The rounds read the texts as item numbers, written once.

Words outside the head stay in their group's class. Then

    P(word | word before) = P(class | class before) * P(word | class)
    P(class | before)     = (n(before, class) + k P(class)) / (n(before) + k)
    P(word | class)       = (c(word) + d) / (N(class) + d (V(class) + 1))

where the one more word of a class stands for all that training has not seen. What is broadcast has a proven bound: a
word is in the head if it makes up 1 / HEAD of all tokens or more, so the head has at most HEAD words; the item bigrams
that reach the driver are at most (items + 257) squared, and the moves of a round one row a word of the head. Counts of all other words meet the documents in a shuffled join;
no word of it makes up 1 / HEAD of the rows.

Cases: a null or empty text has the end token only; rows keep their number, repeated ids too; without training text all
counts are 0. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, blocks, borders, forget, materialize, mix, small_batches, sums_by, tidy, word_hashes

HEAD = 4_000_000
GROUPS = 256
END = 0x1F2E3D4C5B6A7988  # the end token's hash
#: Distinct words that a task gathers before it hands them on.
GATHER = 500_000
#: Counts of a word and a class up to which the gains are looked up.
SMALL = 64


def tokens_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and suffix group of each word of a block."""
    starts, ends = borders(data, at, NOT_SPACE)
    row = np.searchsorted(at, starts, "right") - 1
    if not len(starts):
        return row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = word_hashes(data, starts, ends, True).view(np.int64)
    last = LOWER[data[ends - 1]].astype(np.int64)
    before = np.where(ends - starts > 1, LOWER[data[ends - 2]], 0).astype(np.int64)
    return row, word, (last * 31 + before * 131) % GROUPS


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, s, c): hash, suffix group and count of each token, the end token included."""
    small_batches(docs.sparkSession)

    def packed(h, s, c):
        order = np.argsort(h, kind="stable")
        h, s, c = h[order], s[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], s[first], np.add.reduceat(c, first) if len(h) else c

    def run(batches):
        parts, size, ends = [], 0, 0
        for batch in batches:
            ends += batch.num_rows
            for _, data, at in blocks(batch.column(0)):
                _, h, s = tokens_of(data, at)
                parts.append(packed(h, s, np.ones(len(h), np.int64)))
                size += len(parts[-1][0])
            if size > 2 * GATHER:
                parts = [packed(*map(np.concatenate, zip(*parts, strict=True)))]
                size = len(parts[0][0])
                if size > GATHER:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["h", "s", "c"])
                    parts, size = [], 0
        parts.append((np.array([END]), np.array([0]), np.array([ends])))
        h, s, c = packed(*map(np.concatenate, zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x[c > 0]) for x in (h, s, c)], ["h", "s", "c"])

    return docs.select(F.col(text_col)).mapInArrow(tidy(run), "h long, s long, c long").groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))


def sequences(docs: DataFrame, text_col: str, words: np.ndarray) -> DataFrame:
    """(seq): the items of many texts as 32-bit numbers: places in the sorted words, then suffix groups, then the end token, which also opens the first."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = held.value
        end = len(words) + GROUPS
        for batch in batches:
            out = []
            for _, data, at in blocks(batch.column(0)):
                row, h, s = tokens_of(data, at)
                seq = np.full(len(h) + len(at), end, np.int32)
                seq[1 + np.arange(len(h)) + row] = items_of(h, s, words)
                out.append(seq.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["seq"])

    return docs.select(F.col(text_col)).mapInArrow(tidy(run), "seq binary")


def bigrams_of(seqs: DataFrame, kind: np.ndarray, kinds: int) -> np.ndarray:
    """Counts of neighbouring kinds over all sequences, where kind is that of each item; at most kinds squared rows reach the driver."""
    small_batches(seqs.sparkSession)
    held = seqs.sparkSession.sparkContext.broadcast(kind)

    def run(batches):
        kind, total = held.value, np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            for x in batch.column(0):
                own = kind[np.frombuffer(x.as_buffer(), np.int32)].astype(np.int64)
                pair, times = np.unique(own[:-1] * kinds + own[1:], return_counts=True)
                total[pair] += times
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["p", "c"])

    rows = seqs.mapInArrow(tidy(run), "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(kinds * kinds)
    out[rows.column("p").to_numpy()] = rows.column("c").to_numpy()
    return out.reshape(kinds, kinds)


def items_of(h: np.ndarray, s: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Items by place in the sorted head, or by suffix group."""
    at, hit = find(h, head)
    return np.where(hit, at, len(head) + s)


def find(h: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(head):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    return at, head[at] == h


def _xlx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """The class of each item; the last item, the end token, is alone in class 0."""
    m = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    order = order[order != m - 1]
    own = np.zeros(m, np.int64)
    own[order] = 1 + np.arange(m - 1) % (classes - 1)
    hot = np.zeros((m, classes))
    hot[np.arange(m), own] = 1
    n = hot.T @ bigrams @ hot
    for _ in range(passes):
        moved = 0
        for w in order:
            a, self_ = own[w], bigrams[w, w]
            right = np.bincount(own, bigrams[w], minlength=classes)
            left = np.bincount(own, bigrams[:, w], minlength=classes)
            if not right.sum() + left.sum():
                continue
            right[a] -= self_
            left[a] -= self_
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= self_
            old, diag = _xlx(n), np.arange(classes)
            gain = (_xlx(n + right) - old).sum(1) - (_xlx(np.diag(n) + right) - old[diag, diag])
            gain += (_xlx(n + left[:, None]) - old).sum(0) - (_xlx(np.diag(n) + left) - old[diag, diag])
            gain += _xlx(np.diag(n) + right + left + self_) - old[diag, diag]
            rows, cols = n.sum(1), n.sum(0)
            gain -= _xlx(rows + right.sum() + self_) - _xlx(rows) + _xlx(cols + left.sum() + self_) - _xlx(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            own[w] = b
            n[b] += right
            n[:, b] += left
            n[b, b] += self_
        if not moved:
            break
    return own


def class_counts(seqs: DataFrame, own: np.ndarray, turning: np.ndarray, classes: int) -> DataFrame:
    """(w, k, c), to be summed: how often the class k follows word w, or with k - classes stands before it, for the words that are turning."""
    small_batches(seqs.sparkSession)
    held = seqs.sparkSession.sparkContext.broadcast((own, turning))
    span = 2 * classes

    def packed(p, c):
        order = np.argsort(p, kind="stable")
        p, c = p[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        return p[first], np.add.reduceat(c, first) if len(p) else c

    def rows_of(p, c):
        return pa.RecordBatch.from_arrays([pa.array(p // span), pa.array((p % span).astype(np.int32)), pa.array(c)], ["w", "k", "c"])

    def run(batches):
        own, turning = held.value
        parts, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                seq = np.frombuffer(x.as_buffer(), np.int32)
                cls, on, seq = own[seq].astype(np.int64), turning[seq], seq.astype(np.int64)
                pair = np.concatenate([(seq[:-1] * span + cls[1:])[on[:-1]], (seq[1:] * span + classes + cls[:-1])[on[1:]]])
                parts.append(packed(pair, np.ones(len(pair), np.int64)))
                size += len(parts[-1][0])
            if size > 2 * GATHER:
                parts = [packed(*map(np.concatenate, zip(*parts, strict=True)))]
                size = len(parts[0][0])
                if size > GATHER:
                    yield rows_of(*parts[0])
                    parts, size = [], 0
        if parts:
            yield rows_of(*packed(*map(np.concatenate, zip(*parts, strict=True))))

    return seqs.mapInArrow(tidy(run), "w long, k int, c long")


def likelihood(n: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    return float(_xlx(n).sum() - _xlx(n.sum(1)).sum() - _xlx(n.sum(0)).sum())


def gains_of(n: np.ndarray) -> np.ndarray:
    """(2, SMALL + 1, classes, classes): by side, count and other class, what the likelihood gains in each class that takes the count; side 1 is for classes that follow."""
    out = np.empty((2, SMALL + 1, *n.shape))
    for c in range(SMALL + 1):
        gain = _xlx(n + c) - _xlx(n)
        out[1, c], out[0, c] = gain.T, gain
    return out


def best_classes(w: np.ndarray, k: np.ndarray, c: np.ndarray, own: np.ndarray, n: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of w, which is sorted, and the class of each that raises the likelihood most, with all other words as they are."""
    classes = len(n)
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    word, a, after, other = w[first], own[w].astype(np.int64), k < classes, k % classes
    sides = np.stack([n, n.T])  # by side: other class, then the word's
    size = np.diff(np.append(first, len(w)))
    gain = np.empty((len(word), classes))
    cut = 0
    # A word has at most two rows a class, so a step has a bounded number of rows.
    for lo in range(0, len(word), 256):
        top = cut + size[lo : lo + 256].sum()
        r = slice(cut, top)
        side, times, cls, mine = after[r].astype(np.int64), c[r], other[r], a[r]
        each = gains[side, np.minimum(times, SMALL), cls]
        big = np.flatnonzero(times > SMALL)
        there = sides[side[big], cls[big]]
        each[big] = _xlx(there + times[big, None]) - _xlx(there)
        at = np.arange(len(times))
        rest = np.maximum(sides[side, cls, mine] - times, 0)  # its own class without it
        each[at, mine] = _xlx(rest + times) - _xlx(rest)
        gain[lo : lo + 256] = np.add.reduceat(each, first[lo : lo + 256] - cut, axis=0)
        cut = top
    to = np.arange(classes)
    for side, total in ((after, n.sum(1)), (~after, n.sum(0))):
        t = np.add.reduceat(np.where(side, c, 0).astype(float), first)[:, None]
        rest = np.maximum(total[None, :] - np.where(to[None, :] == own[word][:, None], t, 0), 0)
        gain -= _xlx(rest + t) - _xlx(rest)
    gain[:, 0] = -np.inf
    best, now = gain.argmax(1), own[word]
    at = np.arange(len(word))
    return word, np.where(gain[at, best] > gain[at, now] + 1e-9, best, now)


def exchange_words(seqs: DataFrame, words: np.ndarray, own: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each item after the rounds, and the counts of neighbouring classes."""
    best, still = None, 0
    spark = seqs.sparkSession
    for turn in range(rounds + 1):
        n = bigrams_of(seqs, own, classes)
        if best is None or likelihood(n) > best[0]:
            best = likelihood(n), own, n
        if turn == rounds or still == 2:
            break
        held = spark.sparkContext.broadcast((own, n))
        turning = np.zeros(len(own), bool)
        turning[: len(words)] = (words >> 7) & 1 == turn % 2

        def run(batches, held=held):
            own, n = held.value
            gains, kept = gains_of(n), []
            for batch in batches:
                rows = [np.concatenate(x) for x in zip(*kept, [batch.column(x).to_numpy() for x in range(3)], strict=True)]
                # The last word may go on in the next batch.
                end = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
                kept = [[x[end:] for x in rows]]
                if end:
                    yield moves(*(x[:end] for x in rows), own, n, gains)
            if kept and len(kept[0][0]):
                yield moves(*kept[0], own, n, gains)

        def moves(w, k, c, own, n, gains):
            word, to = best_classes(w, k, c, own, n, gains)
            moved = to != own[word]
            return pa.RecordBatch.from_arrays([pa.array(word[moved]), pa.array(to[moved].astype(np.int32))], ["w", "b"])

        # Tasks have summed what they hand on, so it is shuffled by word at once, and summed and sorted where it arrives.
        dealt = class_counts(seqs, own, turning, classes).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w")
        moved = dealt.groupBy("w", "k").agg(F.sum("c").alias("c")).sortWithinPartitions("w").mapInArrow(tidy(run), "w long, b int").toArrow()
        own = own.copy()
        own[moved.column("w").to_numpy()] = moved.column("b").to_numpy()
        still = 0 if len(moved) else still + 1
    return best[1:]


@dataclass
class ClassModel:
    """What the scoring pass needs of a model, without the counts of words outside the head."""

    items: np.ndarray  # sorted hashes of the clustered words
    own: np.ndarray  # class of each item
    step: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of each class's denominator
    head: np.ndarray  # sorted hashes of frequent words
    head_counts: np.ndarray
    end_count: int
    total: int
    words: int
    add: float


def fit_class_lm(docs: DataFrame, learn: Column, *, text_col: str = "text", items: int = 1000, classes: int = 64, passes: int = 4, add: float = 0.4, pull: float = 50.0, head: int = HEAD, rounds: int = 4) -> tuple[ClassModel, DataFrame]:
    """The model, and the table (h, c) of the counts of all words outside the head."""
    train = docs.where(learn)
    counts = materialize(word_counts(train, text_col))
    words, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    least = max(1, -(-total // head))
    end = counts.where(F.col("h") == END).select("c").first()
    top = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(items).select("h", "s").collect()
    seeds = np.sort(np.array([r.h for r in top], np.int64))
    table = counts.where((F.col("c") >= least) & (F.col("h") != END)).select("h", "s", "c").toArrow()
    h, s, c = (table.column(x).to_numpy() for x in ("h", "s", "c"))
    order = np.argsort(h)
    h, s, c = h[order], s[order], c[order]
    # The words to exchange: the head, and the seeds where it lacks any.
    lone = [r for r in top if not find(np.array([r.h]), h)[1][0]]
    clustered, group = h, s
    if lone:
        clustered, group = np.append(h, [r.h for r in lone]), np.append(s, [r.s for r in lone])
        order = np.argsort(clustered)
        clustered, group = clustered[order], group[order]
    seqs = materialize(sequences(train, text_col, clustered))
    seed = np.concatenate([items_of(clustered, group, seeds), len(seeds) + np.arange(GROUPS + 1)]).astype(np.int32)
    seed_class = exchange(bigrams_of(seqs, seed, len(seeds) + GROUPS + 1), classes, passes)
    own, pairs = exchange_words(seqs, clustered, seed_class[seed].astype(np.int16), classes, rounds)
    forget(seqs)
    seen = pairs.sum(0)  # tokens of each class: each follows something once
    distinct = np.ones(len(own))
    distinct[len(clustered) : -1] = 0
    for r in counts.where(F.col("h") != END).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect():
        distinct[len(clustered) + r.s] = r.n
    distinct[len(clustered) : -1] -= np.bincount(group, minlength=GROUPS)
    kinds = np.bincount(own, distinct, minlength=classes)
    prior = (seen + 1) / (seen.sum() + classes)
    step = np.log10((pairs + pull * prior) / (pairs.sum(1, keepdims=True) + pull))
    model = ClassModel(clustered, own, step, np.log10(seen + add * (kinds + 1)), h, c, end.c if end else 0, int(total), int(words), add)
    tail = counts.where(F.col("c") < least).select("h", "c")
    return model, tail


def score_class_lm(docs: DataFrame, model: ClassModel, tail: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row; scores are log10 probabilities of whole texts."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["h", "uid", "m", "id", "held_out", "n_tokens", "n_known", "base", "score"]
    types = [pa.int64()] * 3 + [None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        model, at_row = held.value, TaskContext.get().partitionId() << 36
        denominator = np.log10(model.total + model.words + 1)
        end = len(model.own) - 1
        for batch in batches:
            for lo, data, at in blocks(batch.column(2)):
                n = len(at) - 1
                row, h, s = tokens_of(data, at)
                count = np.bincount(row, minlength=n)
                seq = np.full(len(h) + n + 1, end)
                place, hit = find(h, model.items)
                seq[1 + np.arange(len(h)) + row] = np.where(hit, place, len(model.items) + s)
                cls = model.own[seq]
                each = model.step[cls[:-1], cls[1:]] - model.spread[cls[1:]]
                if model.head is not model.items:
                    place, hit = find(h, model.head)
                c = np.where(hit, model.head_counts[place], 0) if len(model.head) else np.zeros(len(h), np.int64)
                known = sums_by(hit, count)
                base = sums_by(np.where(hit, np.log10(c + 1), 0), count) + np.log10(model.end_count + 1) - (count + 1) * denominator
                score = sums_by(each, count + 1) + sums_by(np.where(hit, np.log10(c + model.add), 0), count) + np.log10(model.end_count + model.add)
                uid = at_row + np.arange(n)
                at_row += n
                ids = batch.column(0).slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(uid.view(np.uint64)).view(np.int64)), pa.array(uid), pa.nulls(n, pa.int64()), ids, batch.column(1).slice(lo, n), pa.array(count + 1), pa.array(known.astype(np.int64) + (model.end_count > 0)), pa.array(base), pa.array(score)], names)
                rest = ~hit
                if rest.any():
                    r, t = row[rest], h[rest]
                    order = np.lexsort((t, r))
                    r, t = r[order], t[order]
                    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])]))
                    times = np.diff(np.append(first, len(r)))
                    k = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(uid[r[first]]), pa.array(times), pa.nulls(k, ids.type), *(pa.nulls(k, x) for x in types[4:])], names)

    each = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"h long, uid long, m long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    both = each.join(tail.hint("shuffle_hash"), "h", "left")
    c, m = F.coalesce("c", F.lit(0)), F.col("m")
    both = both.select("uid", "id", "held_out", "n_tokens", F.coalesce("n_known", F.when(c > 0, m), F.lit(0)).alias("n_known"), F.coalesce("base", m * F.log10(c + 1)).alias("base"), F.coalesce("score", m * F.log10(c + model.add)).alias("score"))
    out = both.groupBy("uid").agg(F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
