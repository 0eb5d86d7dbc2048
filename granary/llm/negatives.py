"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels within a band of scores.

A score is the exact integer inner product with the anchor. The rows stay where they are and the anchors, in slices of bounded
bytes, are broadcast to them. A task takes its rows in blocks: it sorts each anchor's scores of a block by score and id, finds
each positive's upper limit by binary search, and reads the first k entries of another label from there to the lower limit.
Of these it keeps the first k so far for each anchor and positive; the first k over all tasks are the result. So every row is
compared with every anchor, no row is shuffled, and a task holds one block, one slice and k entries for each pair of the slice,
however many rows share a label or a vector. Positives come the same way from a pass before, as the first rows of the label.

The number of tasks of a pass is that of the cluster's cores, or one for each 128 MB of vectors if that is more, as every task
gives up to k rows for each pair.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part, whether as anchors, positives or
negatives; a vector is compared with those of its length only; a null id can't be an anchor, comes last among equal scores and
is given as null; rows that repeat an id are rows of their own, so each of them is an anchor and may be the other's positive,
and the ranks of a pair then repeat; an anchor without other rows of its label gives nothing; a positive without rows in its
band gives nothing; with a negative positive score the band is empty; scores beyond 64 bits count as the largest or smallest
long; an empty table gives an empty one. Columns other than id, label and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, regrouped, tidy
from .integers import finite, inner_products, matrices, whole_components

#: Rows of a block, and bytes of anchors that are broadcast at once.
BLOCK_ROWS, SLICE_BYTES = 8192, 8 << 20
#: Anchors whose scores of a block are held at once.
AT_ONCE = 64
#: Stands for a null id; as the largest number it comes last.
NO_ID = (1 << 63) - 1


def usable(rows: DataFrame, scale: int, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part; row is a number of its own for each."""
    vector = F.col(vec_col).cast("array<double>")
    own = rows.where(F.col(label_col).isNotNull() & finite(vector))
    return materialize(own.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole_components(vector, scale).alias("v")))


def leading(group: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each group, by score from the largest and by id."""
    by = np.lexsort((vec, -score, group))
    group, score, vec = group[by], score[by], vec[by]
    keep = np.arange(len(group)) - np.searchsorted(group, group) < k
    return group[keep], score[keep], vec[keep]


def upper(positive: np.ndarray, percent: int) -> np.ndarray:
    """The largest score n with 100 * n <= percent * positive, without leaving 64 bits."""
    return positive // 100 * percent + positive % 100 * percent // 100


def lower(positive: np.ndarray, percent: int) -> np.ndarray:
    """The smallest score n with percent * positive <= 100 * n."""
    return positive // 100 * percent - (-(positive % 100 * percent) // 100)


class Slice:
    """Some anchors of one length, and their positives: pair p belongs to anchor owner[p], and each anchor's pairs are neighbours."""

    def __init__(self, row, vec_id, label, x, owner=(), positive_id=(), positive_score=(), band=(0, 0)):
        self.row, self.vec_id, self.label, self.x = row, vec_id, label, x
        self.owner, self.positive_id, self.positive_score = (np.array(c, np.int64) for c in (owner, positive_id, positive_score))
        self.least, self.most = lower(self.positive_score, band[0]), upper(self.positive_score, band[1])

    def sorted_scores(self, vec_id: np.ndarray, x: np.ndarray):
        """(anchor, its scores, places of the rows by score and id) for each anchor; vec_id ascends."""
        for lo in range(0, len(self.row), AT_ONCE):
            scores = inner_products(self.x[lo : lo + AT_ONCE], x)
            by = np.argsort(-scores, axis=1, kind="stable")
            for i in range(len(scores)):
                yield lo + i, scores[i], by[i]

    def positives(self, row, vec_id, label, x, k: int):
        """(anchor, score, id) of each anchor's first k other rows of its label."""
        out = []
        for a, score, by in self.sorted_scores(vec_id, x):
            at = by[(label[by] == self.label[a]) & (row[by] != self.row[a])][:k]
            out.append((np.full(len(at), a), score[at], vec_id[at]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def negatives(self, row, vec_id, label, x, k: int):
        """(pair, score, id) of each pair's first k rows of other labels within its band."""
        pair, scores, ids = [], [], []
        first = np.searchsorted(self.owner, np.arange(len(self.row) + 1))
        for a, score, by in self.sorted_scores(vec_id, x):
            at = by[label[by] != self.label[a]]
            falling = -score[at]
            pairs = np.arange(first[a], first[a + 1])
            lo = np.searchsorted(falling, -self.most[pairs], "left")
            hi = np.minimum(np.searchsorted(falling, -self.least[pairs], "right"), lo + k)
            for p, i, j in zip(pairs, lo, hi, strict=True):
                if i < j:
                    pair.append(np.full(j - i, p))
                    scores.append(score[at[i:j]])
                    ids.append(vec_id[at[i:j]])
        none = np.zeros(0, np.int64)
        return [np.concatenate([none, *c]) for c in (pair, scores, ids)]


def _pass(rows: DataFrame, held, labels, step: str, k: int, schema: str) -> DataFrame:
    """One pass of all rows by the slices of anchors that are broadcast, by length; label names are broadcast as their codes."""

    def run(batches):
        best: dict[int, tuple] = {}
        for t in regrouped(batches, BLOCK_ROWS):
            row, vec_id = t.column("row").to_numpy(), t.column("vec_id").to_numpy()
            label = np.array([labels.value.get(x, -1) for x in t.column("label").to_pylist()], np.int64)
            for d, (at, x) in matrices(t.column("v")).items():
                if d in held.value:
                    by = np.argsort(vec_id[at], kind="stable")
                    own = at[by]
                    found = getattr(held.value[d], step)(row[own], vec_id[own], label[own], x[by], k)
                    best[d] = leading(*(np.concatenate(c) for c in zip(best[d], found, strict=True)), k) if d in best else found
        for d, (group, score, vec) in best.items():
            s = held.value[d]
            if step == "positives":
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.row[group], s.vec_id[group], vec, score)], ["row", "anchor_id", "positive_id", "positive_score"])
            else:
                a = s.owner[group]
                place = group - np.searchsorted(s.owner, a)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.row[a], place, s.vec_id[a], s.positive_id[group], vec, s.positive_score[group], score)], ["row", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return rows.mapInArrow(tidy(run), schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on vec_id. Components count as floor(scale * x). An anchor's positives are its first rows of the
    same label; a negative of another label scores band[0] to band[1] per cent of the positive, both ends included.
    """
    spark = rows.sparkSession
    own = usable(rows, scale, id_col, label_col, vec_col)
    size = own.agg(F.sum(8.0 * F.size("v"))).first()[0] or 0
    dealt = own.coalesce(max(spark.sparkContext.defaultParallelism, int(size) >> 27))
    asks = own.where(F.col("vec_id") != NO_ID).where(is_anchor)
    slices = max(1, -(-int(asks.agg(F.sum(8.0 * F.size("v") + 64)).first()[0] or 0) // slice_bytes))
    tables, spent = [], []
    for part in range(slices):
        asked = asks.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == part).orderBy("row").toArrow()
        if not asked.num_rows:
            continue
        row, vec_id, named = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy(), asked.column("label").to_pylist()
        codes = {x: i for i, x in enumerate(sorted(set(named)))}
        label, by_length, labels = np.array([codes[x] for x in named]), matrices(asked.column("v")), spark.sparkContext.broadcast(codes)
        held = spark.sparkContext.broadcast({d: Slice(row[at], vec_id[at], label[at], x) for d, (at, x) in by_length.items()})
        near = materialize(_pass(dealt, held, labels, "positives", positives, "row long, anchor_id long, positive_id long, positive_score long"))
        first = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
        pairs = near.withColumn("place", first).where(F.col("place") <= positives).orderBy("row", "place").toArrow()
        owner = np.searchsorted(row, pairs.column("row").to_numpy())
        length = np.zeros(len(row), np.int64)
        spot = np.zeros(len(row), np.int64)
        for d, (at, _) in by_length.items():
            length[at], spot[at] = d, np.arange(len(at))
        made = {}
        for d, (at, x) in by_length.items():
            mine = np.flatnonzero(length[owner] == d)
            made[d] = Slice(row[at], vec_id[at], label[at], x, spot[owner[mine]], pairs.column("positive_id").to_numpy()[mine], pairs.column("positive_score").to_numpy()[mine], band)
        again = spark.sparkContext.broadcast(made)
        tables.append(materialize(_pass(dealt, again, labels, "negatives", negatives, "row long, place long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")))
        spent.append(near)
    forget(*spent)
    if not tables:
        none = own.select("row", F.lit(0).cast("long").alias("place"), *[F.col("vec_id").alias(c) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])
        tables = [none.where("false")]
    else:
        forget(own)
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")
