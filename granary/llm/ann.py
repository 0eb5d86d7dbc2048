"""Approximate nearest neighbours for the largest inner product: score-aware quantisation, four-bit table scans, exact reranking.

A vector is cut into pairs of components, each coded as one of 16 centres. Codebooks and codes minimise a loss in which
the part of the residual along the vector weighs eta times the part across it, as that part is what changes large inner
products; eta = (d - 1) t^2 / (1 - t^2) for a threshold t on the cosine. As the parallel part couples all pairs, codes
are chosen by coordinate descent over the pairs, and centres are weighted least squares.

Every row is coded once, and the coded rows stay where they are: the queries, in slices of bounded bytes, are broadcast to
them. A task scans the codes of one batch of rows after the other with the queries' lookup tables (two codes in each byte),
takes the `shortlist` best distinct vectors of the batch, scores these exactly in double precision, and keeps each query's
best k so far; the best k of all tasks are the result. So each query sees all rows, no vector is shuffled, and a shortlist is
at most 1 / 25 of a full batch.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; a vector is only compared with
those of its length, and lengths that the sample for the codebooks lacks are scored exactly; rows with the same id are rows of
their own, so a query is left out of its own candidates by its row, and a repeated query id has its ranks repeated; a null id
can't be a query and comes last among equals; equal vectors share a code, and the smallest ids of them are listed first.
Columns other than id and vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, regrouped, tidy

CENTRES = 16
#: Rows, and bytes of their vectors, that the codebooks are fitted on at most.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 20_000, 64 << 20
#: Rows of a batch, and bytes of the queries that are broadcast at once.
BATCH_ROWS, SLICE_BYTES = 5000, 16 << 20
#: Stands for a null id; as the largest number it comes last.
NO_ID = (1 << 63) - 1


@dataclass
class Quantiser:
    """centres: (pairs, 16, 2)."""

    centres: np.ndarray
    eta: float

    def pairs(self, x: np.ndarray) -> np.ndarray:
        """(rows, pairs, 2), padded to a multiple of two pairs."""
        width = 2 * len(self.centres)
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(rows, pairs / 2) bytes of two codes each."""
        codes = _assign(self.pairs(x), self.centres, self.eta, sweeps, None)
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def scan(self, packed: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """(rows, queries) approximate inner products."""
        q = self.pairs(queries)
        table = np.einsum("mcd,qmd->mcq", self.centres, q).astype(np.float32)
        out = np.zeros((len(packed), len(queries)), np.float32)
        for b in range(packed.shape[1]):
            both = (table[2 * b][None, :, :] + table[2 * b + 1][:, None, :]).reshape(256, -1)
            out += both[packed[:, b]]
        return out


def _assign(x: np.ndarray, centres: np.ndarray, eta: float, sweeps: int, codes: np.ndarray | None) -> np.ndarray:
    n, m, _ = x.shape
    pull = (eta - 1) / np.maximum((x**2).sum((1, 2)), 1e-30)
    if codes is None:
        codes = np.stack([((x[:, j, None, :] - centres[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    along = np.stack([((x[:, j] - centres[j][codes[:, j]]) * x[:, j]).sum(1) for j in range(m)], 1)
    for _ in range(sweeps):
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            r = x[:, j, None, :] - centres[j]
            par = (r * x[:, j, None, :]).sum(2)
            codes[:, j] = ((r**2).sum(2) + pull[:, None] * (rest[:, None] + par) ** 2).argmin(1)
            along[:, j] = par[np.arange(n), codes[:, j]]
            total = rest + along[:, j]
    return codes


def train_quantiser(x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Quantiser:
    d = x.shape[1]
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    m = 2 * -(-d // 4)
    q = Quantiser(np.zeros((m, CENTRES, 2)), eta)
    p = q.pairs(x)
    rng = np.random.default_rng(seed)
    for j in range(m):
        q.centres[j] = p[rng.choice(len(p), CENTRES, replace=len(p) < CENTRES), j]
    codes = None
    pull = (eta - 1) / np.maximum((p**2).sum((1, 2)), 1e-30)
    for r in range(rounds):
        codes = _assign(p, q.centres, eta, 0 if r < 2 else 1, None if r < 2 else codes)
        along = np.stack([((p[:, j] - q.centres[j][codes[:, j]]) * p[:, j]).sum(1) for j in range(m)], 1)
        for j in range(m):
            xj, c = p[:, j], codes[:, j]
            k = pull if r >= 2 else np.zeros(len(p))
            rest = along.sum(1) - along[:, j]
            weight = k * (rest + (xj**2).sum(1))
            a = np.zeros((CENTRES, 2, 2))
            b = np.zeros((CENTRES, 2))
            for s in range(2):
                b[:, s] = np.bincount(c, xj[:, s] * (1 + weight), minlength=CENTRES)
                for t in range(2):
                    a[:, s, t] = np.bincount(c, k * xj[:, s] * xj[:, t] + (s == t), minlength=CENTRES)
            used = np.bincount(c, minlength=CENTRES) > 0
            q.centres[j][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            along[:, j] = ((xj - q.centres[j][c]) * xj).sum(1)
    return q


def fit_index(vectors: DataFrame, *, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> dict[int, Quantiser]:
    """Codebooks for each length, from max_rows rows and max_bytes bytes at most, in the order of a hash of the row."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    rows = vectors.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(max(1, min(max_rows, max_bytes // (8 * longest)))).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r.v)
    return {d: train_quantiser(np.array(v, np.float64)) for d, v in by.items()}


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, v) of the rows that take part; row is a number of its own for each."""
    own = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    return materialize(own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)))


def coded_rows(rows: DataFrame, books: dict[int, Quantiser]) -> DataFrame:
    """(row, vec_id, x, code): vectors as bytes, and their codes; empty where there is no codebook for the length."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches):
        for b in batches:
            v = b.column(2).to_pylist()
            packed = [b""] * len(v)
            for d in {len(x) for x in v} & held.value.keys():
                at = [i for i, x in enumerate(v) if len(x) == d]
                for i, r in zip(at, held.value[d].encode(np.array([v[i] for i in at], np.float64)), strict=True):
                    packed[i] = r.tobytes()
            ids = [NO_ID if i is None else i for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array([np.array(x, np.float64).tobytes() for x in v], pa.binary()), pa.array(packed, pa.binary())], ["row", "vec_id", "x", "code"])

    return materialize(rows.mapInArrow(tidy(code), "row long, vec_id long, x binary, code binary"))


def best_of(rows, ids, x, codes, book: Quantiser | None, asked_rows, queries, k: int, shortlist: int) -> list[np.ndarray]:
    """(query, vec_id, score) of the k best of some rows of one length for each query, by its place."""
    order = np.lexsort((ids, *x.T))
    rows, ids, x, codes = rows[order], ids[order], x[order], codes[order]
    lead = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))
    size = np.minimum(np.diff(np.append(lead, len(ids))), k + 1)  # of equal vectors, k others suffice
    few = len(lead) if book is None else min(shortlist, len(lead))
    out = []
    for lo in range(0, len(queries), 128):
        q, own = queries[lo : lo + 128], asked_rows[lo : lo + 128]
        if few < len(lead):
            best = np.argpartition(-book.scan(codes[lead], q).T, few - 1, axis=1)[:, :few]
        else:
            best = np.tile(np.arange(few), (len(q), 1))
        exact, chosen = np.zeros(best.shape), x[lead[best]]
        for j in range(x.shape[1]):
            exact += q[:, None, j] * chosen[:, :, j]
        times = size[best].ravel()
        qi = np.repeat(np.repeat(np.arange(len(q)), few), times)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(lead[best].ravel(), times) + inside
        other = rows[at] != own[qi]
        out.append(leading(qi[other] + lo, ids[at][other], np.repeat(exact.ravel(), times)[other], k))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def leading(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of largest score of each query, ties to the smaller id."""
    by = np.lexsort((vec, -score, query))
    query, vec, score = query[by], vec[by], score[by]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], vec[keep], score[keep]


def nearest(embeddings: DataFrame, is_query: Column, *, k: int = 20, shortlist: int = 200, id_col: str = "vec_id", vec_col: str = "embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, a condition on vec_id, the k rows of largest inner product found, other than itself."""
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_col, vec_col)
    books = fit_index(rows)
    coded = coded_rows(rows, books)
    forget(rows)
    asks = coded.where(F.col("vec_id") != NO_ID).where(is_query)
    slices = max(1, -(-(asks.agg(F.sum(F.octet_length("x") + 64)).first()[0] or 0) // slice_bytes))
    tables = []
    for part in range(slices):
        own = asks.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == part).select("row", "vec_id", "x").toArrow()
        by = _by_length(own.column("x"))
        held = spark.sparkContext.broadcast({d: (own.column("row").to_numpy()[at], own.column("vec_id").to_numpy()[at], x) for d, (at, x) in by.items()})
        known = spark.sparkContext.broadcast(books)

        def run(batches, held=held, known=known):
            kept: dict[int, list] = {}
            for b in regrouped(batches, BATCH_ROWS):
                rows, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                for d, (at, x) in _by_length(b.column(2)).items():
                    if d in held.value:
                        book = known.value.get(d)
                        codes = np.frombuffer(b"".join(b.column(3).combine_chunks().take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) if book else np.zeros((len(at), 0), np.uint8)
                        found = best_of(rows[at], ids[at], x, codes, book, held.value[d][0], held.value[d][2], k, shortlist)
                        kept[d] = leading(*map(np.concatenate, zip(kept[d], found, strict=True)), k) if d in kept else found
            for d, (query, vec, score) in kept.items():
                asked, names, _ = held.value[d]
                yield pa.RecordBatch.from_arrays([pa.array(asked[query]), pa.array(names[query]), pa.array(vec), pa.array(score)], ["row", "query_id", "vec_id", "score"])

        if own.num_rows:
            tables.append(materialize(coded.mapInArrow(tidy(run), "row long, query_id long, vec_id long, score double")))
    found = tables[0] if tables else coded.select("row", F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).where("false")
    for more in tables[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def _by_length(x: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    size = pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out[int(d)] = at, np.frombuffer(b"".join(x.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1)
    return out
