"""Hybrid retrieval: hashed embeddings, lexical and entity signals, governed top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import embedding, scores, text
from granary.sources.scratch import dealt, materialize


#: Texts that a task tokenises and scores, some 2.5 MB.
CHUNKS = 1000


def exploded_tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token), each pair once."""
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("token"))


def lexical(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, lexical): share of a query's distinct tokens, of more than two characters, that a chunk has; both sides are (id, token)."""
    q = queries.where(F.length("token") > 2).withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("id"))).select(F.col("id").alias("query_id"), "token", "asked")
    return chunks.join(q, "token").groupBy("query_id", "id").agg((F.count(F.lit(1)) / F.max("asked")).alias("lexical"))


def entities_of(text_col: Column, dictionary: list[str]) -> Column:
    """Names of the dictionary that stand in the text as whole words, in its order."""
    found = [F.when(F.coalesce(text_col, F.lit("")).rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)"), F.lit(w)) for w in dictionary]
    return F.array_compact(F.array(*found))


def keywords(rows: DataFrame, id_col: str, text_col: str, *, limit: int = 12, least: int = 4) -> DataFrame:
    """(id_col, keywords) of each id: its most frequent tokens of least characters or more, in that order, joined by spaces; ties by first appearance. Ids without such tokens have no row."""
    each = dealt(rows.select(id_col, text_col), CHUNKS, id_col).select(F.col(id_col), F.posexplode(F.filter(text.tokens(F.col(text_col)), lambda x: F.length(x) >= least)).alias("pos", "token"))
    # Nothing is shuffled after the texts: counts, ranks and lists are of one id.
    counts = each.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "pos"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " ").alias("keywords"))


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that are sent to the chunks at once: some 10 MB of vectors and tokens.
SLICE_QUERIES = 2000


def hybrid_search(queries: DataFrame, chunks: DataFrame, *, k: int = 6, dictionary: list[str] | None = None, weights: tuple[float, float, float] = scores.HYBRID, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """(query_id, id, semantic, lexical, entity, score, rank) of the k best chunks of positive score.

    queries and chunks are (id, text). The queries are broadcast, slice_queries at a time; one pass over the chunks scores each
    against all of them and keeps the k best of its task, so no join is by token or index. Chunks are dealt over tasks by their number first, however few files they lie in. More than
    one slice reads chunks whose features were hashed once and written. Null texts have no words; equal scores go by id; a query without words finds nothing.
    """
    names = entities_of(F.col("text"), dictionary) if dictionary else F.array().cast("array<string>")
    parts = [F.col("id"), text.tokens(F.col("text")).alias("tokens"), names.alias("names")]
    asked = queries.select(*parts)
    chunks = dealt(chunks.select("id", "text"), CHUNKS, "id")
    n = queries.count()
    slices = max(1, -(-n // slice_queries))
    kinds = queries.schema["id"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()
    schema = "query_id {}, id {}, semantic double, lexical double, entity double, score double".format(*kinds)
    if slices == 1:
        rows = chunks.select(*parts)
    else:
        rows = materialize(chunks.select(*parts).mapInArrow(_with_sums, "id {}, tokens array<string>, names array<string>, sums array<int>".format(kinds[1])))
    found = None
    for part in range(slices):
        own = asked.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(slices)) == part).toArrow()
        held = queries.sparkSession.sparkContext.broadcast(_Asked(own))
        each = rows.mapInArrow(lambda batches, held=held: held.value.best(batches, k, weights), schema)
        found = each if found is None else found.unionByName(each)
    return top_k(found, "query_id", "score", "id", k)


def _with_sums(batches):
    """The rows with the sums of their features."""
    for b in batches:
        for lo, hi in embedding.parts(b.column(1)):
            own = b.slice(lo, hi - lo)
            m = embedding.space().sums(own.column(1)).astype(np.int32)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, embedding.DIM, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*own.columns, sums], ["id", "tokens", "names", "sums"])


class _Asked:
    """One slice of the queries: unit vectors, and for each word and name the queries that have it."""

    def __init__(self, rows: pa.Table):
        self.ids, tokens, names = rows.column("id").combine_chunks(), rows.column("tokens").to_pylist(), rows.column("names").to_pylist()
        self.vectors = embedding.HashSpace().unit(tokens)
        self.words = self._index([{t for t in x if len(t) > 2} for x in tokens])
        self.names = self._index([set(x) for x in names])

    @staticmethod
    def _index(sets: list[set[str]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        by: dict[str, list[int]] = {}
        for i, own in enumerate(sets):
            for x in own:
                by.setdefault(x, []).append(i)
        return {x: np.array(v) for x, v in by.items()}, np.array([max(1, len(x)) for x in sets], float)

    def _shares(self, sets: list[list[str]], index: tuple[dict[str, np.ndarray], np.ndarray]) -> np.ndarray:
        """(rows, queries): the share of a query's set that each row has."""
        by, size = index
        out = np.zeros((len(sets), len(size)))
        for row, own in zip(out, sets, strict=True):
            for x in by.keys() & set(own):
                row[by[x]] += 1
        return out / size

    def best(self, batches, k: int, weights: tuple[float, float, float]):
        """The k best rows of each query, of rows (id, tokens, names) or those that _with_sums gave their sums."""
        kept, least = None, np.zeros(len(self.ids))
        # Some rows at a time, so that a step's matrices stay small.
        for b in (batch.slice(lo, hi - lo) for batch in batches for lo, hi in embedding.parts(batch.column(1))):
            sums = b.column(3).flatten().to_numpy().reshape(-1, embedding.DIM).astype(float) if b.num_columns > 3 else embedding.space().sums(b.column(1))
            signals = np.clip(embedding.scaled(sums) @ self.vectors.T, 0, 1), self._shares(b.column(1).to_pylist(), self.words), self._shares(b.column(2).to_pylist(), self.names)
            score = np.round(sum(w * s for w, s in zip(weights, signals, strict=True)), 6).T
            # A row beyond the k best of its slice, or of what is kept, can't be among the k best; equal scores stay.
            worst = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else 0.0
            query, row = np.nonzero((score > 0) & (score >= np.maximum(worst, least)[:, None]))
            new = pa.table([pa.array(query), b.column(0).take(pa.array(row)), *(pa.array(s.T[query, row]) for s in signals), pa.array(score[query, row])], ["query", "id", "semantic", "lexical", "entity", "score"])
            both = (new if kept is None else pa.concat_tables([kept, new])).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
            q = both.column("query").to_numpy()
            kept = both.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k)).combine_chunks()
            q, size = kept.column("query").to_numpy(), np.bincount(kept.column("query").to_numpy(), minlength=len(least))
            ends = np.searchsorted(q, np.flatnonzero(size >= k), "right") - 1
            least[size >= k] = kept.column("score").to_numpy()[ends]
        if kept is not None and len(kept):
            cols = [self.ids.take(kept.column("query").combine_chunks()), *(kept.column(c).combine_chunks() for c in ("id", "semantic", "lexical", "entity", "score"))]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "id", "semantic", "lexical", "entity", "score"])


def governed(found: DataFrame, judged: DataFrame, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """Allowed rows (found's columns, effect, rank) and denials (query_id, id, effect, policy_id, rank) of a search that fetched more than k.

    found is (query_id, id, ..., rank), judged (id, effect, policy_id) has one row for each chunk. A query's rows are walked in
    their order until k are allowed; only denials met before that are reported, and rows beyond what was fetched are not seen,
    so fewer than k may be left although more would be allowed. A chunk without a judgement is denied.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    walked = found.join(judged.select("id", "effect", "policy_id"), "id", "left").withColumn("effect", F.coalesce("effect", F.lit("deny"))).withColumn("_ok", F.col("effect") != "deny")
    seen = walked.withColumn("_before", F.coalesce(F.sum(F.col("_ok").cast("int")).over(before), F.lit(0))).where(F.col("_before") < k)
    allowed = seen.where("_ok").withColumn("rank", (F.col("_before") + 1).cast("int")).select(*found.columns, "effect")
    denied = seen.where("not _ok").select("query_id", "id", "effect", F.coalesce("policy_id", F.lit("")).alias("policy_id"), "rank")
    return allowed, denied


def context_budget(blocks: DataFrame, group: str, rank: str, size: str, budget: int) -> DataFrame:
    """Blocks in rank order while their sizes stay within the budget; the first always."""
    run = F.sum(size).over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("running", run).where((F.col("running") <= budget) | (F.col(rank) == 1))
