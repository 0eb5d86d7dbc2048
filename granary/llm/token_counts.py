"""Token counts: the exact histogram of encoded lengths answers totals, quantiles and truncated totals for any limit.

Each whole text is encoded to its length by a byte-level rank vocabulary. Documents are then only counted by length,
and all answers are suffix sums over lengths. The library looks ahead over white space by recursion, and ends the process on
some million characters of it; so long runs are taken out and counted as the pieces that the pattern makes of them: all
of the run but its last character, which goes with what follows, or the whole run at the end of a text.

Cases: a null or empty text has length 0; repeated rows count each time; no rows give an empty histogram. Columns
other than the text are not read.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy


#: Runs of white space, as the pattern has it, that are too long for the library's look-ahead.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class LengthCounter:
    """Encoded lengths by one rank file, whose lines are a token in base 64 and its rank."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_piece = coding.encode_ordinary, coding._encode_single_piece
        self.blanks = pattern.endswith(r"|\s+(?!\S)|\s+")

    def length(self, text: str) -> int:
        if not self.blanks:
            return len(self.encode(text))
        total = lo = 0
        for run in LONG_BLANK.finditer(text):
            cut = run.end() - (run.end() < len(text))
            total += len(self.encode(text[lo : run.start()])) + len(self.encode_piece(text[run.start() : cut].encode()))
            lo = cut
        return total + len(self.encode(text[lo:]))


_counters: dict[tuple[str, str], LengthCounter] = {}


def counter(path: str, pattern: str) -> LengthCounter:
    key = (path, pattern)
    if key not in _counters:
        _counters[key] = LengthCounter(path, pattern)
    return _counters[key]


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """(n_tokens) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        own = counter(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own.length(x or "") for x in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col)).mapInArrow(tidy(run), "n_tokens long")


def length_histogram(lengths: DataFrame, *, width: int = 1024) -> DataFrame:
    """A row for each length that occurs: n_docs of it; docs_longer; tokens_up_to, the tokens of documents of this length at most; total_tokens, of all; truncated_tokens, of all if each is cut at this length; quantile, the share of documents of this length at most.

    The running sums go over bands of width lengths each, so only one row for each band meets in one task. The counts are
    written, as they are read twice.
    """
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))).withColumn("band", F.floor(F.col("n_tokens") / width))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    bands = counts.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up, whole = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bands = bands.select("band", zero(F.sum("d").over(up)).alias("d0"), zero(F.sum("t").over(up)).alias("t0"), F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("band").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("d1", F.sum("n_docs").over(inside)).withColumn("t1", F.sum("tokens").over(inside)).join(bands, "band")
    upto = F.col("d0") + F.col("d1")
    return out.select("n_tokens", "n_docs", (F.col("docs") - upto).alias("docs_longer"), (F.col("t0") + F.col("t1")).alias("tokens_up_to"), "total_tokens", (F.col("t0") + F.col("t1") + F.col("n_tokens") * (F.col("docs") - upto)).alias("truncated_tokens"), (upto / F.col("docs")).alias("quantile"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """(total_tokens, truncated_tokens, docs_truncated) for any context limit, whether or not the length occurs."""
    return histogram.agg(
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_truncated"),
    )


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length such that at least this share of documents is no longer."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
