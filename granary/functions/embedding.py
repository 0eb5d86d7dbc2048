"""Signed-hash embeddings: words, pairs of neighbouring words and runs of four characters, hashed into a fixed space.

Tokens are cut in the JVM. Some texts at a time have their features numbered as arrays; only the distinct ones become strings
and are hashed, and a text's vector is the sum of its features.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Dimensions, the weight of each kind of feature in tenths, characters of a run.
DIM = 384
WEIGHTS = {"w": 10, "b": 6, "c": 3}
RUN = 4
SIGNATURE = f"hash:signed-hashing:{DIM}"
#: Features that a worker remembers at most.
CACHE = 500_000


#: Texts and tokens that are embedded at once, at most; a longer text goes by itself.
TEXTS, TOKENS = 500, 300_000


def parts(tokens: pa.ListArray):
    """(first, end) of rows that are embedded at once."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(tokens):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + TEXTS, int(np.searchsorted(upto, before + TOKENS, "right"))))
        yield lo, hi
        lo = hi


class HashSpace:
    """Places of features; the vectors are whole tenths, so sums are exact."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def places(self, features: list[str]) -> np.ndarray:
        """For each feature its index times 32, and its signed weight plus 16."""
        new = [f for f in features if f not in self.known]
        self.known.update(zip(new, self.hashed(new).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, features), np.int64, len(features))

    @staticmethod
    def hashed(features: list[str]) -> np.ndarray:
        """What places gives, without remembering it: pairs seldom come again."""
        md5 = hashlib.md5
        digests = np.frombuffer(b"".join([md5(f.encode(), usedforsecurity=False).digest() for f in features]), np.uint8).reshape(-1, 16)
        index = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % DIM
        weight = np.array([WEIGHTS[f[0]] for f in features], np.int64)
        return index * 32 + 16 + np.where(digests[:, 4] < 128, weight, -weight)

    def sums(self, tokens: pa.ListArray) -> np.ndarray:
        """(texts, DIM): the sums of the features' signed weights."""
        if len(self.known) > CACHE:
            self.known.clear()
        out = np.zeros(len(tokens) * DIM)

        def add(rows: np.ndarray, keys: np.ndarray, named, placed=self.places) -> None:
            code, distinct = pd.factorize(keys)
            if len(distinct):
                place = placed(named(distinct.tolist()))
                at = rows * DIM + (place >> 5)[code]
                out[:] += np.bincount(at, ((place & 31) - 16)[code], len(out))

        words = tokens.flatten().dictionary_encode()
        names, code = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        add(row, code, lambda d: [f"w:{names[x]}" for x in d])
        inner = np.flatnonzero(row[1:] == row[:-1])
        add(row[inner], code[inner] * len(names) + code[inner + 1], lambda d: [f"b:{names[x // len(names)]}_{names[x % len(names)]}" for x in d], self.hashed)

        joined = pc.fill_null(pc.binary_join(tokens, " "), "")
        char = np.frombuffer("".join(joined.to_pylist()).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(tokens)), pc.utf8_length(joined).to_numpy())
        first = np.flatnonzero(row[RUN - 1 :] == row[: len(row) - RUN + 1])
        # Characters are numbered, then pairs of them, so that a run of four fits into 64 bits as two pairs.
        char, alphabet = pd.factorize(char)
        pair, pairs = pd.factorize(char[:-1] * len(alphabet) + char[1:])
        letter = [chr(c) for c in alphabet]
        two = [letter[x // len(letter)] + letter[x % len(letter)] for x in pairs.tolist()]
        add(row[first], pair[first] * len(two) + pair[first + 2] if len(first) else first, lambda d: [f"c:{two[x // len(two)]}{two[x % len(two)]}" for x in d])
        return out.reshape(-1, DIM)

    def unit(self, tokens: pa.ListArray | list[list[str] | None]) -> np.ndarray:
        """(texts, DIM), each of length 1, or 0 where nothing is left."""
        own = tokens if isinstance(tokens, pa.ListArray) else pa.array(tokens, pa.list_(pa.string()))
        return scaled(np.concatenate([np.zeros((0, DIM)), *(self.sums(own.slice(lo, hi - lo)) for lo, hi in parts(own))]))


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, or 0."""
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


def features(tokens: Column) -> Column:
    """The features of tokens, once for each time that they occur, as an array of strings: what a HashSpace hashes, without Python."""
    last = lambda n, least: F.when(n > least, F.sequence(F.lit(1), n - least)).otherwise(F.array().cast("array<int>"))
    words, joined = F.coalesce(tokens, F.array().cast("array<string>")), F.array_join(F.coalesce(tokens, F.array().cast("array<string>")), " ")
    pairs = F.transform(last(F.size(words), 1), lambda i: F.concat(F.lit("b:"), F.element_at(words, i), F.lit("_"), F.element_at(words, i + 1)))
    runs = F.transform(last(F.length(joined), RUN - 1), lambda i: F.concat(F.lit("c:"), F.substr(joined, i, F.lit(RUN))))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), pairs, runs)


def placed(feature: Column) -> Column:
    """struct(i, weight) of a feature: its index, and its signed weight in tenths."""
    digest = F.md5(feature)
    own = F.element_at(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair)), F.substring(feature, 1, 1))
    return F.struct((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DIM).cast("int").alias("i"), F.when(F.substring(digest, 9, 1) < "8", own).otherwise(-own).alias("weight"))


_space = HashSpace()


def space() -> HashSpace:
    """The worker's own."""
    return _space


def embed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, vector, signature) of each row; a null or empty text, or one without words, has the zero vector."""

    def run(batches):
        for b in batches:
            for lo, hi in parts(b.column(1)):
                m = scaled(space().sums(b.column(1).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, DIM, dtype=np.int32)), pa.array(m.ravel()))], [id_col, "vector"])

    kind = rows.schema[id_col].dataType.simpleString()
    tokens = rows.select(F.col(id_col), text.tokens(F.col(text_col)).alias("tokens"))
    return tokens.mapInArrow(run, f"`{id_col}` {kind}, vector array<double>").withColumn("signature", F.lit(SIGNATURE))


def reindexed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows with vector and signature, where those of another space are embedded anew; ids may repeat, rows keep their number."""
    stale = ~F.col("signature").eqNullSafe(F.lit(SIGNATURE))
    fresh = embed(rows.where(stale), id_col, text_col)
    return rows.where(~stale).select(id_col, "vector", "signature").unionByName(fresh)
