"""From documents to encoded training text: five stages, each written as Parquet and read again as the next one's input.

Stages take and give the columns of documents, whatever others there are; the last gives ids and digests. Cases: a null or empty
text is scored as it is by the classifiers, is linked with nothing, is clean, and has no ids; a null id is kept by near_dedup
and decontamination; of rows that repeat an id all stay or go together in these two; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, neardup, pieces, quality, toxicity
from .common import crc_mod, materialize, table, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("id", 3) != 1)
    return toxicity.drop_toxic(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("id", 5) != 0)
    return quality.keep_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), with_ids=False)


STAGES = [("toxicity", reject_toxic), ("quality", keep_good), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pieces", encode)]

#: Trained models decide the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
