"""Readers of text files into tables; every one is a scan that Spark splits, and none lists rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of files that are text, and delimiters that a table may have.
TEXT_SUFFIXES = ["md", "markdown", "txt", "rst", "text"]
DELIMITERS = [",", ";", "\t", "|"]


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings, named by the first record; the delimiter is the one that the first line has most of, else a comma.

    Blank rows are left out; short rows end in nulls and long ones are cut. An empty file gives no columns.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    line = first.value if first else ""
    sep = max(DELIMITERS, key=line.count)
    rows = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=False)
    if not rows.columns:
        return rows
    return rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns]).isNotNull())


def read_training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(messages, domain, entities, reasoning): malformed and blank lines are skipped."""
    shape = T.StructType.fromDDL("messages array<struct<role:string,content:string>>, domain string, entities array<string>, reasoning string, _bad string")
    rows = spark.read.schema(shape).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.where("_bad is null and messages is not null").drop("_bad")


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, domain, question, expected, grader, weight): blank lines and those that begin with // or # are skipped; a malformed one is an error that quotes it.

    A missing domain is the file's stem, a missing id a hash of the line after the stem.
    """
    line = F.trim("value")
    rows = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem")).where((line != "") & ~line.startswith("//") & ~line.startswith("#"))
    shape = "id string, domain string, question string, expected string, grader string, weight double, _bad string"
    case = rows.withColumn("c", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    case = case.withColumn("question", F.when(F.col("c._bad").isNull() & F.col("c").isNotNull(), F.col("c.question")).otherwise(F.raise_error(F.concat(F.lit("malformed case: "), F.substring("value", 1, 200)))))
    given = lambda name, default: F.coalesce(F.nullif(F.col(f"c.{name}"), F.lit("")), default)
    return case.select(given("id", F.concat_ws("-", "stem", F.substring(F.sha2("value", 256), 1, 12))).alias("id"), given("domain", F.col("stem")).alias("domain"), "question", F.coalesce("c.expected", F.lit("")).alias("expected"), given("grader", F.lit("keywords")).alias("grader"), F.coalesce("c.weight", F.lit(1.0)).alias("weight"))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(uri, domain, title, text) of the text files below root: the first folder is the domain, and files right in root are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(TEXT_SUFFIXES) + "}").load(root)
    base = root.rstrip("/").rpartition("://")[2].split(":")[-1]
    inside = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "")
    stem = F.regexp_extract(inside, r"([^/]+?)\.[^./]+$", 1)
    rows = files.select(inside.alias("uri"), F.initcap(F.translate(stem, "-_", "  ")).alias("title"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(F.instr("uri", "/") > 0).select("uri", F.substring_index("uri", "/", 1).alias("domain"), "title", "text")


def with_schema(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the columns that schema has and they lack, as nulls; none is dropped or retyped."""
    have = set(rows.columns)
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in have])


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a log of Parquet files; a task that is repeated adds nothing twice, as its files are committed as a whole."""
    rows.write.mode("append").parquet(path)
