"""Uploaded tables as documents: sheets rendered to chunks of text, and a store in which an upload replaces the one before.

Rows are (filename, sheet, row, headers, cells): row counts from 1 within a sheet, headers and cells are arrays of strings. A
sheet is one document, known by its uri; its chunks are a description of its columns and then groups of rows. A document's
version is a digest of all its chunks.

The store has two tables, documents by uri and chunks by uri and version. An upload writes the chunks of its changed documents
under their new versions first, and their documents last; readers take the chunks of the version that a document names. So
whatever a failed upload leaves behind is not seen, a repeated one changes nothing, and an edited one shows old rows no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import formatted_number
from granary.sources.scratch import materialize

ROWS_PER_CHUNK = 12


def _pairs(headers: Column, cells: Column) -> Column:
    """Name and value of the cells that aren't empty, in one line."""
    both = F.zip_with(headers, cells, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(": "), v)))
    return F.array_join(F.filter(both, lambda x: x.isNotNull()), "; ")


def _number(cell: Column) -> Column:
    comma = F.length(F.regexp_replace(cell, "[^,]", "")) == 1
    return F.when(comma, F.translate(F.translate(cell, ".", ""), ",", ".")).otherwise(cell).try_cast("double")


def _sorted(order: str, line: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("at"), line.alias("line"))))), lambda x: x["line"])


def row_chunks(rows: DataFrame, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """(filename, sheet, ordinal, kind, text): groups of size rows from ordinal 1, each with its place, the columns, and a line for each row that isn't empty."""
    key = ["filename", "sheet"]
    line = _pairs(F.col("headers"), F.col("cells"))
    numbered = rows.withColumn("ordinal", (F.floor((F.col("row") - 1) / size) + 1).cast("int")).withColumn("line", F.when(line != "", F.concat(F.lit("["), F.col("row"), F.lit("] "), line)))
    by = numbered.groupBy(*key, "ordinal").agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("own"), F.min_by(F.array_join("headers", ", "), "row").alias("columns"), _sorted("row", F.col("line")).alias("lines"))
    # The number of a sheet's rows is the sum over its groups, so hot sheets meet as a few numbers.
    total = by.groupBy(*key).agg(F.sum("own").alias("total"))
    first = (F.col("ordinal") - 1) * size
    text = F.concat(F.col("sheet"), F.lit(" — registros "), first + 1, F.lit(" a "), first + F.col("own"), F.lit(" de "), F.col("total"), F.lit("\nColunas: "), F.col("columns"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), x)), ""))
    return by.join(total, key).select(*key, "ordinal", F.lit("table_rows").alias("kind"), text.alias("text"))


def schema_chunks(rows: DataFrame) -> DataFrame:
    """(filename, sheet, ordinal, kind, text, total, names): what a sheet has: rows, columns, ranges of those that are mostly numbers, and its first three rows."""
    key = ["filename", "sheet"]
    cells = rows.select(*key, F.posexplode("headers").alias("pos", "name"), "cells").withColumn("value", _number(F.get("cells", F.col("pos"))))
    columns = cells.groupBy(*key, "pos").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("all"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    numeric = F.when(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("all") * 0.6)), F.concat(F.lit("- "), F.col("name"), F.lit(": numérica, de "), formatted_number(F.col("least")), F.lit(" a "), formatted_number(F.col("most")), F.lit(" ("), F.col("n"), F.lit(" valores)")))
    described = columns.groupBy(*key).agg(F.max("all").alias("total"), _sorted("pos", F.col("name")).alias("names"), _sorted("pos", numeric).alias("numeric"))
    sample = rows.where("row <= 3").groupBy(*key).agg(_sorted("row", F.concat(F.lit("- "), _pairs(F.col("headers"), F.col("cells")))).alias("sample"))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n{head}\n"), F.array_join(lines, "\n"))).otherwise("")
    text = F.concat(
        F.lit("# "), F.col("sheet"), F.lit(" — estrutura dos dados\n\nOrigem: "), F.col("filename"), F.lit("\nRegistros: "), F.col("total"), F.lit("\nColunas ("), F.size("names"), F.lit("): "), F.array_join("names", ", "),
        part("Colunas numéricas:", F.col("numeric")), part("Primeiros registros como amostra:", F.coalesce("sample", F.array().cast("array<string>"))),
    )
    return described.join(sample, key, "left").select(*key, F.lit(0).alias("ordinal"), F.lit("table_schema").alias("kind"), text.alias("text"), "total", "names")


def rendered(rows: DataFrame, domain: str, sensitivity: str = "internal") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of an upload: documents (uri, version, domain, title, sensitivity, sheet, rows, columns, chunks), chunks (uri, version, ordinal, kind, text)."""
    uri = F.concat(F.lit("upload://"), F.col("filename"), F.lit("#"), F.col("sheet"))
    about = materialize(schema_chunks(rows))
    chunks = row_chunks(rows).unionByName(about.select("filename", "sheet", "ordinal", "kind", "text")).withColumn("uri", uri).withColumn("h", F.sha2(F.concat_ws(":", F.col("ordinal").cast("string"), "text"), 256))
    chunks = materialize(chunks)
    # Sums of two parts of each chunk's digest: the same whatever order the chunks are met in, and nothing is collected.
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)"))
    version = F.substring(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(16).cast("string")), 256), 1, 32)
    digests = chunks.groupBy("uri", "filename", "sheet").agg(version.alias("version"), F.count(F.lit(1)).alias("chunks"))
    sheets = F.count(F.lit(1)).over(Window.partitionBy("filename"))
    stem = F.regexp_replace("filename", r"^.*/|(?<=[^/])\.[^./]*$", "")
    documents = digests.join(about.select("filename", "sheet", "total", "names"), ["filename", "sheet"]).withColumn("title", F.when(sheets > 1, F.concat(stem, F.lit(" · "), "sheet")).otherwise(stem))
    documents = materialize(documents.select("uri", "version", F.lit(domain).alias("domain"), "title", F.lit(sensitivity).alias("sensitivity"), "sheet", F.col("total").alias("rows"), F.col("names").alias("columns"), "chunks"))
    return documents, chunks.join(documents.select("uri", "version"), "uri").select("uri", "version", "ordinal", "kind", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, base: str) -> DataFrame:
    """The documents of a store."""
    shape = "version string, domain string, title string, sensitivity string, sheet string, rows long, columns array<string>, chunks long, uri string"
    return spark.read.schema(shape).parquet(f"{base}/documents") if _exists(spark, f"{base}/documents") else spark.createDataFrame([], shape)


def live_chunks(spark: SparkSession, base: str) -> DataFrame:
    """(uri, version, ordinal, kind, text) of the versions that the documents name."""
    chunks = spark.read.schema("ordinal int, kind string, text string, uri string, version string").parquet(f"{base}/chunks")
    return chunks.join(stored(spark, base).select("uri", "version"), ["uri", "version"])


def ingest(rows: DataFrame, base: str, *, domain: str, sensitivity: str = "internal") -> DataFrame:
    """Uploads rows into the store at base, and gives (uri, version, action) of each of its sheets: insert, replace or unchanged.

    Sheets of other uploads stay. An upload must not run beside another one of the same sheets.
    """
    spark = rows.sparkSession
    documents, chunks = rendered(rows, domain, sensitivity)
    was = stored(spark, base).select("uri", F.col("version").alias("before"))
    report = materialize(documents.join(was, "uri", "left").select("uri", "version", F.when(F.col("before").isNull(), "insert").when(F.col("before") == F.col("version"), "unchanged").otherwise("replace").alias("action")))
    changed = report.where("action <> 'unchanged'").select("uri", "version")
    for table, by, name in ((chunks, ["uri", "version"], "chunks"), (documents, ["uri"], "documents")):
        table.join(changed, ["uri", "version"], "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{base}/{name}")
    return report


def vacuum(spark: SparkSession, base: str) -> int:
    """Deletes the chunks of versions that no document names any more; the number of versions that went. One path for each of them goes through the driver."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/chunks")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    chunks = spark.read.schema("ordinal int, kind string, text string, uri string, version string").parquet(f"{base}/chunks")
    stale = chunks.select("uri", "version", F.input_file_name().alias("file")).join(stored(spark, base).select("uri", "version"), ["uri", "version"], "left_anti").select(F.regexp_replace("file", "/[^/]*$", "").alias("path")).distinct()
    gone = 0
    for r in stale.toLocalIterator():
        gone += bool(fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r.path)), True))
    return gone
