"""Table maintenance without MERGE: latest-wins upserts, deletes, document identity, and tabular ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; order must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc() for c in order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those with the same keys; for some columns a null leaves the old value."""
    o = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in old.columns if c not in keys), F.lit(True).alias("_old"))
    n = new.select(*keys, *(c for c in old.columns if c not in keys), F.lit(True).alias("_new"))
    both = o.join(n, keys, "full")
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"_{c}")) if c in keep_if_null else F.col(c))
    return both.select(*keys, *(value(c).alias(c) for c in old.columns if c not in keys))


def upsert_plan(old: DataFrame, new: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """(keys, action): insert, replace or unchanged for new rows; rows that only old has are kept."""
    both = old.select(*keys, F.col(digest).alias("was")).join(new.select(*keys, F.col(digest).alias("now")), keys, "full")
    action = F.when(F.col("now").isNull(), "keep").when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("now"), "unchanged").otherwise("replace")
    return both.select(*keys, action.alias("action"))


def without_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in gone (node_id) and whatever touches them."""
    cut = edges.join(gone.select(F.col("node_id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), cut


def unique_headers(headers: DataFrame) -> DataFrame:
    """(pos, header, name): a blank header is coluna_<pos>, the k-th repeat gets _k."""
    named = headers.withColumn("base", F.when(F.trim(F.coalesce("header", F.lit(""))) == "", F.concat(F.lit("coluna_"), F.col("pos"))).otherwise(F.trim("header")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("pos"))
    return named.select("pos", "header", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), k)).alias("name"))


def row_chunks(rows: DataFrame, order: str, line: Column, header: str, size: int = 12, *by: str) -> DataFrame:
    """(by, chunk, text): groups of size rows in order, each with the header above its lines."""
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("int")
    each = rows.withColumn("chunk", at).withColumn("line", line)
    group = each.groupBy(*by, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s["line"]), "\n").alias("body"))
    return group.select(*by, "chunk", F.concat(F.lit(header + "\n"), "body").alias("text"))


def numeric_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, least, most) of the string columns of which three fifths, and two at least, are numbers; one decimal comma is read as a point."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("raw")) for c in columns])).alias("cell")).select("cell.*")
    comma = F.length(F.regexp_replace("raw", "[^,]", "")) == 1
    value = F.when(comma, F.translate(F.translate("raw", ".", ""), ",", ".")).otherwise(F.col("raw")).try_cast("double")
    out = long.withColumn("value", value).groupBy("name").agg(F.count(F.lit(1)).alias("all"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("all") * 0.6))).drop("all")


def added_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id, token_count, sensitivity): a chunk's own sensitivity comes before its document's; one token at least."""
    own = chunks.join(documents.select("document_id", F.col("sensitivity").alias("inherited")), "document_id", "left")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), 0))
    return own.select("chunk_id", "document_id", F.greatest(F.lit(1), words).alias("token_count"), F.coalesce("sensitivity", "inherited").alias("sensitivity"))


def stale_share(chunks: DataFrame, signature: str) -> DataFrame:
    """(domain, chunks, stale, needs_reindex): over all rows; a domain needs it if none of its chunks has the signature."""
    stale = F.coalesce(F.col("embedding_model") != signature, F.lit(True))
    return chunks.groupBy("domain").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(stale).alias("stale")).withColumn("needs_reindex", F.col("chunks") == F.col("stale"))


def embedding_text(parts: list[str]):
    """The parts that aren't empty, with a middle dot between them."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(F.trim(p), F.lit("")) != ""), " · ")
