"""Benchmark decontamination by DataFrame functions alone: a hash set of normalised test n-grams, scanned and verified.

Texts are lower-cased A-Z and cut into words of letters, digits and characters beyond ASCII. Each run of `size` words of
a benchmark item is a window; an item of fewer words, but not none, is one window. The hash set holds the 64-bit hash of
each window's first few words, its anchor. A document's positions meet it in a broadcast join inside one scan, so nothing
is shuffled but what the set lets through: for each window length a candidate is the words themselves, and it is verified
by a join with the windows on these. The broadcast has a bound, SLICE anchors; a larger set is cut into slices by hash,
and the words, written once, are scanned for each slice. The windows' join is broadcast too while their text is small, and
shuffled otherwise.

Cases: a null or empty text has no words and is clean; a null item text has no window; a null item id counts for hits
but not as an item; rows of documents keep their number; without any window all documents are clean. Columns other than
those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; upper-case letters are already gone.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHOR = 5
#: Anchors that are broadcast at once, and bytes of windows up to which they are broadcast for the check.
SLICE, VERIFY_BYTES = 2_000_000, 32 << 20
#: Stands for "no anchor": every document passes the first scan once by it.
EVERY = -1


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN), "")


def hashes_of(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def anchor_at(hashes: str, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(F.col(hashes), i + (j - 1)) for j in range(k)))


def windows_of(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, key, items, anchor): each distinct window, the items that have it, and the hash of its first words."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(text_col).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") < size, F.array(F.col("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)), lambda i: F.slice("w", i, size)))
    each = items.select("item", F.explode(cut).alias("w")).withColumn("h", hashes_of("w"))
    anchor = F.coalesce(*(F.when(F.size("w") >= k, anchor_at("h", F.lit(1), k)) for k in range(ANCHOR, 0, -1)))
    return each.select(F.size("w").alias("len"), F.array_join("w", " ").alias("key"), "item", anchor.alias("anchor")).groupBy("len", "key", "anchor").agg(F.collect_set("item").alias("items"))


def occurrences(docs: DataFrame, benchmark: DataFrame, *, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_rows: int = SLICE, verify_bytes: int = VERIFY_BYTES) -> DataFrame:
    """(uid, id, n_words, at, len, items): a row for each place of a document where a window occurs, and rows with null at for each document."""
    windows = materialize(windows_of(benchmark, size, item_col, item_text_col))
    lens = sorted(r[0] for r in windows.select("len").distinct().collect())
    anchors = windows.select("anchor").distinct()
    parts = max(1, -(-anchors.count() // slice_rows))
    words = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), words_of(text_col).alias("w"))
    words = words.withColumn("h", hashes_of("w"))
    if parts > 1:
        words = materialize(words)

    def anchors_of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("h") - k + 1), lambda i: F.struct(F.lit(k).alias("k"), i.alias("at"), anchor_at("h", i, k).alias("anchor")))

    none = F.array().cast("array<struct<k:int,at:int,anchor:bigint>>")
    every = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(EVERY).cast("long").alias("anchor")))
    found = []
    for part in range(parts):
        own = anchors.where(F.pmod("anchor", F.lit(parts)) == part) if parts > 1 else anchors
        places = [F.when(F.size("h") >= k, anchors_of(k)).otherwise(none) for k in sorted({min(ANCHOR, n) for n in lens})]
        if part == 0:
            places.append(every)
            own = own.unionByName(docs.sparkSession.range(1).select(F.lit(EVERY).cast("long").alias("anchor")))
        each = words.select("uid", "id", "w", F.explode(F.concat(none, *places)).alias("p")).select("uid", "id", "w", F.col("p.k").alias("k"), F.col("p.at").alias("at"), F.col("p.anchor").alias("anchor"))
        found.append(each.join(F.broadcast(own), "anchor", "left_semi"))
    left = found[0]
    for more in found[1:]:
        left = left.unionByName(more)
    spot = [F.when((F.col("k") == min(ANCHOR, n)) & (F.col("at") + (n - 1) <= F.size("w")), F.struct(F.lit(n).alias("len"), F.array_join(F.slice("w", F.col("at"), n), " ").alias("key"))) for n in lens]
    spots = F.when(F.col("k") > 0, F.filter(F.array(*spot), lambda x: x.isNotNull())) if spot else F.lit(None).cast("array<struct<len:int,key:string>>")
    each = left.select("uid", "id", F.size("w").alias("n_words"), "at", F.explode_outer(spots).alias("s")).select("uid", "id", "n_words", "at", F.col("s.len").alias("len"), F.col("s.key").alias("key"))
    small = (windows.agg(F.sum(F.octet_length("key") + 8 * F.size("items") + 64)).first()[0] or 0) <= verify_bytes
    windows = windows.select(F.col("len").alias("wlen"), F.col("key").alias("wkey"), "items")
    hit = each.join(F.broadcast(windows) if small else windows, (F.col("len") == F.col("wlen")) & (F.col("key") == F.col("wkey")), "left")
    return hit.select("uid", "id", "n_words", F.when(F.col("wkey").isNotNull(), F.col("at")).alias("at"), "len", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = 13, per: int = 20, id_col: str = "doc_id", **names) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of each row of docs; contaminated if n_hit > 0 and per * n_hit >= n_words; spans are the hit words' ranges, merged, from 1."""
    hits = occurrences(docs, benchmark, size=size, id_col=id_col, **names)
    group = hits.groupBy("uid", "id", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("len") - 1).alias("to"))))).alias("spots"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at").isNotNull(), F.col("items"))))).alias("items"),
    )
    empty = F.array().cast("array<struct<at:int,to:int>>")

    def join(done, s):
        last = F.element_at(done, -1)
        touch = (F.size(done) > 0) & (s["at"] <= F.get(done, F.size(done) - 1)["to"] + 1)
        longer = F.struct(last["at"].alias("at"), F.greatest(last["to"], s["to"]).alias("to"))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    spans = group.withColumn("spans", F.when(F.size("spots") == 0, empty).otherwise(F.aggregate("spots", empty, join)))
    names_of = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["to"] - s["at"] + 1).cast("long")
    out = spans.select("uid", F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names_of, ","), 256).alias("items_sha256"), "spans")
    return out.select(id_col, "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words"))).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of docs, all columns as they are, without the documents that are contaminated; of rows with a common id all go. Null ids stay."""
    gone = materialize(contamination(docs, benchmark, id_col=id_col, **names).where("contaminated").select(id_col).distinct())
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, each as often as it stands there, with every hit word, and what stands before it, cut out of the text; a null text stays."""
    row, spans = ("__row" + "_" * max(map(len, docs.columns)), "__spans" + "_" * max(map(len, docs.columns)))
    own = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    hit = contamination(own, benchmark, id_col=row, text_col=text_col, **names).where("n_hit > 0").select(row, F.col("spans").alias(spans))
    own = own.join(hit, row, "left")
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*{word}+"), 0)
    rest = F.filter(parts, lambda p, i: ~F.exists(spans, lambda s: (i + 1 >= s["at"]) & (i + 1 <= s["to"])))
    tail = F.regexp_extract(text_col, f"^(?s:.*{word})?((?s:.*))$", 1)
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(rest, ""), tail))
    return own.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
