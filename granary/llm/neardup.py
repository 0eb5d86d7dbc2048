"""MinHash near-dedup: universal hash minima, banding, verification, and connected components.

A document's set is the distinct runs of k words (its whole word sequence if it has fewer); two documents are linked if
the Jaccard similarity of their sets reaches a threshold. The steps:

1. One pass over the texts hashes the shingles to 64 bits, the set to a fingerprint, and the set's minima under many
   universal hash functions. Documents of equal fingerprint are a class, and only its smallest id goes on.
2. The minima are cut into bands of r; b bands are enough that a pair at the threshold shares none with a probability
   below miss. Classes that share a band are candidates.
3. First each class is only paired with the smallest id of each of its buckets. Pairs whose low-order signature bytes
   agree too rarely are dropped; the others are verified on their full sets, which are built again for just these
   documents. Components come from the verified links.
4. Buckets whose members fall in several components are searched again: in cells of bounded size, every pair of members
   of different components meets once, in the first bucket that it shares, and is screened by signatures inside the
   task. Only members of pairs that pass go on; their full sets are built, and the same cells verify the pairs, leaving
   out those that verified links have joined already, so a cell gives fewer links than it has members. Members of a
   bucket's largest component are never paired with each other, so a large group of copies costs no pairs.

Nothing is capped: a bucket of any size is dealt with by the last step, in cells bounded by members and by bytes. What is
known of a bucket or of a node with very many members is broadcast to them, so they needn't meet in one task. Components are by alternating large-star and
small-star; every round is written to the shared folder. The last step's links join the components of the first ones, so only these are
searched anew. Each shuffle and written table costs every partition something, however few its rows: classes are made in one, and
rows take their component by their class.

Cases: a text that is null, empty or without words has an empty set and is linked with nothing; a null id is linked with
nothing, its component is null and it is kept; rows with the same id are one node, whose sets each may be linked. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, borders, forget, join_groups, materialize, mix, small_batches, tidy, word_hashes

#: Members of a bucket, and bytes of their sets, that meet in one cell at most (on average), on each of its two sides.
CELL, CELL_BYTES = 1024, 16 << 20
#: Bits of the filter that stands for a set of ids: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a block's rows, end to end, and the size of each row's set."""
    n = len(at) - 1
    starts, ends = borders(data, at, NOT_SPACE)
    row = np.searchsorted(at, starts, "right") - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = word_hashes(data, starts, ends, True)
    count = np.bincount(row, minlength=n)
    h = np.zeros(len(word), np.uint64)
    own = np.zeros(len(word), np.uint64)  # how many words the shingle that starts here has
    for j in range(k):
        there = np.zeros(len(word), bool)
        m = len(word) - j
        if m > 0:
            there[:m] = row[:m] == row[j:]
            h[there] = mix(h[there] + word[j:][there[:m]])
            own[there] += np.uint64(1)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = (own == k) | (first & (count[row] < k))
    h, row = mix(h[keep] + own[keep]), row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[fresh], np.bincount(row[fresh], minlength=n)


class Minima:
    """count universal hash functions x -> a x + b modulo 2 ** 64, a odd, compared by their high bits."""

    def __init__(self, count: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, np.uint64)

    def of(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(rows, count) minima of each row's set; rows of empty sets are left at the largest value."""
        out = np.full((len(sizes), len(self.a)), np.iinfo(np.uint64).max, np.uint64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        cut = (np.cumsum(sizes) - sizes)[full]
        buf = np.empty(len(h), np.uint64)
        for j in range(len(self.a)):
            np.multiply(h, self.a[j], out=buf)
            np.add(buf, self.b[j], out=buf)
            out[full, j] = np.minimum.reduceat(buf, cut)
        return out


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def sketches(docs: DataFrame, k: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, sig, keys) of each row: set size, fingerprint, low bytes of the minima, a hash for each band."""
    small_batches(docs.sparkSession)

    def run(batches):
        minima = Minima(rows * bands)
        for batch in batches:
            for lo, data, at in blocks(batch.column(1)):
                h, sizes = shingle_sets(data, at, k)
                n = len(sizes)
                least = minima.of(h, sizes)
                f = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                full = np.flatnonzero(sizes)
                if len(full):
                    cut = (np.cumsum(sizes) - sizes)[full]
                    f[0][full] = np.add.reduceat(mix(h + np.uint64(1)), cut)
                    f[1][full] = np.bitwise_xor.reduceat(mix(h + np.uint64(2)), cut)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = mix(key + (least.reshape(n, bands, rows)[:, :, r] >> np.uint64(16)))
                key = mix(key + np.arange(bands, dtype=np.uint64))
                sig = (least >> np.uint64(32)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in f), pa.array([x.tobytes() for x in sig], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))],
                    ["id", "n", "f1", "f2", "sig", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"id {kind}, n long, f1 long, f2 long, sig binary, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str, bits: int = FILTER_BITS) -> DataFrame:
    """(id, f1, hashes) of the rows whose id is in ids, and of few others; hashes are the sorted 64-bit shingles as bytes.

    No text is shuffled: the scan passes over rows by a bit filter of the ids, whose size is fixed; what it lets through
    beyond the ids goes in the joins that follow.
    """
    small_batches(docs.sparkSession)
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(filled)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((held.value[at // 64] >> (at % 64)) & 1 == 1))
            for lo, data, at in blocks(batch.column(1)):
                h, sizes = shingle_sets(data, at, k)
                cut = np.concatenate([[0], np.cumsum(sizes)])
                sets = [h[cut[i] : cut[i + 1]] for i in range(len(sizes))]
                f1 = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), pa.array(f1), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "f1", "hashes"])

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.withColumn("place", place).mapInArrow(tidy(run), f"id {kind}, f1 long, hashes binary").dropDuplicates(["id", "f1"])


def near_components(docs: DataFrame, *, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", rows: int = 7, miss: float = 1e-5) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of docs; sets are linked if 100 * intersection >= percent * union."""
    bands = bands_for(percent / 100, rows, miss)
    kind = docs.schema[id_col].dataType.simpleString()
    seen = materialize(sketches(docs, k, rows, bands, id_col, text_col))
    known = F.col("id").isNotNull() & (F.col("n") > 0)
    live = seen.where(known)
    # A class of equal sets is known by its smallest id, and with f1 wherever one id may have rows with several sets. Equal sets have equal sketches.
    same = ["f1", "f2", "n"]
    heads = materialize(live.groupBy(same).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    bucket = heads.select("id", "f1", "n", F.posexplode("keys").alias("band", "key"))
    shared = materialize(bucket.groupBy("key").agg(F.min(F.struct("id", "f1")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    bucket = materialize(join_groups(bucket, shared, "key", "many").select("key", "id", "f1", "n", "band", F.col("first.id").alias("id2"), F.col("first.f1").alias("g1")))
    salts = _salts(shared.select(F.col("first.id").alias("id2"), F.col("first.f1").alias("g1"), "many"))
    screened = materialize(_screened(bucket, heads.select("id", "f1", "n", "sig"), salts, rows * bands, percent))
    found = materialize(_verified(docs, screened, salts, k, percent, id_col, text_col))
    forget(screened, shared, *([salts] if salts else []))
    group = materialize(_classes(found, heads))
    # Buckets with members of several components.
    held = materialize(bucket.select("key", "id", "f1", "n", "band").join(group.select("id", "f1", "root", F.xxhash64("root").alias("comp")), ["id", "f1"]))
    forget(bucket, found)
    sizes = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * 8).alias("size"))
    total = sizes.groupBy("key").agg(F.max(F.struct("m", "comp", "size")).alias("top"), F.sum("m").alias("all"), F.sum("size").alias("all_size"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    cuts = lambda m, size: F.greatest(F.lit(1), F.ceil(m / CELL), F.ceil(size / CELL_BYTES)).cast("int")
    plan = materialize(total.select("key", "all", F.col("top.comp").alias("major"), cuts(F.col("top.m"), F.col("top.size")).alias("nb"), cuts(F.col("all") - F.col("top.m"), F.col("all_size") - F.col("top.size")).alias("na")))
    spot = F.xxhash64("id", "f1")
    # A pair's first shared band is told by the keys of the bands before this one: low bytes may agree where minima don't.
    at = join_groups(held, plan, "key", "all").join(heads.select("id", "f1", "sig", "keys"), ["id", "f1"]).withColumn("earlier", F.slice("keys", F.lit(1), F.col("band")))
    minor, major = F.col("comp") != F.col("major"), F.col("comp") == F.col("major")
    own = F.pmod(spot, F.when(minor, F.col("na")).otherwise(F.col("nb"))).cast("int")
    everywhere = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
    beside = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(own.alias("a"), (F.col("na") + j).alias("b")))
    under = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: F.struct(j.alias("a"), (F.col("na") + own).alias("b")))
    cells = at.select("key", "band", "id", "f1", "n", "comp", "root", "sig", "earlier", own.alias("own"), major.alias("big"), F.col("na"), F.explode(F.when(minor, F.concat(everywhere, beside)).otherwise(under)).alias("cell"))
    cells = cells.select("key", F.col("cell.a").alias("a"), F.col("cell.b").alias("b"), "band", "id", "f1", "n", "comp", "root", "sig", "earlier", F.when(F.col("big"), F.col("na") + F.col("own")).otherwise(F.col("own")).alias("side"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = f"struct<id: {kind}, f1: bigint>"
    shape = f"key long, a int, b int, band int, id {kind}, f1 long, n long, comp long, root {node}, sig binary, earlier array<long>, side int"
    meeting = cells.repartition(tasks, "key", "a", "b").groupBy("key", "a", "b")
    some = materialize(meeting.applyInArrow(lambda key, t: t.take(pa.array(np.unique(_pairs_in(key, t, bands, rows, percent)))), shape))
    sets = full_sets(docs, some.select("id"), k, id_col, text_col)
    again = some.join(sets, ["id", "f1"]).select("key", "a", "b", "band", "id", "f1", "n", "comp", "root", "sig", "earlier", "side", "hashes").repartition(tasks, "key", "a", "b").groupBy("key", "a", "b")

    def verify(key, t):
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        comp = t.column("comp").to_numpy().copy()
        out = []
        for i, j in _pairs_in(key, t, bands, rows, percent):
            if comp[i] != comp[j] and _linked(full[i], full[j], percent):
                comp[comp == comp[j]] = comp[i]
                out.append((i, j))
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table([t.column("root").take(pa.array(x)) for x in (i, j)], ["a", "b"])

    more = materialize(again.applyInArrow(verify, f"a {node}, b {node}").distinct())
    forget(held, plan, some)
    if more.count():
        merged = group.groupBy("root").agg(F.count(F.lit(1)).alias("many")).join(components(more).select(F.col("id").alias("root"), "comp"), "root", "left")
        merged = materialize(merged.select("root", "many", F.coalesce("comp", "root").alias("last")))
        group = materialize(join_groups(group, merged, "root", "many").drop("root", "many").withColumnRenamed("last", "root"))
    # Rows take the component of their class, without a join by id: that is only needed where an id has rows in several.
    classes = group.select(*same, "copies", F.col("root.id").alias("root"))
    rest = seen.where(known.isNull() | ~known).select("id", "n", F.col("id").alias("root"))
    placed = materialize(join_groups(live.select("id", *same), classes, same, "copies").select("id", "n", "root").unionByName(rest))
    forget(seen, heads, more)
    if placed.groupBy("id").agg((F.min("root") != F.max("root")).alias("several")).agg(F.max("several")).first()[0]:
        comp = components(placed.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b"))
        placed = placed.drop("root").join(comp.withColumnRenamed("comp", "root"), "id", "left")
    component = F.coalesce("root", "id")
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _pairs_in(key: tuple, t: pa.Table, bands: int, rows: int, percent: int) -> np.ndarray:
    """Pairs of rows across the cell's two sides, of different components, that sizes and signatures let pass and whose keys agree in no band before this one."""
    a, b = key[1].as_py(), key[2].as_py()
    side, comp, n, band = (t.column(c).to_numpy() for c in ("side", "comp", "n", "band"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(side), -1)
    earlier = t.column("earlier").combine_chunks().flatten().to_numpy().reshape(len(side), -1 if len(side) and band[0] else 0)
    left, right, out = np.flatnonzero(side == a), np.flatnonzero(side == b), [np.zeros((0, 2), np.int64)]
    least = _least_agreement(bands * rows, percent)
    for lo in range(0, len(left), 32):
        i, j = (x.ravel() for x in np.meshgrid(left[lo : lo + 32], right, indexing="ij"))
        fits = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
        fits &= (i < j) if a == b else True
        i, j = i[fits], j[fits]
        fits = (sig[i] == sig[j]).sum(1) >= least
        i, j = i[fits], j[fits]
        first = ~(earlier[i] == earlier[j]).any(1)
        out.append(np.stack([i[first], j[first]], 1))
    return np.concatenate(out)


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(p) + len(q) - common)


def _least_agreement(width: int, percent: int) -> int:
    """Agreeing minima of a pair at the threshold, less six standard deviations."""
    t = percent / 100
    return max(1, int(width * t - 6 * math.sqrt(width * t * (1 - t))))


def _salts(partners: DataFrame, size: int = 1000) -> DataFrame | None:
    """(id2, g1, salts) of the partners of very many, given how many each bucket brings them; None if there are none."""
    many = partners.groupBy("id2", "g1").agg(F.sum("many").alias("many"))
    total, largest = many.agg(F.sum("many"), F.max("many")).first()
    least = max(size, (total or 0) // 50_000)
    return materialize(many.where(F.col("many") > least).select("id2", "g1", F.ceil(F.col("many") / size).cast("int").alias("salts"))) if (largest or 0) > least else None


def _spread(pairs: DataFrame, salts: DataFrame | None):
    """pairs with a salt, a function that copies a table of (id2, g1) for each salt, and what they are joined by: of a partner of very many, at most about 1 000 meet in one place."""
    if salts is None:
        return pairs, lambda t: t, ["id2", "g1"]
    hot, n = F.broadcast(salts), F.coalesce("salts", F.lit(1))
    salted = pairs.join(hot, ["id2", "g1"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "f1"), n).cast("int")).drop("salts")
    return salted, lambda t: t.join(hot, ["id2", "g1"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts"), ["id2", "g1", "salt"]


def _screened(bucket: DataFrame, sigs: DataFrame, salts: DataFrame | None, width: int, percent: int) -> DataFrame:
    """Pairs of a class and the first of one of its buckets, (id2, g1), whose sizes and signatures allow a link."""
    least = _least_agreement(width, percent)
    # A class has no more firsts than bands; kept together, they take its signature in one row.
    firsts = bucket.where("id != id2 or f1 != g1").groupBy("id", "f1").agg(F.collect_set(F.struct("id2", "g1")).alias("firsts"))
    pairs = firsts.join(sigs, ["id", "f1"]).select("id", "f1", "n", "sig", F.explode("firsts").alias("p")).select("id", "f1", "n", "sig", "p.id2", "p.g1")
    pairs, copied, on = _spread(pairs, salts)
    both = pairs.join(copied(sigs.select(F.col("id").alias("id2"), F.col("f1").alias("g1"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))), on)
    both = both.where(F.least("n", "n2") * 100 >= percent * F.greatest("n", "n2"))
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, width) for i in (4, 5))
            yield b.select([0, 1, 2, 3]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("id", "f1", "id2", "g1", "sig", "sig2").mapInArrow(tidy(run), f"id {kind}, f1 long, id2 {kind}, g1 long")


def _verified(docs: DataFrame, pairs: DataFrame, salts: DataFrame | None, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    kind = pairs.schema["id"].dataType.simpleString()
    ids = pairs.select("id").unionByName(pairs.select(F.col("id2").alias("id")))
    # Not written: both joins take the sets as full_sets deals them out, so they are shuffled once for the two.
    sets = full_sets(docs, ids, k, id_col, text_col)
    pairs, copied, on = _spread(pairs, salts)
    both = pairs.join(sets, ["id", "f1"]).join(copied(sets.select(F.col("id").alias("id2"), F.col("f1").alias("g1"), F.col("hashes").alias("other"))), on)

    def run(batches):
        for b in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return both.select("id", "f1", "id2", "g1", "hashes", "other").mapInArrow(tidy(run), f"id {kind}, f1 long, id2 {kind}, g1 long")


def _classes(found: DataFrame, heads: DataFrame) -> DataFrame:
    """(f1, f2, n, id, copies, root) of every class; root is the smallest class, (id, f1), of its component, itself where nothing is linked."""
    node = F.struct("id", "f1")
    edges = found.select(node.alias("a"), F.struct(F.col("id2").alias("id"), F.col("g1").alias("f1")).alias("b")).where("a != b")
    roots = components(edges).select(F.col("id").alias("node"), F.col("comp").alias("root"))
    return heads.select("f1", "f2", "n", "id", "copies", node.alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of the edges (a, b): the smallest node that it reaches.

    Large-star links the larger neighbours of each node to the smallest of the node and its neighbours; small-star links
    the node and its smaller neighbours to that smallest. They alternate until all edges lead straight to a smallest node, which
    neither would change; edges that do so from the start take no round. What a node with very many neighbours has is broadcast
    to their rows, so its edges needn't meet in one task.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("many")))
        wide = materialize(join_groups(both.where("b > a"), least, "a", "many").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        forget(edges, least)
        least = materialize(wide.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("many")))
        down = join_groups(wide, least, "a", "many").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = materialize(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(wide, least)
    return edges.withColumnsRenamed({"a": "id", "b": "comp"}).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end a has one edge only, to a node b that is no larger end itself; all edges have a > b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    bent = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or ups = 1 and downs = 1")
    return bent.agg(F.count(F.lit(1))).first()[0] == 0


def keep_one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = 6, miss: float = 1e-5) -> DataFrame:
    """The rows of docs, all columns as they are, without those whose id isn't the smallest of its component."""
    found = near_components(docs, k=k, percent=percent, id_col=id_col, text_col=text_col, rows=rows, miss=miss)
    gone = materialize(found.where(~F.col("kept")).select(F.col(id_col)).distinct())
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
