"""The training-data operators against brute force, the libraries, and odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import ann, chat, class_lm, common, decontam, neardup, pieces, quality, queries, token_counts, toxicity, warc
from granary.llm.common import bounded_sample, crc_mod, hash_word

ODD = [(1, ""), (2, None), (3, "   \t\n"), (4, "x" * 30000), (5, "same words here"), (6, "same words here"), (6, "same words here"), (None, "no id at all"), (8, "日本語 テスト é 😀"), (9, " ".join(f"w{i}" for i in range(8000)))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, 7, "clash") for i, t in ODD], "doc_id long, text string, score double, n_tokens int, h string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (6, 1, 0), (6, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers_take_odd_rows(spark, odd, none, labels):
    for model, score, keep in ((quality.fit_quality(odd, labels), quality.score_quality, quality.keep_quality), (toxicity.fit_toxicity(odd, labels), toxicity.score_toxicity, toxicity.drop_toxic)):
        rows = score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert score(none, model).count() == 0 and keep(odd, model).columns == odd.columns
    assert toxicity.fit_toxicity(none, labels).link[0] == -50 and quality.fit_quality(none, labels).bias == 0


def test_a_huge_labelled_text_does_not_end_the_sample(spark):
    ids = [r.id for r in spark.range(60).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    huge = {ids[0], next(i for i in ids if i % 2 != ids[0] % 2)}
    text = F.when(F.col("id").isin(*huge), F.repeat(F.lit("very long "), 100)).when(F.col("id") % 2 == 1, "you moron go away").otherwise("calm words about rivers")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    for per_class in (True, False):
        got = {r.id for r in bounded_sample(docs, labels, "toxic", F.lit(True), "doc_id", "text", 100, 900 if per_class else 1800, per_class).collect()}
        assert got == set(ids) - huge if per_class else len(got) > 30
    one = bounded_sample(docs.where(F.col("doc_id").isin(*huge)), labels, "toxic", F.lit(True), "doc_id", "text", 100, 900, True)
    assert {r.id for r in one.collect()} == huge


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, crc_mod("id", 5) != 0)
    rows = quality.score_quality(docs, model).where(crc_mod("doc_id", 5) == 0).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_chain_is_the_brute_force_marginal():
    rng = np.random.default_rng(3)
    row, emit, step = np.array([0, 0, 0, 0, 1, 2, 2]), rng.normal(size=7), rng.normal(size=(2, 2))
    want = []
    for r in range(3):
        e = emit[row == r]
        n = len(e)
        paths = [[(b >> i) & 1 for i in range(n)] for b in range(1 << n)]
        weight = np.exp([sum(e[i] for i in range(n) if p[i]) + sum(step[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        want += [sum(w for w, p in zip(weight, paths, strict=True) if p[i]) / weight.sum() for i in range(n)]
    assert np.allclose(toxicity.chain(emit, row, step), want)


def test_toxic_spans_have_offsets(spark):
    docs = spark.createDataFrame([(i, ("é calm words about rivers and hills today " if i % 2 else "é you moron go away now ") + f"n{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert rows[0].predicted == 1 and rows[1].predicted == 0
    assert any("é you moron go away now n0"[s.begin : s.end].find("moron") >= 0 for s in rows[0].spans)


def test_class_lm_is_a_distribution_and_takes_odd_rows(spark, odd, none):
    model, tail = class_lm.fit_class_lm(odd, F.lit(True), items=5, classes=4, head=3)
    rows = class_lm.score_class_lm(odd, model, tail, F.lit(False)).collect()
    assert sorted(r.n_tokens for r in rows)[:3] == [1, 1, 1] and len(rows) == len(ODD)
    assert np.allclose((10**model.step).sum(1), 1)
    model, tail = class_lm.fit_class_lm(none, F.lit(True))
    assert class_lm.score_class_lm(odd, model, tail, F.lit(True)).where("n_known > 0").count() == 0


def test_words_beyond_the_seeds_have_classes_of_their_own(spark):
    rng = random.Random(4)
    texts = [" ".join(f"{'ab'[j % 2]}{rng.randrange(40)}zz" for j in range(40)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, tail = class_lm.fit_class_lm(docs, F.lit(True), items=6, classes=5)
    own = {}
    for c in "ab":
        at = np.searchsorted(model.items, np.array([hash_word(f"{c}{i}zz") for i in range(40)], np.uint64).view(np.int64))
        own[c] = set(model.own[at].tolist())
    assert len(model.items) == 80 and not own["a"] & own["b"]
    rows = class_lm.score_class_lm(docs, model, tail, F.lit(False)).collect()
    assert np.mean([r.perplexity for r in rows]) < 50


def test_base_score(spark):
    texts = ["a b b", "B c", "", "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, tail = class_lm.fit_class_lm(docs, F.col("doc_id") < 2, items=2, classes=3, head=2)
    c = Counter(w for t in texts[:2] for w in [*t.lower().split(), None])
    for r in class_lm.score_class_lm(docs, model, tail, F.col("doc_id") >= 2).collect():
        want = sum(np.log10((c[w] + 1) / (c.total() + len(c) + 1)) for w in [*texts[r.doc_id].lower().split(), None])
        assert abs(r.base_score - want) < 1e-9 and r.train_tokens == c.total()


def test_warc_round_trip_and_merge(spark):
    rows = [(3, "http://b.org/x", "<p>é</p>"), (1, "https://www.a.com/?q=1", "<p>é</p>"), (2, None, None), (5, "http://a.com/", ""), (None, "http://[bad", "z"), (4, "http://a.com/\n", "y" * 50000)]
    got = {r.page_id: r for r in warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert len(got) == len(rows) and got[3].refers_to == 1 and got[3].record_type == "revisit" and got[5].refers_to == 2
    assert all(got[i].payload_digest == digest(h or "") and got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    assert warc.capture_histories(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rng = random.Random(1)
    runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(9))) for i in range(7)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pieces_are_the_librarys(spark, odd):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd.where("doc_id is not null").limit(9)
    rows = pieces.encode_pieces(docs, path).collect()
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    for r in rows:
        own = [t for i, t in texts if i == r.doc_id][0]
        ids = lib.encode(own)
        assert r.ids == ids and r.decoded == lib.decode(ids) and r.n_tokens == len(ids)
    coder = pieces.PieceCodec(path)
    for t in ("▁x", "<s> </s> <0x41>", "\x00�", " " * 40, "a  b\n\n c", "0" * 500):
        assert coder.encode(t) == lib.encode(t) and coder.decode(lib.encode(t)) == lib.decode(lib.encode(t))
    coder.lib = type("wrong", (), {"encode": lambda self, x, num_threads: [[1]] * len(x)})()
    with pytest.raises(RuntimeError):
        coder.remember([["▁fresh"]])


def test_length_histogram(spark):
    n = [0, 3, 3, 5, 2000, 7, 5, 5]
    hist = token_counts.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    for r in hist.collect():
        assert (r.n_docs, r.docs_longer, r.truncated_tokens, r.total_tokens) == (n.count(r.n_tokens), sum(x > r.n_tokens for x in n), sum(min(x, r.n_tokens) for x in n), sum(n))
    assert token_counts.truncated_total(hist, 4).first().truncated_tokens == sum(min(x, 4) for x in n)
    assert token_counts.length_quantile(hist, 0.5).first().n_tokens == 5
    assert token_counts.length_histogram(hist.select("n_tokens").where("false")).count() == 0


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    own = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and own[b] < own[a]:
                    own[a], changed = own[b], True
    return {i: (len(sets[i]), own[i]) for i in sets}


def test_near_components_match_brute_force(spark, odd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = []
    for i in range(90):
        words = list(base) if i % 3 else [f"v{rng.randrange(9)}" for _ in range(40)]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_components(docs, k=3, percent=70, rows=4).collect()}
    assert got == brute_components(texts, 3, 70)
    rows = neardup.near_components(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert neardup.keep_one_of_each(odd).columns == odd.columns


def test_cells_meet_every_pair_once():
    rng = np.random.default_rng(6)
    bands, rows, n = 30, 7, 3000
    x = rng.integers(0, 1 << 63, (n, bands, rows), np.uint64)
    y = np.where(rng.random(x.shape) < 0.85, x, rng.integers(0, 1 << 63, x.shape, np.uint64))
    keys = [np.array([[hash(b.tobytes()) for b in d] for d in z]) for z in (x, y)]
    lost = twice = met = 0
    for i in range(n):
        found = 0
        shared = np.flatnonzero(keys[0][i] == keys[1][i])
        for band in shared:
            sig = [(z[i].ravel() >> np.uint64(32)).astype(np.uint8).tobytes() for z in (x, y)]
            t = pa.table({"side": [0, 0], "comp": [1, 2], "n": [100, 100], "band": [int(band)] * 2, "sig": sig, "earlier": pa.array([k[i][:band].tolist() for k in keys], pa.list_(pa.int64()))})
            found += len(neardup._pairs_in((pa.scalar(1), pa.scalar(0), pa.scalar(0)), t, bands, rows, 85))
        met += len(shared) > 0
        lost += len(shared) > 0 and not found
        twice += found > 1
    assert met > 0.99 * n and (lost, twice) == (0, 0)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.comp for r in neardup.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[700:760] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [1.0, 2.0]), (None, [1.0] * 24), (9006, [1e9] * 23 + [None])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    exact = x @ x.T
    hits = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        order = [i for i in np.lexsort((np.arange(1500), -np.round(exact[q], 9))) if i != q][:20]
        hits += len({r.vec_id for r in own} & set(order))
        assert [r.score for r in own] == sorted((r.score for r in own), reverse=True) and len(own) == 20
    assert hits / (75 * 20) >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\|x|> <|user|>", "<\\\\/s>", "<<SYS>> <</SYS>> <s>", "", None]
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and not re.search(r"</s>|\[INST\]|<\|", chat.escape(t or ""))
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us|er", t) for i, t in enumerate(texts)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.fold_conversations(chat.format_chat(turns)).collect()}
    joined = "".join(f"{'assistant' if i % 2 else 'us|er'}\n{t or ''}\n" for i, t in enumerate(texts))
    learnt = "".join(t or "" for t in texts[1::2])
    assert rows[1].turns_sha256 == hashlib.sha256(joined.encode()).hexdigest() and rows[1].loss_chars == len(learnt) and rows[1].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert rows[None].n_turns == 1
    text, _, _, parts = chat.format_turn("user", [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 2}])
    assert text == "<|user|>see <|image:0|><|audio:1|></s>" and [p["tokens"] for p in parts] == [4, 50]


def test_decontamination_matches_brute_force(spark, odd):
    rng = random.Random(8)
    item = [f"b{rng.randrange(50)}" for _ in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item"), (3, None), (None, "no name"), (10, " ".join(item[:13]))], "item_id long, text string")
    texts = [(i, " ".join([f"d{rng.randrange(30)}" for _ in range(rng.randrange(40))] + (item[a : a + n] if i % 2 else ["Tiny,", "ITEM!"]) + ["no", "name"] * (i % 3))) for i, a, n in ((i, rng.randrange(6), rng.randrange(10, 15)) for i in range(30))]
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    windows = {tuple(item[j : j + 13]): {1} for j in range(8)} | {("tiny", "item"): {2}, ("no", "name"): set()}
    windows[tuple(item[:13])] = {1, 10}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        hit, items = set(), set()
        for n in (13, 2):
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    items |= own
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)), i
    assert decontam.contamination(odd, bench).count() == len(ODD) and decontam.contamination(odd, bench.where("false")).where("n_hit > 0").count() == 0
    sliced = decontam.contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench, slice_rows=3, verify_bytes=0).collect()
    assert sorted(map(str, sliced)) == sorted(map(str, got.values()))
    assert decontam.drop_contaminated(odd, bench).columns == odd.columns


def test_pipeline_keeps_columns_and_drops_contaminated(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.decontaminate(spark, docs, d)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def written(monkeypatch, spark, run):
    """What run gives, how many tables it wrote on the way, and how many jobs it took."""
    tables, real, group = [], neardup.materialize, f"written-{id(run)}"
    monkeypatch.setattr(neardup, "materialize", lambda df: tables.append(real(df)) or tables[-1])
    spark.sparkContext.setJobGroup(group, group)
    out = run().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(tables), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_components_of_stars_take_no_round(spark, monkeypatch):
    stars = spark.createDataFrame([(i, 10 * (i // 10)) for i in range(50)] + [(7, 0)], "a long, b long")
    out, tables, _ = written(monkeypatch, spark, lambda: neardup.components(stars))
    assert sorted(map(tuple, out)) == [(i, 10 * (i // 10)) for i in range(50)] and tables == 1  # nine before
    # A middle node, a node with two smaller ones, and a star whose middle isn't its smallest node.
    for edges, comp in (([(1, 2), (2, 3)], 1), ([(1, 3), (2, 3)], 1), ([(5, 9), (5, 2), (5, 7)], 2)):
        out, tables, _ = written(monkeypatch, spark, lambda e=edges: neardup.components(spark.createDataFrame(e, "a long, b long")))
        assert sorted(map(tuple, out)) == [(x, comp) for x in sorted({x for e in edges for x in e})] and 5 <= tables <= 9


def test_join_groups_with_and_without_large_keys(spark):
    rows = spark.createDataFrame([(0, i) for i in range(1500)] + [(i, i) for i in range(1, 50)] + [(99, 0), (None, 1)], "k int, v int")
    groups = spark.createDataFrame([(i, 1500 if i == 0 else 1, f"g{i}") for i in range(50)], "k int, many int, g string")
    whole = sorted([(0, i, 1500, "g0") for i in range(1500)] + [(i, i, 1, f"g{i}") for i in range(1, 50)])
    for g, want in ((groups, whole), (groups.where("k > 0"), [r for r in whole if r[0]]), (groups.where("k < 0"), [])):
        out = common.join_groups(rows, g, "k", "many")
        assert out.columns == ["k", "v", "many", "g"] and sorted(map(tuple, out.collect())) == want


def near_copies(seed, n, words=60, changed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changed)):
            own[rng.randrange(words)] = f"x{rng.randrange(99)}"
        yield " ".join(own)


def test_near_components_of_repeated_ids_and_classes_of_copies(spark):
    """Ids with several sets join the components of all of them, an empty text's row goes with its id, and copies with their class."""
    texts = [(i % 25 + 100 * (i > 70), t) for i, t in enumerate([*near_copies(1, 40), *near_copies(2, 40)])] + [(i, "the same few words") for i in range(200, 230)]
    texts += [(3, ""), (124, None), (230, " "), (229, "one more text of its own")]
    got = neardup.near_components(spark.createDataFrame(texts, "doc_id long, text string"), k=3, percent=70, rows=4).collect()
    sets, own = {}, {i: i for i, _ in texts}
    for at, (i, t) in enumerate(texts):
        sets[at] = i, brute_components([(at, t)], 3, 70)[at][0], {tuple(w) for w in (((t or "").split()[j : j + 3]) for j in range(max(1, len((t or "").split()) - 2))) if w}
    changed = True
    while changed:
        changed = False
        for i, _, x in sets.values():
            for j, _, y in sets.values():
                if x and 100 * len(x & y) >= 70 * len(x | y) and own[i] != own[j]:
                    own[i] = own[j] = min(own[i], own[j])
                    changed = True
    assert sorted(map(tuple, got)) == sorted((i, n, own[i], own[i] == i) for i, n, _ in sets.values())


def test_near_components_with_a_partner_of_very_many(spark, monkeypatch):
    """What is salted and broadcast where a bucket's first has very many members gives the same rows."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near_copies(3, 60), *near_copies(4, 60)])], "doc_id long, text string")
    plain = sorted(map(tuple, neardup.near_components(docs, k=3, percent=70, rows=4).collect()))
    real, spread = neardup._salts, []
    monkeypatch.setattr(neardup, "_salts", lambda partners: spread.append(partners) or real(partners.withColumn("many", F.col("many") * 1000)))
    assert sorted(map(tuple, neardup.near_components(docs, k=3, percent=70, rows=4).collect())) == plain and len(spread) == 1


def test_near_components_takes_few_jobs_and_tables(spark, monkeypatch):
    """With very many partitions each of them costs, whatever the rows."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near_copies(5, 30), *near_copies(6, 30)])], "doc_id long, text string").cache()
    docs.count()
    out, tables, jobs = written(monkeypatch, spark, lambda: neardup.near_components(docs, k=3, percent=70, rows=4))
    assert len(out) == 60 and tables <= 20 and jobs <= 100  # 28 and 127 before
