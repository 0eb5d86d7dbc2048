"""Models against plain re-computation, and the rows that the docstrings promise a result for."""

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from granary.llm import ann, chat, class_lm, common, decontam, neardup, pieces, pipeline, quality, queries, token_counts, toxicity, warc


def block(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])


def test_hashes_of_long_texts_are_those_of_their_words(monkeypatch):
    words = ["Äpfel", "x" * 700, "b", "日本" * 90, "b"]
    want = [common.hash_word(w) for w in words]
    monkeypatch.setattr(common, "SLICE", 64)
    monkeypatch.setattr(common, "_powers", [])
    data, at = block([" ".join(words)])
    starts, ends = common.borders(data, at, common.NOT_SPACE)
    got = common.word_hashes(data, starts, ends, True)
    assert got.tolist() == want and got[2] == got[4]


def test_quality_features_by_characters(monkeypatch):
    texts = ["naïve naïve 日本語", "", "ab", "naïve naïve 日本語"]
    data, at = block(texts)
    whole = [sorted(b[r == i].tolist()) for r, b in [tuple(map(np.concatenate, zip(*quality.features(data, at, 1 << 16), strict=True)))] for i in range(4)]
    # Words, pairs of words, and for each character one run of three and, where another follows in its word, one of four.
    assert [len(w) for w in whole] == [3 + 2 + 13 + 10, 0, 1 + 2 + 1, 28] and whole[0] == whole[3]
    monkeypatch.setattr(quality, "SLICE", 7)
    cut = [sorted(b[r == i].tolist()) for r, b in [tuple(map(np.concatenate, zip(*quality.features(data, at, 1 << 16), strict=True)))] for i in range(4)]
    assert cut == whole


def test_quality_score_is_the_softmax_of_the_averaged_vectors():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=1 << 10).astype(np.float32), 0.3)
    texts = ["one two two", "", "three"]
    got = model.scores(pa.array(texts))
    for t, s in zip(texts, got, strict=True):
        b = np.concatenate([b for _, b in quality.features(*block([t]), 1 << 10)])
        assert abs(s - 1 / (1 + np.exp(-(model.logits[b].mean() if len(b) else 0) - 0.3))) < 1e-6


def test_expected_pairs_of_tags_are_brute_force():
    rng = np.random.default_rng(4)
    emit, step, row = rng.normal(size=5), rng.normal(size=(2, 2)), np.zeros(5, np.int64)
    paths = np.array([[(b >> i) & 1 for i in range(5)] for b in range(32)])
    weight = np.exp([(emit * p).sum() + sum(step[a, b] for a, b in zip(p[:-1], p[1:], strict=True)) for p in paths])
    weight /= weight.sum()
    got = toxicity._pairs(toxicity.chain(emit, row, step), step)
    for i in range(4):
        for a in (0, 1):
            for b in (0, 1):
                assert abs(got[i, a, b] - weight[(paths[:, i] == a) & (paths[:, i + 1] == b)].sum()) < 1e-9


def brute_likelihood(bigrams, own, classes):
    n = np.zeros((classes, classes))
    np.add.at(n, (own[:, None], own[None, :]), bigrams)
    return class_lm.likelihood(n)


def test_exchange_only_raises_the_likelihood_and_finds_the_best_move():
    rng = np.random.default_rng(5)
    m, classes = 30, 5
    bigrams = rng.poisson(1.5, (m, m)).astype(float)
    own = class_lm.exchange(bigrams, classes, 100)
    start = np.append(1 + np.arange(m - 1) % (classes - 1), 0)
    base = brute_likelihood(bigrams, own, classes)
    assert base >= brute_likelihood(bigrams, start, classes) and own[-1] == 0 and (own[:-1] > 0).all()
    for w in range(m - 1):
        for c in range(1, classes):
            other = own.copy()
            other[w] = c
            assert brute_likelihood(bigrams, other, classes) <= base + 1e-6


@pytest.mark.parametrize("scale", [1, 60])
def test_best_classes_are_brute_force(scale):
    rng = np.random.default_rng(6)
    m, classes = 40, 6
    bigrams = rng.poisson(1.0, (m, m)) * scale
    np.fill_diagonal(bigrams, 0)
    own = np.append(1 + np.arange(m - 1) % (classes - 1), 0)
    n = np.zeros((classes, classes))
    np.add.at(n, (own[:, None], own[None, :]), bigrams)
    rows = [(w, k, int(c)) for w in range(m - 1) for side, counts in ((0, bigrams[w]), (classes, bigrams[:, w])) for k, c in enumerate(np.bincount(own, counts, classes)) if c for k in [k + side]]
    w, k, c = (np.array(x) for x in zip(*sorted(rows), strict=True))
    word, best = class_lm.best_classes(w, k, c, own, n, class_lm.gains_of(n))
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for i, to in zip(word, best, strict=True):
        a, right, left = own[i], np.bincount(own, bigrams[i], classes), np.bincount(own, bigrams[:, i], classes)
        rest = n.copy()
        gains = []
        for b in range(classes):
            out, into = (n[b] - right if b == a else n[b]), (n[:, b] - left if b == a else n[:, b])
            gain = (f(np.maximum(out, 0) + right) - f(np.maximum(out, 0)))[right > 0].sum() + (f(np.maximum(into, 0) + left) - f(np.maximum(into, 0)))[left > 0].sum()
            ro, co = rest.sum(1)[b] - (right.sum() if b == a else 0), rest.sum(0)[b] - (left.sum() if b == a else 0)
            gains.append(gain - f(max(ro, 0) + right.sum()) + f(max(ro, 0)) - f(max(co, 0) + left.sum()) + f(max(co, 0)))
        gains[0] = -np.inf
        assert gains[to] >= max(gains) - 1e-6


def test_lengths_are_those_of_plain_byte_pair_merging():
    import base64

    import public_tokenizers

    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    own = token_counts.counter(path, public_tokenizers.PATTERN)
    for text in ("", "Hello  world, it's 12345!\n\n", "日本語 é 😀", "x" * 300, "tab\tand  spaces   "):
        n = 0
        for piece in regex.findall(public_tokenizers.PATTERN, text):
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if parts[at] + parts[at + 1] not in ranks:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            n += len(parts)
        assert own.length(text) == n


def test_url_keys_never_fail():
    assert warc.url_key("https://User@WWW.Example.org:8080/A?b=[1]#c") == "org,example)/a?b=[1]"
    assert warc.url_key("http://h/x?q=[1]") != warc.url_key("http://g/x?q=[1]")
    for url in ("http://a]b/x", "http://[::1]:80/x", "http://℀.com/", None, "", "no host", "//", "http://[bad"):
        assert isinstance(warc.url_key(url), str)


def test_warc_takes_a_hot_payload_repeated_ids_and_extra_columns(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id") % 7).alias("url"), F.when(F.col("id") % 3 > 0, "<p>404</p>").otherwise(F.concat(F.lit("p"), "id")).alias("html"), F.lit(1).alias("digest"), F.lit("k").alias("key"))
    got = warc.capture_histories(pages.unionByName(pages.where("page_id in (0, 1)")))
    assert got.count() == 3002 and {tuple(r) for r in got.where("record_type = 'revisit' and page_id != 0").select("refers_to").distinct().collect()} == {(1,)}


def test_ann_takes_repeated_ids_other_lengths_and_slices(spark):
    rows = [(20, [2.0, 1.0]), (20, [1.0, 0.0]), (7, [3.0, 1.0]), (7, [2.0, 1.0]), (None, [5.0, 5.0]), (40, [1.0, 1.0, 1.0]), (41, [2.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, row int, code string")
    for size in (16 << 20, 64):
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(docs, F.col("vec_id") % 20 == 0, k=3, slice_bytes=size).collect()}
        assert got == {(20, 1, None, 15.0), (20, 2, 7, 7.0), (20, 3, 7, 5.0), (20, 1, None, 5.0), (20, 2, 7, 3.0), (20, 3, 7, 2.0), (40, 1, 41, 2.0)}


def test_ann_recall_where_codes_decide():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ann.BATCH_ROWS, 48)) * rng.lognormal(0, 0.4, (ann.BATCH_ROWS, 1))
    book, at = ann.train_quantiser(x), np.arange(len(x))
    query, vec, _ = ann.best_of(at, at, x, book.encode(x), book, at[::50], x[::50], 20, 200)
    exact = x[::50] @ x.T
    exact[np.arange(len(exact)), at[::50]] = -np.inf
    hits = sum(len(set(vec[query == i]) & set(np.argsort(-e)[:20])) for i, e in enumerate(exact))
    assert hits / (20 * len(exact)) >= 0.9


def test_typed_contents_through_spark(spark):
    odd = ['[{"type": "text", "text": "a <"}, {"type": "text", "text": "|x|>"}, {"type": "image", "width": "wide"}, null, {"type": "video", "ref": 3}, {"type": "document", "pages": 2}]', "{not json", '"bare"', "[]", None, '{"type": "audio", "seconds": 1e99}']
    turns = spark.createDataFrame([(1, i, "user", t, "clash") for i, t in enumerate(odd)], "conv_id long, turn long, role string, text string, formatted string")
    rows = sorted(chat.format_chat(turns, typed=True).collect(), key=lambda r: r.turn)
    assert rows[0].formatted == "<|user|>a <\\|x|><|image:0|><|unknown:1|><|document:2|></s>" and [a.tokens for a in rows[0].attachments] == [1, 1, 800]
    assert [r.formatted for r in rows[1:5]] == ["<|user|>{not json</s>", "<|user|>bare</s>", "<|user|></s>", "<|user|></s>"]
    assert chat.fold_conversations(chat.format_chat(turns, typed=True)).first().attachments == 4


def test_cut_spans_keeps_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha, beta gamma! y", 5), (1, "x alpha, beta gamma! y", 5), (None, "alpha beta gamma", 6), (2, None, 7), (3, "clean words", 8)], "doc_id long, text string, spans int")
    got = sorted(map(str, decontam.cut_spans(docs, bench).select("doc_id", "text").collect()))
    assert got == sorted(["Row(doc_id=1, text='x! y')"] * 2 + ["Row(doc_id=None, text='')", "Row(doc_id=2, text=None)", "Row(doc_id=3, text='clean words')"])


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, row int, h string, keys string")
    path = queries.vocabulary("piece_bpe_32k.model")
    assert pieces.encode_pieces(none, path).count() == 0 and neardup.near_components(none).count() == 0
    assert decontam.contamination(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert chat.fold_conversations(chat.format_chat(none.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"), "text"))).count() == 0
    ids = spark.createDataFrame([(1, [5, 7], "x"), (2, None, "y")], "doc_id long, ids array<int>, text string")
    assert {r.doc_id: r.text for r in pieces.decode_pieces(ids, path).collect()}[2] == ""


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("extra", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns
        kept = common.materialize(kept)
        assert 0 < kept.count() <= docs.count() and kept.join(docs, docs.columns, "left_anti").count() == 0
        docs = kept
    out = pipeline.encode(spark, docs, d)
    assert out.count() == docs.count()
    ids = {r.doc_id for r in out.collect()}
    assert ids == {r.doc_id for r in pipeline.run(spark, d).collect()}
