"""Very long texts, independence of the session's settings, and the latent tags of the toxicity field."""

import hashlib
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import ann, pieces, token_counts, toxicity
from granary.llm.common import blocks, regrouped


def test_long_blank_runs_have_the_lengths_of_plain_merging(spark):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = token_counts.counter(path, pattern)
    whole = own.encode
    assert isinstance(whole.__self__, tiktoken.Encoding)
    for n in (9_999, 10_000, 10_001, 40_000):
        for run in (" " * n, "\n" * n, " \n\t" * (n // 3), "　 " * (n // 2)):
            for text in (run, "a" + run, run + "b", "it's" + run + " 12" + run + ".", run + "\x1c" + run):
                assert own.length(text) == len(whole(text))
    docs = spark.createDataFrame([(1, "a" + " " * 5_000_000 + "b"), (2, " " * 1_000_000), (3, "x")], "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id = 3"))
    # The vocabulary's longest run of spaces is counted by merging the run alone.
    alone = lambda n: len(own.encode_piece(b" " * n))
    assert sorted(r.n_tokens for r in token_counts.encoded_lengths(docs, path, pattern).collect()) == sorted([1 + alone(4_999_999) + len(whole(" b")), alone(1_000_000), 1, 1])


def test_texts_longer_than_a_slice_have_the_librarys_ids(spark, monkeypatch):
    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    coder = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", None, " ", "▁", "a" * 500, "word " * 60, "  two  spaces  " * 20, "▁ ▁mixed▁marks " * 15, "é漢字 " * 40 + "🙂🙂" * 30, " lead", "x\n\ny " * 50]
    for keep in (False, True):
        for text, r in zip(texts, coder.each(texts, keep), strict=True):
            ids = coder.lib.encode(text or "")
            assert r.n_tokens == len(ids), text
            assert r.ids.hexdigest() == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.bytes.hexdigest() == hashlib.sha256(coder.lib.decode(ids).encode()).hexdigest()
            if keep:
                assert b"".join(r.kept[1]).decode() == coder.lib.decode(ids)
    assert all("".join(p for p, _ in pieces.sliced(t, 7)) == t for t in texts if t)
    long = " ".join(f"w{i % 9000}" for i in range(400_000))
    monkeypatch.undo()
    docs = spark.createDataFrame([(1, long), (2, long), (3, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).collect()}
    ids = coder.lib.encode(long)
    assert rows[1].ids_sha256 == rows[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and rows[1].n_tokens == len(ids)


def test_scores_of_long_texts_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(rng.normal(0, 1, 1 << 10).astype(np.float32), rng.normal(0, 1, (2, 2)), -1.0, np.array([0.1, 0.2, 0.3]))
    texts = pa.array([" ".join(rng.choice(["ab", "abcdef", "ghijklmnop", "x"], n)) for n in (0, 1, 2, 700, 50)])
    whole = model.scores(texts)
    for size in (1, 3, 64):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        assert np.allclose(model.scores(texts), whole, rtol=0, atol=1e-12)


def test_nearest_rows_do_not_depend_on_the_session(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (3000, 16)))], "vec_id long, embedding array<float>").repartition(3)
    found = []
    for most in ("10000", "700", "64"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        found.append(sorted(map(tuple, ann.nearest(rows, F.col("vec_id") % 100 == 0, k=5, shortlist=20).collect())))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == most
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and len(found[0]) == 150


def test_regrouped_batches():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (3, 0, 10, 1, 7)]
    tables = list(regrouped(batches, 4))
    assert [t.num_rows for t in tables] == [4, 4, 4, 4, 4, 1] and sum((t.column("a").to_pylist() for t in tables), []) == [*range(3), *range(10), 0, *range(7)]
    assert all(t.num_rows <= 2 for t in regrouped(batches, 4, 16)) and list(regrouped([], 4)) == []


# --- latent tags -------------------------------------------------------------------------------------------------------


def features(texts):
    out = []
    for _, data, at in blocks(pa.array(texts)):
        _, _, row, f = toxicity.token_features(data, at)
        cut = np.searchsorted(row, np.arange(len(at)))
        out += [f[cut[i] : cut[i + 1]] for i in range(len(at) - 1)]
    return out


def sequences(emit, step):
    """(tags, weight) of every sequence of tags."""
    for tags in itertools.product((0, 1), repeat=len(emit)):
        score = sum(e for e, t in zip(emit, tags, strict=True) if t) + sum(step[a, b] for a, b in zip(tags, tags[1:], strict=False))
        yield np.array(tags), np.exp(score)


def test_document_scores_and_expected_tags_are_those_of_all_sequences():
    rng = np.random.default_rng(5)
    model = toxicity.ToxicityModel(rng.normal(0, 0.7, 1 << 8).astype(np.float32), rng.normal(0, 1, (2, 2)), -0.5)
    texts = ["alpha beta gamma delta", "one", "beta beta beta beta beta beta", "x yy zzz"]
    feats = features(texts)
    ys = np.array([1, 1, 0, 1])
    tags, pairs = toxicity.expected(model, feats, ys, 0.1)
    for f, y, tag, pair in zip(feats, ys, tags, pairs, strict=True):
        all_ = list(sequences(model._emissions(f), model.step))
        total = sum(w for _, w in all_)
        clean = all_[0][1] / total
        p = sum(t * w for t, w in all_) / total
        zero = np.zeros(len(f), np.int64)
        assert toxicity.log_none(model.marginals(f, zero), zero, model.step, 1)[0] == pytest.approx(np.log(clean), abs=1e-6)
        if not y:
            assert not tag.any() and (pair[:, 0, 0] == 1).all()
            continue
        scale = 1 / (1 - clean + 0.1 * clean)
        assert tag == pytest.approx(np.minimum(1, p * scale), abs=1e-6)
        for k in range(len(f) - 1):
            for a, b in ((0, 1), (1, 0), (1, 1)):
                assert pair[k, a, b] == pytest.approx(scale * sum(w for t, w in all_ if (t[k], t[k + 1]) == (a, b)) / total, abs=1e-6)
    odds, _, _ = toxicity.summary(np.zeros(len(feats[0]), np.int64), model.marginals(feats[0], np.zeros(len(feats[0]), np.int64)), model.step, 1)
    all_ = list(sequences(model._emissions(feats[0]), model.step))
    clean = all_[0][1] / sum(w for _, w in all_)
    assert odds[0] == pytest.approx(np.log((1 - clean) / clean), abs=1e-6)


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(6)
    w, step, first = rng.normal(0, 0.5, 64), rng.normal(0, 0.5, (2, 2)), -0.3
    f = features(["red green blue red grey"])[0]
    y, row = np.array([0, 1, 1, 0, 0]), np.zeros(5, np.int64)

    def likelihood(w, step, first):
        bucket = (f & np.uint64(63)).astype(int)
        emit = (w[bucket] * (f != 0)).sum(1) + first
        every = list(sequences(emit, step))
        return next(np.log(s) for t, s in every if (t == y).all()) - np.log(sum(s for _, s in every))

    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1], y[1:]), 1)
    used, grad, turn, bias = toxicity._gradients(f, y.astype(float), seen, row, w, step, first)
    tiny = 1e-6
    for at, g in zip(used, grad, strict=True):
        up, down = w.copy(), w.copy()
        up[at] += tiny
        down[at] -= tiny
        assert g == pytest.approx((likelihood(up, step, first) - likelihood(down, step, first)) / (2 * tiny), abs=1e-5)
    for a, b in itertools.product((0, 1), repeat=2):
        up, down = step.copy(), step.copy()
        up[a, b] += tiny
        down[a, b] -= tiny
        assert turn[a, b] == pytest.approx((likelihood(w, up, first) - likelihood(w, down, first)) / (2 * tiny), abs=1e-5)
    assert bias == pytest.approx((likelihood(w, step, first + tiny) - likelihood(w, step, first - tiny)) / (2 * tiny), abs=1e-5)


def test_odds_are_of_documents():
    feats = features(["bad bad good", "bad", "good", "good once"])
    odds = toxicity.document_odds(feats, np.array([1, 1, 0, 0]), 2)
    own = lambda word: odds[toxicity._odds_bits(features([word])[0][:, toxicity.WHOLE])][0]
    assert own("bad") == pytest.approx(np.log(2.5 / 3) - np.log(0.5 / 3), abs=1e-5) and own("good") == pytest.approx(np.log(1.5 / 3) - np.log(2.5 / 3), abs=1e-5) and own("once") == -np.inf


def test_a_phrase_of_ordinary_words_is_learnt():
    rng = np.random.default_rng(7)
    words, texts = [f"w{i}" for i in range(200)], []
    for i in range(700):
        t = list(rng.choice(words, rng.integers(20, 80)))
        for x in ("go", "away"):
            t.insert(rng.integers(0, len(t)), x)
        if i % 2:
            t[len(t) // 2 : len(t) // 2] = ["go", "away"]
        texts.append(" ".join(t) if i % 2 else " ".join(t).replace("go away", "away go"))
    ys = np.arange(700) % 2
    model = toxicity.fit_field(features(texts[:500]), ys[:500])
    scores = model.scores(pa.array(texts[500:]))
    assert ((scores >= 0.7) == (ys[500:] == 1)).mean() >= 0.97
    starts = [i for i, _ in enumerate(texts) if ys[i] and i >= 500][:20]
    for i in starts:
        f = features([texts[i]])[0]
        p = model.marginals(f, np.zeros(len(f), np.int64))
        at = texts[i].split()
        assert {at[k] for k in np.flatnonzero(p >= 0.5)} <= {"go", "away"} and (p >= 0.5).any()
