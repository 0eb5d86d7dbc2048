"""Hard negatives, licence scans and centroid clustering against brute force, and on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import centroids, licences, negatives
from granary.llm.integers import inner_products

VECTORS = "vec_id long, label int, embedding array<float>, row string, v int, place string"


def vectors(rng, n, d=8):
    return [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(0, 0.3, d)], "x", 1, "y") for i in range(n)]


def mined(rows, every, positives=5, most=10):
    """(anchor, positive, rank, negative, positive score, negative score), straight from the contract."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, lab, v) in enumerate(ok):
        if a is None or a % every:
            continue
        score = [(-sum(p * q for p, q in zip(v, w, strict=True)), i if i is not None else math.inf, other) for m, (i, other, w) in enumerate(ok) if m != n and len(w) == len(v)]
        score.sort()
        for s, p, _ in [x for x in score if x[2] == lab][:positives]:
            band = [(t, i) for t, i, other in score if other != lab and -30 * s <= -100 * t <= -90 * s][:most]
            out += [(a, p if p < math.inf else None, r, i if i < math.inf else None, -s, -t) for r, (t, i) in enumerate(band, 1)]
    return out


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = vectors(rng, 400)
    rows += [(1000 + i, 1, rows[4][2], "", 0, "") for i in range(40)] + [(2000 + i, 2, rows[4][2], "", 0, "") for i in range(30)]  # ties
    rows += [rows[20], rows[20], (None, 0, rows[8][2], "", 0, ""), (None, 1, rows[20][2], "", 0, "")]
    rows += [(3000, None, rows[0][2], "", 0, ""), (3020, 1, None, "", 0, ""), (3040, 1, [1.0, None], "", 0, ""), (3060, 1, [float("nan")] * 8, "", 0, ""), (3080, 1, [float("inf")] * 8, "", 0, ""), (3100, 1, [0.5, 0.25], "", 0, ""), (3101, 2, [0.25, 0.25], "", 0, ""), (3102, 1, [0.5, 0.5], "", 0, "")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = sorted(mined(rows, 20), key=str)
    assert len(want) > 200
    assert told(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)) == want
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    assert told(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, slice_bytes=700)) == want


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(7, 1, [1.0], "", 0, "")], VECTORS), F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(100, 1, [1.0], "", 0, ""), (101, 2, [1.0], "", 0, "")], VECTORS)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("size", [100, 1 << 28, 1 << 40])
def test_inner_products_are_exact(size):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-size, size, (5, 6)) for _ in range(2))
    most = (1 << 63) - 1
    assert inner_products(a, b).tolist() == [[max(-most, min(most, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))) for y in b] for x in a]


@pytest.mark.parametrize("p", [0, 1, 7, 9, 10, 11, 99, 100, 101, 12345, (1 << 63) - 1, -1, -7, -100, -12345])
def test_bands(p):
    value = np.array([p], np.int64)
    assert negatives.upper(value, 90)[0] == 90 * p // 100
    assert negatives.lower(value, 30)[0] == -(-30 * p // 100)


def clustered(rows, k, rounds, width):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)[:k]
    centres = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        by = {}
        for _, v in own:
            by.setdefault(place(v), []).append(v)
        for j, vs in by.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    at = [(i, place(v), v) for i, v in own]
    inertia = {}
    for _, j, v in at:
        inertia[j] = inertia.get(j, 0) + far(v, centres[j])
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    long = lambda n: min(n, (1 << 63) - 1)
    return [(i, j, long(far(v, centres[j])), long(inertia[j]), long(sum(inertia.values())), name[j]) for i, j, v in at]


def test_centroids_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 4, 1 + i % 3, 4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(150)] + [(None, [0.0] * 4), (5, rows[5][1]), (6, None), (7, [1.0] * 3), (8, [float("nan")] * 4), (9, [None] * 4), (10, [float("-inf")] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)
    assert told(centroids.cluster(df, k=8, rounds=10, width=4)) == sorted(clustered(rows, 8, 10, 4), key=str)


def test_centroids_with_ties_few_rows_and_large_components(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert centroids.cluster(df([]), width=2).collect() == []
    assert centroids.cluster(df([(None, [1.0, 1.0])]), width=2).collect() == []
    for rows in ([(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-2, 3) for y in range(-2, 3))], [(1, [1.0, 2.0])], [(i, [1.0, 1.0]) for i in range(9)], [(i, [1e9 * (i % 5), -1e9 * i]) for i in range(20)]):
        assert told(centroids.cluster(df(rows), width=2)) == sorted(clustered(rows, 8, 10, 2), key=str)
    huge = centroids.cluster(df([(i, [1e300 * (-1) ** i, 1.0]) for i in range(10)]), width=2, k=2).collect()
    assert len(huge) == 10 and all(r.distance >= 0 for r in huge)


def scanned(text, templates, phrases, least, share, gap):
    """The licence scan, from all runs of words that a text has in common with each template."""
    words = licences.words_of(text or "")
    places, base = [], set()
    for wording, label in phrases:
        p = licences.words_of(wording)
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    best, chains = (1.0 if base else 0.0), []
    for number, (_, wording) in enumerate(templates):
        t = licences.words_of(wording)
        matches = []
        for i in range(len(words)):
            for p in range(len(t)):
                n = 0
                while n <= min(i, p) and words[i - n] == t[p - n]:
                    n += 1
                goes_on = i + 1 < len(words) and p + 1 < len(t) and words[i + 1] == t[p + 1]
                if n and not goes_on and (n >= least or n == len(t)):
                    matches.append((i, p, n))
        ends = []
        for k, (i, p, n) in enumerate(matches):
            value = (n, i - n + 1)
            for m in range(k):
                j, q, _ = matches[m]
                gain = min(n, i - j, p - q)
                if gain > 0 and i - n - j <= gap:
                    value = max(value, (ends[m][0] + gain, ends[m][1]))
            ends.append(value)
        for (covered, first), (last, _, _) in zip(ends, matches, strict=True):
            best = max(best, covered / len(t))
            if covered / len(t) >= share:
                chains.append((-covered, first, number, last))
    taken = []
    for c in sorted(chains):
        if all(c[3] < o[1] or c[1] > o[3] for o in taken):
            taken.append(c)
    labels = sorted(base | {templates[c[2]][0] for c in taken})
    spans = sorted((c[1], c[3], templates[c[2]][0], -c[0]) for c in taken)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), min(best, 1.0), spans


def test_licence_scan_equals_brute_force(spark):
    rng = random.Random(4)
    templates = [("one", "a b c d e f g h a b c i"), ("two", "c d e f x y z a b"), ("two", "b c d e"), ("three", "q"), ("one", "z z a a z z a a z z")]
    phrases = [("a b", "ab"), ("e", "e"), ("x Y-z", "xyz"), ("b c d e", "four")]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(templates)[1].split()
            i = rng.randrange(len(t))
            parts += rng.choice([t[i : i + rng.randint(1, 12)], rng.choices("abcdefxyzq", k=rng.randint(1, 4)), ["other"] * rng.randint(1, 9), t])
        texts.append(rng.choice([" ", "\n", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in parts))
    texts += [None, "", " \t", "été a b", "a b " * 700]
    for least, gap in ((3, 4), (6, 60)):
        scanner = licences.Scanner(templates, phrases, least=least, share=0.6, gap=gap)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
        got = {r.doc_id: r for r in licences.scan_licences(df, scanner).collect()}
        for i, text in enumerate(texts):
            r, want = got[i], scanned(text, templates, phrases, least, 0.6, gap)
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], text
            assert r.score == pytest.approx(want[6])
            assert [(s.first_word, s.last_word, s.label, s.covered) for s in r.spans] == want[7], text


def test_licence_scan_of_whole_and_damaged_texts(spark):
    whole = licences.TEMPLATES[0][1]
    damaged = " ".join(w for i, w in enumerate(whole.split()) if i % 25)
    far = "word " * 300_000 + whole
    docs = spark.createDataFrame([(1, whole), (2, damaged), (3, "permission is granted to read the software"), (4, far), (4, far), (None, "under the MIT license")], "doc_id long, text string")
    rows = licences.scan_licences(docs).collect()
    assert [(r.doc_id, r.labels) for r in rows] == [(1, "mit"), (2, "mit"), (3, ""), (4, "mit"), (4, "mit"), (None, "mit")]
    assert rows[0].score == 1.0 and 0.8 < rows[1].score < 1 and rows[2].score < 0.1
    assert (rows[3].spans[0].first_word, rows[3].n_words) == (300_000, 300_000 + rows[0].n_words)
    assert licences.scan_licences(docs.limit(0)).collect() == []
