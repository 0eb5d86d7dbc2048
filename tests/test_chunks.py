"""Chunking against its invariants, hand-made cases and a plain re-computation."""

import re

from granary.operators import chunks

TEXT = "\n".join(["before", "", "# One", "first\nsecond", "", "## Two  ", "   ", "third", "#### Deep", "x", "# Three", "#nothing", "# ", "end"])


def test_sections_have_heading_paths():
    assert [b for p, b in chunks.sections(TEXT)] == [["before"], ["first\nsecond"], ["third"], ["x"], ["#nothing\n# \nend"]]
    assert [p for p, b in chunks.sections(TEXT)] == [[], ["One"], ["One", "Two"], ["One", "Two", "Deep"], ["Three"]]


def test_long_paragraphs_are_cut_at_sentences():
    text = " ".join(f"{'w ' * (i % 7 + 1)}end{i}." for i in range(200))
    pieces = chunks.split_long(text, 30)
    assert " ".join(pieces).split() == text.split()
    assert all(len(p.split()) <= 30 and p.endswith(".") for p in pieces)
    for a, b in zip(pieces, pieces[1:], strict=False):
        first = re.split(r"(?<=[.!?])\s+", b)[0]
        assert len(a.split()) + len(first.split()) > 30
    assert chunks.split_long("a " * 50 + "b.", 10) == ["a " * 50 + "b."]


def test_chunks_overlap_and_keep_to_their_size():
    paragraphs = [" ".join(f"p{i}w{j}" for j in range(50)) for i in range(9)]
    out = chunks.packed(paragraphs, 120, 200, 10)
    assert all(len(c.split()) <= 200 for c in out)
    for a, b in zip(out, out[1:], strict=False):
        assert b.split()[:10] == a.split()[-10:]
    fresh = [w for i, c in enumerate(out) for w in c.split()[10 if i else 0 :]]
    assert fresh == " ".join(paragraphs).split()
    assert chunks.packed(["a b", "c"], 10, 20, 0) == ["a b\n\nc"] and chunks.packed([], 10, 20, 5) == []


def test_chunked_rows(spark):
    rows = [(1, TEXT), (2, None), (3, " \n "), (1, TEXT), (None, "no id"), (5, "w " * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, ordinal int")
    got = chunks.chunked(docs, "id", "text").collect()
    assert len([r for r in got if r.id == 1]) == 2 * len([1 for p, b in chunks.sections(TEXT) for _ in chunks.packed(b)])
    assert {r.id for r in got} == {1, None, 5} and [r.words for r in got if r.id == 5] == [5000]
    assert chunks.chunked(docs.where("false"), "id", "text").count() == 0
    assert {r.path for r in chunks.headings(docs, "id", "text").collect()} == {"One", "One › Two", "One › Two › Deep", "Three"}


def test_paragraphs_too_long_leave_the_overlap_for_later():
    long = " ".join(f"s{i} t." for i in range(30))
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    a, b = words("a", 6), words("b", 5)
    out = chunks.packed([a, long, b, long], 20, 40, 3)
    assert out[0] == a and " ".join(out[1:3]) == long
    assert out[3] == "a3 a4 a5\n\n" + b and " ".join(out[4:6]) == long
    assert out[6:] == ["b2 b3 b4"]
    # What reaches the target leaves its tail as a chunk of its own; a paragraph that doesn't fit beside it comes after it.
    assert chunks.packed([words("a", 20), words("b", 39)], 20, 40, 3) == [words("a", 20), "a17 a18 a19", "a17 a18 a19\n\n" + words("b", 39), "b36 b37 b38"]


def test_manuals_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    from granary.plans import chunk_queries

    monkeypatch.setattr(chunk_queries, "MANUALS", 50)
    assert chunk_queries.manuals(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
