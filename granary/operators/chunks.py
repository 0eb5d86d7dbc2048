"""Documents cut into chunks: sections by headings, paragraphs packed to a size with an overlap, long paragraphs cut at sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A heading's form, where sentences end, what stands between the headings of a path, and the sizes in words.
HEADING = re.compile(r"(#{1,6})\s+(.*)")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
BETWEEN = " › "
TARGET, MOST, OVERLAP = 220, 400, 40


def sections(text: str) -> list[tuple[list[str], list[str]]]:
    """(heading path, paragraphs) of each section, the one before the first heading included."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    open_lines: list[str] = []

    def end_paragraph():
        body = "\n".join(open_lines).strip()
        if body:
            out[-1][1].append(body)
        open_lines.clear()

    for line in text.splitlines():
        bare = line.strip()
        title = HEADING.fullmatch(bare)
        if not bare or title:
            end_paragraph()
        else:
            open_lines.append(line)
        if title and title[2].strip():
            out.append((out[-1][0][: len(title[1]) - 1] + [title[2].strip()], []))
    end_paragraph()
    return out


def split_long(text: str, most: int = MOST) -> list[str]:
    """Pieces of whole sentences of most words or fewer; a sentence that is longer is a piece of its own."""
    pieces: list[list[str]] = []
    room = -1
    for sentence in SENTENCE_END.split(text):
        n = len(sentence.split())
        if n > room and (not pieces or pieces[-1]):
            pieces.append([])
            room = most
        pieces[-1].append(sentence)
        room -= n
    return [" ".join(p) for p in pieces]


def borders(upto: np.ndarray, first: int, stop: int, carried: int, target: int, most: int, overlap: int):
    """(lo, hi) of each chunk that paragraphs first to stop make; upto are the running sums of their words.

    A chunk counts the words carried into it. It ends at the first border where it has target words, or at the last where it has
    most or fewer, whichever is nearer; after an end of the second kind the next paragraph goes in whatever its size. What is
    left at stop is a chunk too, if only of carried words.
    """
    lo, exempt = first, 0
    while True:
        base = upto[lo] - carried
        full = max(lo + 1, int(np.searchsorted(upto, base + target)))
        last = max(lo + exempt, int(np.searchsorted(upto, base + most, "right")) - 1)
        over = min(full, last) >= stop and full > stop
        hi = stop if over else min(full, last)
        words = int(upto[hi] - base)
        if words:
            yield lo, hi
        if over:
            return
        lo, exempt, carried = hi, int(last < full), min(overlap, words)


def packed(paragraphs: list[str], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one section. Each begins with the last overlap words of the one before, which stand alone at the end if nothing follows.

    A paragraph of more than most words is cut at sentences instead: its pieces take no overlap and give none, so the words
    carried over it come after it.
    """
    own = [p for p in paragraphs if p.strip()]
    sizes = [len(p.split()) for p in own]
    upto = np.cumsum([0, *sizes])
    out: list[str] = []
    tail: list[str] = []
    first = 0
    for stop in [*(i for i, n in enumerate(sizes) if n > most), len(own)]:
        for lo, hi in borders(upto, first, stop, len(tail), target, most, overlap):
            out.append("\n\n".join([" ".join(tail), *own[lo:hi]]).strip())
            tail = out[-1].split()[-overlap:] if overlap else []
        out += [piece for long in own[stop : stop + 1] for piece in split_long(long, most) if piece.strip()]
        first = stop + 1
    return out


#: Rows that are cut before their chunks are handed on.
AT_ONCE = 64


def chunked(docs: DataFrame, id_col: str, text_col: str, *, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ordinal, section, text, words) of the chunks of each row; null or blank texts have none, a section without headings above it is null."""

    def run(batches):
        for b in (batch.slice(lo, AT_ONCE) for batch in batches for lo in range(0, batch.num_rows, AT_ONCE)):
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(BETWEEN.join(path) or None, c) for path, paragraphs in sections(text or "") for c in packed(paragraphs, target, most, overlap)]
                rows += [(key, i, path, c, len(c.split())) for i, (path, c) in enumerate(found)]
            kinds = [b.column(0).type, pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [id_col, "ordinal", "section", "text", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ordinal int, section string, text string, words int")


def headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, line, level, title, path) of each heading line, from 0; path is of the headings above it and itself."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\r\n|[\n\r]")
    form = r"^\s*(#{1,6})\s+(.*?)\s*$"
    each = F.transform(lines, lambda raw, i: F.struct(i.alias("line"), F.length(F.regexp_extract(raw, form, 1)).alias("level"), F.regexp_extract(raw, form, 2).alias("title")))
    own = docs.select(F.col(id_col), F.filter(each, lambda h: h["title"] != "").alias("all"))
    state = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<struct<line:int,level:int,title:string,path:string>>").alias("out"))

    def step(s, h):
        path = F.concat(F.slice(s["path"], F.lit(1), h["level"] - 1), F.array(h["title"]))
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), F.array_join(path, BETWEEN).alias("path")))).alias("out"))

    return own.select(id_col, F.explode(F.aggregate("all", state, step, lambda s: s["out"])).alias("h")).select(id_col, "h.line", "h.level", "h.title", "h.path")
