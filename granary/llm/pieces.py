"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is split before each run of the space mark, as no piece has the mark after another character; each distinct
chunk is encoded once per worker by an agenda of adjacent symbol pairs: the pair whose merged piece scores highest is
joined first, the leftmost of equals, until no pair is a piece; characters outside the vocabulary become byte pieces.
The agendas of all new chunks of an Arrow batch advance together as rows of NumPy matrices; a long chunk has a heap of
its own. The same chunks are also encoded by the sentencepiece library, and a difference stops the job. A text is decoded
from its ids: each chunk's ids give the bytes of its pieces, and the bytes of all are joined.

Cases: a null or empty text has no ids and decodes to the empty text; white space, byte and control look-alikes are
ordinary text; rows keep their number. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Where a chunk begins: a space or mark after something else.
_BORDER = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")
#: Chunks that a worker remembers at most, some 60 MB, and characters of the texts that are cut into chunks at once.
CACHE, AT_ONCE = 150_000, 1 << 18
#: Symbols of a chunk from which it gets a heap.
LONG = 48
#: Symbols that aren't pieces count from here, by code point.
ODD = 1 << 20


class PieceCodec:
    """Encoder and decoder of one model file; the library only supplies the table of pieces and checks results."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.id_of = {lib.id_to_piece(i): i for i in ids}
        self.cost_of = {lib.id_to_piece(i): -lib.get_score(i) for i in ids}
        self.byte_of = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(lib.vocab_size()) if lib.is_byte(i)}
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.byte_of.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("pieces with an inner space mark can't be encoded chunk by chunk")
        self.known: dict[str, tuple[str, bytes]] = {}  # a chunk's ids, joined by commas, and the bytes that they decode to
        self.decimal = list(map(str, range(lib.vocab_size())))
        symbol = self.id_of | {c: ODD + ord(c) for p in self.id_of for c in p if c not in self.id_of}
        self.of_char = np.arange(ODD, ODD + 0x110000, dtype=np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = sorted((symbol[p[:k]] << 22 | symbol[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair, self.joined = (np.array(x, k) for x, k in zip(zip(*pairs, strict=True), (np.int64, np.int32), strict=True))
        self.cost = np.full(lib.vocab_size(), np.inf, np.float32)
        self.cost[list(self.id_of.values())] = list(self.cost_of.values())

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of the piece that each pair of symbols joins to; infinite where it is none."""
        key = (a.astype(np.int64) << 22) | b  # -1, for no symbol, makes it negative
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        piece = np.where(hit, self.joined[at], 0)
        return np.where(hit, self.cost[piece], np.float32(np.inf)), piece

    def merge_all(self, chunks: list[str]) -> list[list[int]]:
        """The ids of many chunks; each row of the matrices is a chunk's symbols and the costs of its pairs."""
        out: list[list[int]] = [[]] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for i in np.flatnonzero(sizes >= LONG):
            out[i] = self.merge(chunks[i])
        for lo, hi in ((1, 9), (9, 16), (16, LONG)):
            rows = np.flatnonzero((sizes >= lo) & (sizes < hi))
            if not len(rows):
                continue
            n = sizes[rows]
            width = int(n.max())
            sym = np.full((len(rows), width + 1), -1, np.int32)
            sym[np.arange(width + 1) < n[:, None]] = self.of_char[np.frombuffer("".join(chunks[i] for i in rows).encode("utf-32-le"), np.uint32)]
            cost = np.full((len(rows), width + 1), np.inf, np.float32)
            piece = np.zeros((len(rows), width + 1), np.int32)
            cost[:, :-1], piece[:, :-1] = self._lookup(sym[:, :-1], sym[:, 1:])
            place, live, done = np.arange(width + 1), np.arange(len(rows)), np.empty_like(sym)
            while len(live):
                best = cost.argmin(1)  # the leftmost of the cheapest
                every = np.arange(len(live))
                more = np.isfinite(cost[every, best])
                if 4 * more.sum() < 3 * len(live):
                    done[live[~more]] = sym[~more]
                    live, sym, cost, piece, best = live[more], sym[more], cost[more], piece[more], best[more]
                    every, more = every[: len(live)], more[more]
                    if not len(live):
                        break
                best = np.where(more, best, width)  # nothing stands there: a finished chunk is left as it is
                sym[every[more], best[more]] = piece[every[more], best[more]]
                shift = np.minimum(place + (place > best[:, None]), width)
                sym, cost, piece = (np.take_along_axis(x, shift, 1) for x in (sym, cost, piece))
                cost[every, best], piece[every, best] = self._lookup(sym[every, best], sym[every, np.minimum(best + 1, width)])
                left = more & (best > 0)
                e, b = every[left], best[left]
                cost[e, b - 1], piece[e, b - 1] = self._lookup(sym[e, b - 1], sym[e, b])
            for i, ids in zip(rows, done.tolist(), strict=True):
                ids = ids[: ids.index(-1)]
                out[i] = ids if max(ids) < ODD else [x for k in ids for x in ([k] if k < ODD else [self.byte_of[b] for b in chr(k - ODD).encode()])]
        return out

    def merge(self, chunk: str) -> list[int]:
        """The ids of one chunk, by the agenda."""
        cost, sym = self.cost_of.get, list(chunk)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, p) for i, p in enumerate(map("".join, zip(sym, sym[1:], strict=False))) if (c := cost(p)) is not None]
        heapify(agenda)
        while agenda:
            _, i, p = heappop(agenda)
            left, j = sym[i], after[i]
            if not left or j >= n or len(left) + len(sym[j]) != len(p) or left + sym[j] != p:
                continue  # one of the two has been joined to another meanwhile
            sym[i], sym[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (c := cost(q := p + sym[k])) is not None:
                    heappush(agenda, (c, i, q))
            if (h := before[i]) >= 0 and (c := cost(q := sym[h] + p)) is not None:
                heappush(agenda, (c, h, q))
        out: list[int] = []
        for s in sym:
            if s:
                i = self.id_of.get(s)
                out += [i] if i is not None else [self.byte_of[b] for b in s.encode()]
        return out

    @staticmethod
    def chunks(text: str, begun: bool = False) -> list[str]:
        """The chunks of a text; of a part of one, begun tells that it isn't the first."""
        return _CHUNK.findall((MARK if not begun else "") + text.replace(" ", MARK)) if text else []

    def learn(self, fresh: list[str]) -> None:
        """Encode chunks not seen before, check them, and keep the ids of each as text."""
        plain = [c.replace(MARK, " ") for c in fresh]
        coded = self.merge_all(fresh)
        checked = self.lib.encode([p[1:] for p in plain], num_threads=1)
        if coded != checked:
            for chunk, own, lib in zip(fresh, coded, checked, strict=True):
                if own != lib and len(chunk) > 1:  # a lone mark is what the library drops as the empty text
                    raise RuntimeError(f"ids of {chunk!r} differ: {own} and {lib}")
        ids, back = self.decimal.__getitem__, self.bytes_of.__getitem__
        self.known.update((c, (",".join(map(ids, own)), b"".join(map(back, own)))) for c, own in zip(fresh, coded, strict=True))

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.merge(c)]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: pieces joined, the first space dropped; bytes that aren't UTF-8 are replaced."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def remember(self, own: list[list[str]]) -> None:
        """Make all chunks of a batch known."""
        if len(self.known) > CACHE:
            self.known.clear()
        if fresh := [c for c in set().union(*own) if c not in self.known]:
            gc.disable()  # millions of short lists, none of them in a cycle
            try:
                self.learn(fresh)
            finally:
                gc.enable()

    def each(self, texts: list[str | None], keep: bool = False):
        """The Result of each text, with ids and decoded text if keep.

        Texts are cut into slices at chunk borders, so a long one is never held as chunks as a whole; the slices of AT_ONCE
        characters are encoded together, whether they are of one text or of many.
        """
        held: list[tuple[Result, list[str], bool]] = []
        size = 0
        for text in texts:
            out = Result(keep)
            for part, last in sliced(text or ""):
                held.append((out, self.chunks(part, out.begun), last))
                out.begun = True
                size += len(part)
                if size >= AT_ONCE:
                    yield from self._flush(held)
                    held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[Result, list[str], bool]]):
        self.remember([own for _, own, _ in held])
        for out, own, last in held:
            out.add(list(map(self.known.__getitem__, own)))
            if last:
                yield out


class Result:
    """What is known of a text's ids and of the text that they decode to, as far as it has been encoded."""

    def __init__(self, keep: bool):
        self.n_tokens, self.ids, self.bytes, self.begun = 0, hashlib.sha256(), hashlib.sha256(), False
        self.kept: tuple[list[str], list[bytes]] | None = ([], []) if keep else None

    def add(self, chunks: list[tuple[str, bytes]]) -> None:
        if not chunks:
            return
        ids, parts = zip(*chunks, strict=True)
        joined, decoded = ",".join(ids), b"".join(parts)
        # Bytes of a chunk that aren't UTF-8 are replaced within it, as chunks begin with a space.
        decoded = decoded.decode("utf-8", "replace").encode()
        if self.n_tokens:
            joined_on = "," + joined
        else:
            joined_on, decoded = joined, decoded.removeprefix(b" ")
        self.n_tokens += joined.count(",") + 1
        self.ids.update(joined_on.encode())
        self.bytes.update(decoded)
        if self.kept:
            self.kept[0].append(joined)
            self.kept[1].append(decoded)


def sliced(text: str, size: int = AT_ONCE):
    """(part, whether it is the last) of a text, cut where chunks begin, each of size characters or as many as it takes to the next such place."""
    lo = 0
    while True:
        border = _BORDER.search(text, lo + size) if lo + size < len(text) else None
        hi = border.start() if border else len(text)
        yield text[lo:hi], hi == len(text)
        if hi == len(text):
            return
        lo = hi


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text, and the ids and decoded text if with_ids."""
    small_batches(docs.sparkSession)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])

    def run(batches):
        coder = codec(model_path)
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for r in coder.each(batch.column(1).to_pylist(), with_ids):
                more = ([int(i) for i in ",".join(r.kept[0]).split(",")] if r.n_tokens else [], b"".join(r.kept[1]).decode()) if with_ids else ()
                for c, v in zip(cols, (r.n_tokens, r.ids.hexdigest(), r.bytes.hexdigest(), *more), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def decode_pieces(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give the empty text."""

    def run(batches):
        coder = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, text string")
