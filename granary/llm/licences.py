"""Licence scans: a suffix automaton of all licence texts gives the longest template substring at each word; long ones are chained to spans.

The automaton is a generalised one over the words of all templates and phrases. A text is streamed through it word by word; at
each word it knows the longest run of words ending there that is in some template, and through its suffix links the longest in each template. A
run that can't be made longer within its template is a match if it has `least` words or is the whole template. For each template the matches are chained, in
order in the text and in the template, no two of a chain further apart than `gap` words; the words that a chain covers, as a
share of the template's, are its coverage. Chains of at least `share` are the spans that are found, the best first where they
would overlap, and their labels are added to those of the phrases.

Only parts of a text where each two neighbouring words also are neighbours in some template can hold matches of two words, so
the others are passed over by a vectorised look at pair hashes; the automaton itself compares the words' bytes.

A matching pass holds one text's words and its matches; a chain looks back over `gap` words only, so the work grows with the
text, however often a licence is repeated in it. Texts are not shuffled.

Cases: null and empty texts have no words, no labels, a score of 0, and nulls for the first and last word; a text of any length
is scanned whole; rows that repeat an id are scanned each by itself, a null id is kept; an empty table gives an empty one;
of equal chains the first in the text is taken, then the first template. Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, borders, hash_word, mix, small_batches, tidy, word_hashes
from .licence_texts import PHRASES, TEMPLATES

#: Bytes to lower case A-Z.
_TO_LOWER = LOWER.tobytes()


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = borders(data, np.array([0, len(data)]), ALNUM)
    low = text.encode().translate(_TO_LOWER)
    return [low[a:b] for a, b in zip(starts, ends, strict=True)]


class Automaton:
    """The generalised suffix automaton of word sequences, with the places (sequence, last word) where each state's runs end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                ends[last].add((number, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(ends[s]) if s else [] for s in range(len(self.link))]

    def _extend(self, last: int, word: bytes) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, target, word)
        return new

    def _split(self, at: int, target: int, word: bytes) -> int:
        """A state for the shorter runs of target that are reached from at."""
        new = self._state(dict(self.step[target]), self.length[at] + 1, self.link[target])
        self.link[target] = new
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = new
            at = self.link[at]
        return new

    def _state(self, step: dict[bytes, int], length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def follow(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        """State and length of the longest run that ends with this word, after a state and a length."""
        while state and word not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        target = self.step[state].get(word)
        return (target, length + 1) if target is not None else (0, 0)


class Scanner:
    """Templates (label, wording), phrases (wording, label), and their automaton."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = 6, share: float = 0.6, gap: int = 60):
        self.least, self.share, self.gap = least, share, gap
        self.names, self.phrase_names = [t[0] for t in templates], [p[1] for p in phrases]
        sequences = [words_of(t[1]) for t in templates] + [words_of(p[0]) for p in phrases]
        if not all(sequences):
            raise ValueError("a template and a phrase need a word at least")
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.phrases_at = self._phrases(sequences[len(templates) :])
        self.shortest = min(least, *self.sizes[: len(templates)], least)
        self.runs_at = self._runs(sequences[: len(templates)])
        # The look before: hashes of pairs of neighbours, and of those that start what may be shorter than `least`.
        hashed = [[hash_word(w) for w in s] for s in sequences]
        self.vocabulary = np.unique(np.array([h for s in hashed for h in s], np.uint64))
        pairs = [(a, b) for s in hashed for a, b in zip(s, s[1:], strict=False)]
        self.pairs = np.unique(_paired(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)))
        short = [s for s in hashed if len(s) < least]
        self.short_pairs = np.unique(_paired(np.array([s[0] for s in short if len(s) > 1], np.uint64), np.array([s[1] for s in short if len(s) > 1], np.uint64)))
        self.short_words = np.unique(np.array([s[0] for s in short if len(s) == 1], np.uint64))

    def _phrases(self, phrases: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """For each state the (phrase, words) that end where its longest run ends, the longest first."""
        at, states = self.automaton, defaultdict(list)
        for number, words in enumerate(phrases):
            state = length = 0
            for w in words:
                state, length = at.follow(state, length, w)
            states[state].append((number, len(words)))
        out: list[list[tuple[int, int]]] = [[] for _ in at.link]
        for state in sorted(range(1, len(at.link)), key=lambda s: at.length[s]):
            out[state] = states[state] + out[at.link[state]]
        return out

    def _runs(self, templates: list[list[bytes]]) -> list[list[tuple[int, int, int, bytes | None]]]:
        """For each state, where its run or the end of it stands in each template: (template, last word, words at most, the word after it)."""
        at = self.automaton
        out: list[list[tuple[int, int, int, bytes | None]]] = [[] for _ in at.link]
        for state in sorted(range(1, len(at.link)), key=lambda s: at.length[s]):
            if at.length[state] < self.shortest:
                continue
            own = {(n, p) for n, p in at.ends[state] if n < len(templates)}
            out[state] = [(n, p, at.length[state], templates[n][p + 1] if p + 1 < len(templates[n]) else None) for n, p in sorted(own)]
            out[state] += [r for r in out[at.link[state]] if r[:2] not in own]
        return out

    def parts(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the parts of texts that may hold matches; hashes are of all words, first is where each text's begin."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = _among(hashes, self.vocabulary)
        near = np.flatnonzero(known[:-1] & known[1:])
        pair = _paired(hashes[near], hashes[near + 1])
        ok = _among(pair, self.pairs)
        near, pair = near[ok], pair[ok]
        inside = np.zeros(len(hashes) + 1, bool)  # word i goes on from word i - 1
        inside[near + 1] = True
        inside[first[first < len(hashes)]] = False
        wanted = np.zeros(len(hashes), bool)
        wanted[near[_among(pair, self.short_pairs)]] = True
        wanted |= _among(hashes, self.short_words)
        starts = np.flatnonzero(~inside[:-1])
        ends = np.append(starts[1:], len(hashes))
        keep = (ends - starts >= self.least) | (np.add.reduceat(wanted, starts, dtype=np.int64) > 0)
        return starts[keep], ends[keep]

    def scan(self, part: list[bytes], base: int, found: Text) -> None:
        """One part of a text, whose first word is number base, into what is found."""
        at = self.automaton
        state = length = 0
        for i, (word, following) in enumerate(zip(part, [*part[1:], None], strict=True)):
            state, length = at.follow(state, length, word)
            for phrase, words in self.phrases_at[state]:
                if words <= length:
                    found.place(phrase, base + i - words + 1)
            if length >= self.shortest:
                for number, place, longest, goes_on in self.runs_at[state]:
                    own = min(length, longest)
                    if (following is None or following != goes_on) and (own >= self.least or own == self.sizes[number]):
                        found.matches[number].append((base + i, place, own))

    def result(self, found: Text) -> tuple[list[str], list[str], float, list[dict]]:
        """Labels of phrases, all labels, score, and spans."""
        base = sorted({self.phrase_names[p] for p in found.phrases})
        best, chains = (1.0 if base else 0.0), []
        for number, matches in sorted(found.matches.items()):
            for covered, first, last in chained(matches, self.gap):
                coverage = covered / self.sizes[number]
                best = max(best, coverage)
                if coverage >= self.share:
                    chains.append((-covered, first, number, last, coverage))
        spans, taken = [], []
        for covered, first, number, last, coverage in sorted(chains):
            i = bisect_left(taken, (last + 1, 0))
            if i == 0 or taken[i - 1][1] < first:
                insort(taken, (first, last))
                spans.append({"label": self.names[number], "template": number, "first_word": first, "last_word": last, "covered": -covered, "coverage": coverage})
        return base, sorted({*base, *(s["label"] for s in spans)}), min(best, 1.0), sorted(spans, key=lambda s: s["first_word"])


class Text:
    """What is found in one text: places of phrases, and matches (last word, last template word, words) of each template."""

    def __init__(self):
        self.count, self.first, self.last, self.phrases, self.matches = 0, None, None, set(), defaultdict(list)

    def place(self, phrase: int, start: int) -> None:
        self.count += 1
        self.first = start if self.first is None else min(self.first, start)
        self.last = start if self.last is None else max(self.last, start)
        self.phrases.add(phrase)


def chained(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(words covered, first word, last word) of the best chain that ends with each match of one template; matches are in the order of their last words."""
    out: list[tuple[int, int, int]] = []
    ends = [m[0] for m in matches]
    for end, place, length in matches:
        best = (length, end - length + 1)
        for k in range(bisect_left(ends, end - length - gap), len(out)):
            before, at, _ = matches[k]
            gain = min(length, end - before, place - at)
            if gain > 0:
                best = max(best, (out[k][0] + gain, out[k][1]))
        out.append((best[0], best[1], end))
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(b + np.uint64(1)))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def scan_licences(docs: DataFrame, scanner: Scanner | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row.

    n_base counts the places of phrases; score is the best coverage of a template, 1 with a phrase; spans are the chains found:
    label, number of the template, first and last word, words covered and their share of the template.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        s = held.value
        for b in batches:
            columns = [[] for _ in range(8)]
            for _, data, at in blocks(b.column(1)):
                starts, ends = borders(data, at, ALNUM)
                first = np.searchsorted(starts, at[:-1])
                count = np.diff(np.append(first, len(starts)))
                own = [Text() for _ in count]
                lo, hi = s.parts(word_hashes(data, starts, ends, lower=True), first)
                for i, j in zip(lo, hi, strict=True):
                    row = int(np.searchsorted(first, i, "right")) - 1
                    low = data[starts[i] : ends[j - 1]].tobytes().translate(_TO_LOWER)
                    part = [low[x - starts[i] : y - starts[i]] for x, y in zip(starts[i:j], ends[i:j], strict=True)]
                    s.scan(part, int(i - first[row]), own[row])
                for n, text in zip(count, own, strict=True):
                    base, labels, score, spans = s.result(text)
                    for c, v in zip(columns, (int(n), text.count, text.first, text.last, ",".join(base), ",".join(labels), score, spans), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    spans = "spans array<struct<label: string, template: int, first_word: bigint, last_word: bigint, covered: bigint, coverage: double>>"
    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, {spans}")
    return found.withColumnRenamed("id", id_col)
