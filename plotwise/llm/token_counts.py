"""Token counts by a Viterbi pass that keeps only scores and counts.

An Aho-Corasick automaton finds every piece of a unigram vocabulary in a text;
dynamic programming carries, for each place, the best score of a segmentation
up to there and its number of pieces. No segmentation is ever built.

The rules are the tokenizer's own, so that ties fall as it lets them: of one
place the piece that starts earliest stays unless a later one is better; sums
are rounded to single precision; where the best score of a place is beyond
100,000, it is taken off that place and all further ones first. A character
that is no piece costs 10 less than the lowest score and counts as its bytes.

What a word adds depends on the score before it only through this rounding, so
words are remembered with what of that score can matter; see ``Counter.classes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from ctypes import c_float

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sentencepiece import BYTE, MARK, MODEL, NORMAL, USER, Pieces, load
from .text import batches

# The score beyond which the tokenizer starts from 0 again; bits of a single-precision number.
RESET, BITS = 100_000.0, 24
_NONE = float("-inf")


def _single(x: float) -> float:
    return c_float(x).value


class Counter:
    """Counts the pieces of texts. Pieces never hold a mark behind another character, so a text's words follow each other without sharing a piece."""

    def __init__(self, pieces: Pieces, memory: int = 600_000):
        scores = [_single(s) for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k == NORMAL]
        highest = max(scores, default=0.0)
        known = {p: _single(s) if k == NORMAL else len(p.encode()) * highest - 0.1 for p, s, k in zip(pieces.names, pieces.scores, pieces.kinds, strict=True) if k in (NORMAL, USER)}
        self.lost = _single(min(scores, default=0.0) - 10.0)
        self.fallback = BYTE in pieces.kinds
        self.automaton = ahocorasick.Automaton()
        for p, s in known.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.longest = max(map(len, known), default=1)
        # If the mark alone is beyond the reset, every word resets behind it, and of whole-numbered scores only the rounding there is left.
        self.mark = known.get(MARK, self.lost)
        mark = abs(self.mark)
        whole = all(v == int(v) for v in known.values()) and self.lost == int(self.lost)
        self.period = 2 * math.ldexp(1.0, math.frexp(mark + RESET)[1] - BITS) if whole and mark > 2 * RESET and math.frexp(mark - RESET)[1] == math.frexp(mark + RESET)[1] else 0.0
        self.known: dict = {}
        self.tables: list[dict[str, tuple]] = []  # by class
        self.heads: dict[str, tuple] = {}
        self.exact = 2.0**BITS if whole else 0.0  # below this, sums of whole numbers need no rounding
        self.rounded: dict[tuple, tuple] = {}
        self.single = {p for p, s in known.items() if len(p) == 1 and abs(s) < RESET}
        self.memory, self.held = memory, 0

    def arcs(self, text: str) -> list[list[tuple[int, float]]]:
        """(end, score) of the pieces that start at each place, the shortest first."""
        out: list[list[tuple[int, float]]] = [[] for _ in text]
        for last, (size, score) in self.automaton.iter(text):
            out[last + 1 - size].append((last + 1, score))
        return out

    def word(self, text: str, before: float = 0.0) -> tuple[int, float, float]:
        """(pieces, score, what it adds) of the best segmentation of a word behind the score ``before``; the score counts from the last reset."""
        n, lost, exact = len(text), self.lost, self.exact
        best, count, taken = [_NONE] * (n + 1), [0] * (n + 1), 0.0
        best[0] = before
        for start, found in enumerate(self.arcs(text)):
            here = best[start]
            if here > RESET or here < -RESET:
                taken += here
                for k in range(start + 1, min(n, start + self.longest) + 1):  # no place further on is reached yet
                    if best[k] > _NONE:
                        best[k] = _single(best[k] - here)
                here = 0.0
            ahead = count[start] + 1
            for end, score in found:
                value = here + score
                if value > best[end]:
                    best[end] = value if -exact < value < exact else _single(value)
                    count[end] = ahead
            if not found or found[0][0] != start + 1:
                value = _single(here + lost)
                if value > best[start + 1]:
                    best[start + 1], count[start + 1] = value, ahead - 1 + (len(text[start].encode()) if self.fallback else 1)
        return count[n], best[n], taken + best[n] - before

    def state(self, score: float) -> float | int:
        """What the next word has to know of the score before it: nothing if that is beyond the reset; its remainder, below 0, if only rounding depends on it."""
        if abs(score) > RESET:
            return 0
        return -int(score) % int(self.period) if self.period else score

    def classes(self, text: str) -> tuple[list[int], list[tuple]]:
        """For each remainder of the score before a word, the number of a class in ``self.tables``; and for each such class its first remainder, the score taken off behind the mark and (end, score) of what is left of the word's first pieces then. Nothing else of the score before is left there."""
        head = text[: self.automaton.longest_prefix(text)]
        found = self.heads.get(head)
        if found is None:
            heads = tuple((size, s) for last, (size, s) in self.automaton.iter(head) if size > last > 0)
            found = self.heads[head] = self.rounded.get(heads)
        if found is None:
            before = -np.arange(int(self.period), dtype=np.float64)
            base = (before + self.mark).astype(np.float32)
            left = [((before + s).astype(np.float32) - base).tolist() for _, s in heads]
            kinds = list(zip(*left, strict=True)) if left else [()] * len(before)
            number = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
            firsts = [(float(before[kinds.index(k)]), float(base[kinds.index(k)]), list(zip((e for e, _ in heads), k, strict=True))) for k in number]
            self.tables.extend({} for _ in range(len(number) - len(self.tables)))
            found = self.heads[head] = self.rounded[heads] = [number[k] for k in kinds], firsts
        return found

    def _plain(self, text: str, before: float, base: float, left: list[tuple[int, float]]) -> tuple[int, float, float]:
        """As :meth:`word`, for a word whose places all have a path that needs no rounding behind the mark; whole numbers then add up exactly, so only the last reset matters."""
        n = len(text)
        best, count = [_NONE] * (n + 1), [1] * (n + 1)
        best[1] = 0.0
        for end, value in left:
            best[end] = value
        for last, (size, score) in self.automaton.iter(text):
            if size <= last:
                value = best[last + 1 - size] + score
                if value > best[last + 1]:
                    best[last + 1], count[last + 1] = value, count[last + 1 - size] + 1
        since = 0.0
        for value in best[2:n]:
            if value - since > RESET or since - value > RESET:
                since = value
        return count[n], best[n] - since, base + best[n] - before

    def _learn(self, part: str, now: float | int) -> tuple[int, float | int, float]:
        """(pieces, state behind, score added) of a word; the first remainder of a class stands for all."""
        text = part if part[0] == MARK else MARK + part
        if self.period:
            kinds, firsts = self.classes(text)
            first = firsts[kinds[now]]
            if first[2] and first[2][0][0] == 2 and len(text) <= 64 and self.single.issuperset(text[1:]):
                n, score, added = self._plain(text, *first)
            else:
                n, score, added = self.word(text, first[0])
        else:
            kinds = None
            n, score, added = self.word(text, float(now))
        got = n, self.state(score), added
        if len(part) <= 64:
            if kinds:
                self.known[part] = kinds
                self.tables[kinds[now]][part] = got
            else:
                self.known[part, now] = got
            self.held += 1
        return got

    def _words(self, text: str) -> Iterator[str]:
        """The words with their marks, but for a single mark in front."""
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            yield from text.split(" ")
            return
        marks = 0
        for part in text.split(" "):
            marks += 1
            if part:
                yield part if marks == 1 else MARK * marks + part
                marks = 0
        if marks:
            yield MARK * marks

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text; an empty one has none."""
        if not text:
            return 0, 0.0
        if self.held >= self.memory:
            self.known.clear()
            for table in self.tables:
                table.clear()
            self.held = 0
        pieces, total, now = 0, 0.0, 0
        find, tables, period = self.known.get, self.tables, self.period
        for part in self._words(text):
            if period:
                kinds = find(part)
                n, now, added = (kinds and tables[kinds[now]].get(part)) or self._learn(part, now)
            else:
                n, now, added = find((part, now)) or self._learn(part, now)
            pieces += n
            total += added
        return pieces, total


def count_tokens(docs: DataFrame, *, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, score) for each row of docs, of its whole text, by the pieces and scores of a model.

    Null and empty texts have 0 tokens. Repeated rows are counted each; other
    columns are not carried. No shuffle; the vocabulary is sent once to each
    executor and words that were seen are remembered up to a fixed number.
    """
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast(load(path))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        counter = pieces.__dict__.setdefault("_counter", None) or Counter(pieces)
        pieces._counter = counter  # kept with the broadcast, for later tasks of this worker
        for part in parts:
            rows = [counter.count(text or "") for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, score double")
