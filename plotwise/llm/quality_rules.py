"""Quality rules: clean line by line first, then judge what is left.

Each line is tested by itself: does it end like a sentence, is it navigation,
is it boilerplate, is it made of symbols? Lines that fail are taken out, and a
document that loses too much of its text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import IS_WORD, batches, code_points, mix64, span_hashes, texts, word_bounds

# Characters that count as symbols, marks that end a sentence, phrases of navigation and of boilerplate.
SYMBOLS = b"#*$%&|<>"
SENTENCE_ENDS = b".!?:;\"')]}"
NAVIGATION = ("home", "about us", "contact", "log in", "login", "sign in", "sign up", "next page", "previous page", "read more", "skip to", "site map", "back to top", "menu", "share on")
BOILERPLATE = ("cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright", "licensed under", "javascript", "subscribe to", "lorem ipsum", "spdx-license-identifier")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(SYMBOLS + b"!{}[]=~^_\\")] = True
_PHRASES = re.compile("|".join(map(re.escape, sorted(NAVIGATION, key=len, reverse=True))).encode())
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. Lines: ``long_line`` words need no sentence end; ``navigation_words`` is the most that a navigation line has; ``symbol_share`` of a line's characters may be marks. Documents: the least words, the largest share of words in repeated windows and the largest share of characters lost."""

    min_words: int = 50
    repeat_percent: int = 50
    long_line: int = 12
    navigation_words: int = 8
    symbol_share: float = 0.1
    max_loss: float = 0.5
    long_word: int = 200


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10)
    return np.concatenate(([0], breaks + 1)), np.append(breaks, len(data))


def base_counts(data: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, lines with a word that equal an earlier one, and words in 3-word windows found twice or more."""
    starts, ends = word_bounds(data)
    n = len(starts)
    if n == 0:
        return 0, 0, int(_SYMBOL[data].sum()), 0, 0
    chars = code_points(data) - int(np.count_nonzero(~IS_WORD[data]))
    firsts, lasts = _lines(data)
    filled = np.searchsorted(starts, lasts) > np.searchsorted(starts, firsts)
    rows = span_hashes(data, firsts[filled], lasts[filled])
    repeated = 0
    if n >= 3:
        words = span_hashes(data, starts, ends)
        windows = mix64(words[:-2] * np.uint64(0xD6E8FEB86659FD93) + mix64(words[1:-1] * np.uint64(3) + words[2:] * np.uint64(5)))
        _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.zeros(n, bool)
        hit = counts[where] > 1
        for k in range(3):
            twice[k : n - 2 + k] |= hit
        repeated = int(twice.sum())
    return n, chars, int(_SYMBOL[data].sum()), len(rows) - len(np.unique(rows)), repeated


def line_failures(data: np.ndarray, rules: Rules) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each line with a word that fails; the rule is the first that fails of symbols, capitals, boilerplate, navigation and punctuation."""
    out = []
    firsts, lasts = _lines(data)
    starts, _ = word_bounds(data)
    counts = np.searchsorted(starts, lasts) - np.searchsorted(starts, firsts)
    for at in np.flatnonzero(counts):
        first, last, words = int(firsts[at]), int(lasts[at]), int(counts[at])
        row = data[first:last]
        body = row.tobytes().strip()
        lower = body.lower()
        letters = (row >= 65) & (row <= 90), (row >= 97) & (row <= 122)
        up, down = (int(np.count_nonzero(x)) for x in letters)
        rule = ""
        if np.count_nonzero(_MARKS[row]) > rules.symbol_share * len(row):
            rule = "symbols"
        elif up > 20 and up > 4 * down:
            rule = "capitals"
        elif words <= 25 and _BOILER.search(lower):
            rule = "boilerplate"
        elif words <= rules.navigation_words and body[-1] not in b".!?" and (_PHRASES.match(lower) or b" | " in body or b" > " in body or b"\xc2\xbb" in body):
            rule = "navigation"
        elif words < rules.long_line and body[-1] not in SENTENCE_ENDS:
            rule = "punctuation"
        if rule:
            out.append((first, last, rule))
    return out


def clean(data: np.ndarray, rules: Rules = Rules()) -> dict:
    """What the rules find in one text: its base counts, the cleaned text, what it lost, and the verdict."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = base_counts(data)
    base_failed = n_words < rules.min_words or 100 * n_repeat_words > rules.repeat_percent * n_words
    failed = line_failures(data, rules)
    keep = np.ones(len(data), bool)
    for first, last, _ in failed:
        keep[first : last + 1] = False
    lost = word_chars and 1 - np.count_nonzero(IS_WORD[data] & keep & ((data & 0xC0) != 0x80)) / word_chars
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "base_failed": base_failed, "kept": not base_failed and lost <= rules.max_loss, "n_failed_lines": len(failed), "lost_share": float(lost), "cleaned": data[keep].tobytes().decode() if len(data) else "",
    }


def apply_rules(docs: DataFrame, rules: Rules = Rules(), *, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, lost_share[, cleaned]).

    ``kept`` is false if ``base_failed`` (too few words, or too many in
    repeated windows), else whether the lines that fail hold at most
    ``max_loss`` of the characters in words. ``cleaned`` is the text without
    these lines; lines without words always stay.

    A row for each row of docs, repeated ones too; null and empty texts have no
    words and fail; other columns are not carried. No shuffle; the state of a
    task is one text.
    """
    batches(docs.sparkSession)
    kinds = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_failed_lines": pa.int64(), "lost_share": pa.float64()} | ({"cleaned": pa.string()} if with_text else {})
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [clean(data, rules) for data in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], ["doc_id", *kinds])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, " + ", ".join(f"{k} {names[kind]}" for k, kind in kinds.items()))
