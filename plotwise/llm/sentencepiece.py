"""SentencePiece encoding and decoding as a shortest path through weighted transducers.

Three transducers are compiled from a model and composed lazily with each text:

* the normaliser writes a white-space mark before the text and for each space;
* the pieces, with every character that none covers written as its bytes;
* an acceptor over pairs of neighbouring pieces. In a byte-pair model a
  segmentation is what merging gives exactly if every two neighbours are what
  merging makes of them together; the acceptor weighs these pairs 0 and all
  others infinity. A unigram model has no such acceptor; its arcs weigh the
  negative scores.

The encoding is the path of least weight in the tropical semiring. No piece
crosses the start of a word, so paths are found word by word and remembered.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .text import batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """What an encoder needs of a model; small, and the same size however much is encoded."""

    names: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    splits: dict[int, tuple[int, int]] = field(default_factory=dict, repr=False)
    memory: int = 500_000
    _ready: bool = field(default=False, repr=False)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("names", "scores", "kinds", "kind", "splits", "memory")} | {"_ready": False}

    def prepare(self) -> None:
        """Compile the transducers, once in each process."""
        if self._ready:
            return
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        if self.kind == BPE and not self.splits:
            for p, i in self.ids.items():
                if len(p) > 1 and len(parts := self.merge(p, stop=True)) == 2:
                    self.splits[i] = (self.ids[parts[0]], self.ids[parts[1]])
        # In a byte-pair model, pieces that merging never makes have no arc.
        self.arcs = {p: i for p, i in self.ids.items() if self.kind != BPE or len(p) == 1 or i in self.splits}
        self.longest = max(map(len, self.arcs), default=1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.arcs.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.names, self.kinds, strict=True)]
        self.surface[self.unknown] = " ⁇ ".encode()
        self._ready = True

    # The acceptor over neighbouring pieces.

    def merge(self, text: str, stop: bool = False) -> list[str]:
        """Byte-pair merging itself: the best-scored neighbours first, the leftmost among equals. stop: leave out the merge that would make one piece of all."""
        parts = list(text)
        while len(parts) > 1 + stop:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b, side by side, as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, the latest first; a merge across them must never come before these.
        splits, limit = self.splits, None  # score and side of the merge that was undone last
        while True:
            across = self.ids.get(self.names[a] + self.names[b])
            if across is not None and (limit is None or self.scores[across] > limit[0] or (self.scores[across] == limit[0] and limit[1])):
                return False
            of_a, of_b = splits.get(a), splits.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and self.scores[a] < self.scores[b]):
                limit, a = (self.scores[a], False), of_a[1]
            else:
                limit, b = (self.scores[b], True), of_b[0]

    # Shortest paths.

    def word(self, text: str) -> bytes:
        """Ids, as 32-bit numbers, of a stretch that begins with a mark and has no other."""
        found = self._pair_path(text) if self.kind == BPE else self._path(text)
        if min(found)[0] >= 0:
            return struct.pack(f"{len(found)}i", *[i for i, _ in found])
        ids: list[int] = []
        for i, char in found:
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in char.encode())
            else:
                ids.append(self.unknown)
        return np.array(ids, np.int32).tobytes()

    def _path(self, text: str) -> list[tuple[int, str]]:
        n = len(text)
        lost = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0) - 10.0
        weight, back = [0.0] + [float("inf")] * n, [(0, -1)] * (n + 1)
        for at in range(1, n + 1):
            # Earlier starts first: they keep ties.
            arcs = [(start, self.arcs[text[start:at]]) for start in range(max(0, at - self.longest), at) if text[start:at] in self.arcs]
            if not any(start == at - 1 for start, _ in arcs):
                arcs.append((at - 1, -1))
            for start, piece in arcs:
                value = weight[start] - (lost if piece < 0 else self.scores[piece])
                if value < weight[at]:
                    weight[at], back[at] = value, (start, piece)
        out = []
        while n:
            start, piece = back[n]
            out.append((piece, text[start:n]))
            n = start
        return out[::-1]

    def _pair_path(self, text: str) -> list[tuple[int, str]]:
        # All finite arcs weigh 0, and merging a prefix ends in one piece: so each place has a single state
        # of finite weight, and the first arc into a place from a neighbour that goes with it is the only one.
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        last[0] = -1  # the start, or a character without a piece, goes with any neighbour
        for k, char in enumerate(text):
            if char not in self.arcs:
                last[k + 1], came[k + 1] = -1, k
        pairs, fits = self.pairs.get, self.fits
        for at, (piece, size) in self.automaton.iter(text):
            at += 1
            if last[at] is None:
                before = last[at - size]
                if before is None:
                    continue
                if before >= 0:
                    good = pairs((before, piece))
                    if good is None:
                        good = fits(before, piece)
                    if not good:
                        continue
                last[at], came[at] = piece, at - size
        out = []
        while n:
            out.append((last[n], text[came[n] : n]))
            n = came[n]
        return out[::-1]

    def _spaces(self, n: int, text: str) -> bytes:
        """n marks and what follows the last. In a byte-pair model, letters that join the last mark do so before marks join each other."""
        if self.kind != BPE:
            return b"".join(self._remember(MARK) for _ in range(n - 1)) + self._remember(MARK + text) if not any(p.startswith(MARK * 2) for p in self.ids) else np.array([i for i, _ in self._path(MARK * n + text)], np.int32).tobytes()
        tail = self._remember(MARK + text)
        alone = text == "" or np.frombuffer(tail[:4], np.int32)[0] == self.ids.get(MARK, -1)
        run = MARK * (n if alone else n - 1)
        head = np.array([self.ids[p] for p in self._runs(run)], np.int32).tobytes() if run else b""
        return head + (tail[4:] if alone else tail)

    def _runs(self, run: str) -> list[str]:
        """Merging of marks alone. Only the front grows while it can, so long runs repeat the longest piece."""
        longest = max(len(p) for p in self.ids if p.strip(MARK) == "")
        out = []
        while len(run) > 8 * longest:
            out.append(run[:longest])
            run = run[longest:]
        return out + self.merge(run)

    def _remember(self, text: str) -> bytes:
        got = self.words.get(text)
        if got is None:
            if len(self.words) >= self.memory:
                self.words.clear()
            got = self.words[text] = self.word(text)
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of the pieces of a text; an empty text has none."""
        self.prepare()
        if not text:
            return np.zeros(0, np.int32)
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            known, fresh = self.words, self._fresh
            return np.frombuffer(b"".join([known.get(p) or fresh(p) for p in parts]), np.int32)
        out, marks = [], 0
        for p in parts:
            marks += 1
            if p:
                out.append(self._remember_word(p) if marks == 1 else self._spaces(marks, p))
                marks = 0
        if marks:
            out.append(self._spaces(marks, ""))
        return np.frombuffer(b"".join(out), np.int32)

    def _fresh(self, part: str) -> bytes:
        if len(self.words) >= self.memory:
            self.words.clear()
        got = self.word(MARK + part)
        if len(part) <= 64:
            self.words[part] = got
        return got

    def _remember_word(self, part: str) -> bytes:
        return self.words.get(part) or self._fresh(part)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse projection of the same transducers. Bytes that are no characters become U+FFFD."""
        self.prepare()
        surface = self.surface
        body = b"".join([surface[i] for i in ids.tolist()])
        return body[1:].decode(errors="replace") if body.startswith(b" ") else body.decode(errors="replace")


def load(path: str = MODEL) -> Pieces:
    """Read a model's pieces on the driver. Only models that change nothing but spaces are taken, as others would need their own normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normaliser is not the identity with a leading mark")
    pieces = Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type)
    if any(MARK in p.lstrip(MARK) for p, k in zip(pieces.names, pieces.kinds, strict=True) if k in (NORMAL, USER)):
        raise ValueError("a piece crosses the start of a word")
    return pieces


def encode(docs: DataFrame, *, path: str = MODEL, with_columns: bool = False) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for each row of docs; with_columns: beside all columns of docs instead of doc_id.

    round_trip: whether decoding gives back the text (a literal U+2581 comes
    back as a space). Null and empty texts have no ids and do so. Columns of
    docs named like an added one are replaced. No shuffle; the model is small
    and sent once to each executor, words that were seen are remembered up to
    a fixed number.
    """
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast(load(path))
    added = ("ids", "n_ids", "round_trip")
    kept = [c for c in docs.columns if c not in added] if with_columns else ["doc_id"]
    docs = docs.select(*dict.fromkeys([*kept, "text"]))
    where = docs.columns.index("text")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for part in parts:
            found, exact = [], []
            for text in part.column(where).to_pylist():
                ids = pieces.encode(text or "")
                found.append(ids)
                exact.append(pieces.decode(ids) == (text or "").replace(MARK, " "))
            sizes = [len(x) for x in found]
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(docs_at[c]) for c in kept), lists, pa.array(sizes, pa.int64()), pa.array(exact, pa.bool_())], [*kept, *added])

    docs_at = {c: k for k, c in enumerate(docs.columns)}
    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("n_ids", "long").add("round_trip", "boolean")
    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, *, path: str = MODEL, ids: str = "ids", column: str = "text") -> DataFrame:
    """encoded with the text of each list of ids in ``column``; null ids give null."""
    from pyspark.sql import functions as F

    batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def of(values):
        return values.map(lambda x: None if x is None else shared.value.decode(np.asarray(x)))

    return encoded.withColumn(column, of(F.col(ids)))
