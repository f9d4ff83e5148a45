"""SentencePiece encoding and decoding by shortest paths through a weighted transducer.

The model file is compiled into three parts. The normaliser puts a mark for every space and, where
the model says so, one in front. The piece transducer has a state for each piece (the last one
written) and an arc for each piece that may follow; the arcs of a merge-based (BPE) model cost 0
where the two pieces stand side by side as the merges leave them, and infinity where a merge would
join across their border. A sequence of pieces is the model's answer exactly if no two neighbours
are so joined, so the answer is the one path of finite cost. The byte transducer spells characters
without a piece as byte pieces. Composition with an input gives a lattice of positions and last
pieces; its shortest path in the tropical semiring (least sum of costs) is found left to right.

No piece crosses certain borders (before a mark, between two letters that no piece has side by
side). The lattice falls into independent stretches there, and a stretch's path is kept for the
next time that it is met. What is kept is bounded: paths go when they were not met for two
generations, words between runs of rows.
"""

from __future__ import annotations

import math
import struct
import zlib
from array import array
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_DEAD, _SPELLED = -2, -1     # no path to a position; the last character went to byte pieces
# What a worker keeps between runs of rows: in all about 150 MB.
_KEPT_WORDS = 300_000
_KEPT_PATHS = 150_000       # in each of two generations
_KEPT_JOINS = 200_000
_LONGEST_KEPT = 64          # characters of a stretch whose path is kept
_shared: dict[str, PieceModel] = {}


def _fields(data: bytes):
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + n]
            at += n


class PieceModel:
    """A compiled model file. Only merge-based models without a character map are known."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        for number, body in parts:
            if number == 1:
                own = dict(_fields(body))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                self.kinds.append(own.get(3, _NORMAL))
        trainer = dict(_fields(next(b for n, b in parts if n == 2)))
        spec = dict(_fields(next((b for n, b in parts if n == 3), b"")))
        if trainer.get(3, 1) != 2 or spec.get(2) or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback and no character map")
        self.front = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds))
                      if k in (_NORMAL, _USER, _UNUSED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds))
                        if k == _BYTE}
        # Pieces that the merges can make; by last character the length of the longest.
        self.whole = {p: i for p, i in self.id_of.items() if self._merged(p) == [p]}
        self.reach = {p: 1 for p in self.id_of if len(p) == 1}
        for p in self.whole:
            if p[-1] in self.reach:
                self.reach[p[-1]] = max(self.reach[p[-1]], len(p))
        self.inner = {p[i:i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.plain = not any(p[i] != _MARK and p[i + 1] == _MARK
                             for p in self.id_of for i in range(len(p) - 1))
        if not self.plain:
            raise ValueError("a piece has a space inside")
        raw = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL
               else " ⁇ ".encode() if k == _UNKNOWN else p.replace(_MARK, " ").encode()
               for p, k in zip(self.pieces, self.kinds)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_begins = np.cumsum(self.raw_sizes) - self.raw_sizes
        self._forget()

    @classmethod
    def shared(cls, path: str) -> PieceModel:
        """One per worker process."""
        if path not in _shared:
            _shared[path] = cls(path)
        return _shared[path]

    def _forget(self):
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.joins: dict[int, bool] = {}
        self.text, self.last, self.before = "", [_SPELLED], [0]
        self._forget_words()

    def _forget_words(self):
        self.words: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begins, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: always the best pair, the leftmost of equals."""
        have = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(have) - 1):
                piece = self.id_of.get(have[i] + have[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                return have
            have[at:at + 2] = [have[at] + have[at + 1]]

    def _joined(self, key: int) -> bool:
        """Whether the merges join across the border of a pair of pieces: an arc of infinite cost."""
        a, b = self.pieces[key >> 20], self.pieces[key & 0xFFFFF]
        if len(self.joins) >= _KEPT_JOINS:
            self.joins.clear()
        out = self.joins[key] = self._merged(a + b) != [a, b]
        return out

    def shortest(self, text: str) -> list[int]:
        """Ids on the best path of a stretch.

        Costs are 0 or infinite, and of all states at a position only the last piece of the merges
        of what lies before has a path of cost 0: one state per position is kept. It depends on what
        lies before only, so the states of the last text are used as far as this one begins alike.
        """
        joins, whole, reach = self.joins, self.whole, self.reach
        same = 0
        for x, y in zip(self.text, text):
            if x != y:
                break
            same += 1
        last, before = self.last[:same + 1], self.before[:same + 1]
        for j in range(same + 1, len(text) + 1):
            most = reach.get(text[j - 1])
            if most is None:
                # Byte pieces take part in no merge.
                last.append(_DEAD if last[j - 1] == _DEAD else _SPELLED)
                before.append(j - 1)
                continue
            for i in range(j - most if j > most else 0, j):
                piece = whole.get(text[i:j])
                if piece is None:
                    continue
                p = last[i]
                if p >= 0:
                    key = p << 20 | piece
                    joined = joins.get(key)
                    if joined is None:
                        joined = self._joined(key)
                    if joined:
                        continue
                elif p == _DEAD:
                    continue
                last.append(piece)
                before.append(i)
                break
            else:
                last.append(_DEAD)
                before.append(0)
        if len(text) <= _LONGEST_KEPT:
            self.text, self.last, self.before = text, last, before
        at, out = len(text), []
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.byte_id[b] for b in reversed(text[before[at]:at].encode())]
            at = before[at]
        return out[::-1]

    def _kept_path(self, part: str) -> bytes:
        """The path of a stretch as 32-bit ids. Paths not met for two generations are dropped."""
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", self.shortest(part)).tobytes()
        if len(self.paths) >= _KEPT_PATHS:
            self.older, self.paths = self.paths, {}
        if len(part) <= _LONGEST_KEPT:
            self.paths[part] = ids
        return ids

    def _path(self, word: str) -> bytes:
        if self.inner.issuperset(map(add, word, word[1:])):
            ids = self.paths.get(word)
            return self._kept_path(word) if ids is None else ids
        out, paths, a = [], self.paths, 0
        for b in range(1, len(word) + 1):
            if b == len(word) or word[b - 1:b + 1] not in self.inner:
                part = word[a:b]
                ids = paths.get(part)
                if ids is None:
                    ids = self._kept_path(part)
                    paths = self.paths
                out.append(ids)
                a = b
        return b"".join(out)

    def _normal(self, texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        if self.squeeze:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        marked = pc.replace_substring(texts, " ", _MARK)
        if not self.front:
            return marked
        return pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(_MARK, marked, ""))

    def encode(self, texts: pa.Array, limit: int = 4 << 20):
        """First row, ids of a run of rows, and where each row's ids begin and end."""
        marked = self._normal(texts)
        sizes = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < len(marked):
            to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + limit, "right")))
            yield at, *self._run(marked.slice(at, to - at))
            at = to

    def _run(self, marked: pa.Array):
        # A word is what stands behind a mark; the first one of a row may have no mark.
        lists = pc.split_pattern(marked, _MARK)
        parts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.words) > _KEPT_WORDS or self.used > 8 * _KEPT_WORDS:
            self._forget_words()
        codes = coded.indices.to_numpy()
        row_ends = np.cumsum(parts)
        opening = np.zeros(len(codes), bool)
        opening[row_ends - parts] = True
        # Marks without a letter behind them belong to the next word, so rows with runs of marks,
        # and rows without a mark in front, are read as a whole.
        empty = np.array([n == "" for n in names], bool)[codes]
        odd = np.add.reduceat((empty & ~opening) | (opening & ~empty), row_ends - parts) > 0
        new = sorted(w for w in names if w not in self.words)     # alike beginnings in turn
        self._store([_MARK + w for w in new], new)
        place = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))[codes]
        counts = np.where(opening, 0, self.counts[place])
        ends = np.cumsum(counts)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(
            self.begins[place] - (ends - counts), counts)
        flat, offsets = self.flat[source], np.concatenate([[0], ends[row_ends - 1]])
        if odd.any():
            rows = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
            for r in np.flatnonzero(odd).tolist():
                rows[r] = np.frombuffer(b"".join(map(self._path, self._words(marked[r].as_py()))),
                                        np.int32)
            flat = np.concatenate(rows)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return flat, offsets

    @staticmethod
    def _words(text: str) -> list[str]:
        """Cut before every mark that follows another character."""
        out, a = [], 0
        for b in range(1, len(text)):
            if text[b] == _MARK and text[b - 1] != _MARK:
                out.append(text[a:b])
                a = b
        return [*out, text[a:]] if text else []

    def _store(self, words: list[str], names: list[str]) -> None:
        found = [self._path(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n, total = len(self.words), int(counts.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[self.used:self.used + total] = np.frombuffer(b"".join(found), np.int32)
        self.counts[n:n + len(words)] = counts
        self.begins[n:n + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += total
        self.words.update(zip(names, range(n, n + len(words))))

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Text bytes of every row: the pieces with spaces for marks, without the one in front."""
        sizes = self.raw_sizes[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.arange(ends[-1]) + np.repeat(self.raw_begins[flat] - ends[:-1], sizes)
        data = self.raw[source].tobytes()
        cut = ends[offsets]
        out = [data[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]
        return [t[1:] if self.front and t[:1] == b" " else t for t in out]


def encode(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in `keep`, ids, n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers) and
    round_trip (whether decoding gives the normalised text back) of every row.

    A null or empty text has no ids. Texts of any length are encoded whole. Repeated rows are
    encoded as rows; other columns are not read; an empty table gives an empty result.
    """
    def run(batches):
        own = PieceModel.shared(model)
        for batch in batches:
            texts = batch.column(len(keep))
            for first, flat, offsets in own.encode(texts):
                n = len(offsets) - 1
                plain = pc.fill_null(texts.slice(first, n), "")
                if own.squeeze:
                    plain = pc.replace_substring_regex(pc.utf8_trim(plain, " "), " +", " ")
                # A literal mark reads as a space.
                plain = pc.replace_substring(plain, _MARK, " ")
                same = [a == b for a, b in zip(own.decode(flat, offsets),
                                               plain.cast(pa.binary()).to_pylist())]
                sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes())
                        for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, n) for c in batch.columns[:len(keep)]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                     pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64()),
                     pa.array(same)],
                    names=[*keep, "ids", "n_ids", "ids_crc32", "round_trip"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in
                        docs.select(*keep).schema] + [
        "ids array<int>", "n_ids bigint", "ids_crc32 bigint", "round_trip boolean"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns in `keep` and the text of every row; null or no ids give an empty text.

    Bytes that are not UTF-8 become replacement characters.
    """
    def run(batches):
        own = PieceModel.shared(model)
        for batch in batches:
            lists = batch.column(len(keep))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            texts = [t.decode("utf-8", "replace") for t in own.decode(flat, offsets)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in
                        encoded.select(*keep).schema] + ["text string"])
    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
