"""Packing of tokenized documents into sequences of a fixed length, by sums of squares.

Documents longer than a sequence are cut into full pieces; only the last piece may be shorter.
Pieces are dealt by hash into groups of bounded size, and each group packs its own, in the order
of a hash: of all gaps that take the piece, and a new sequence, the one is chosen after which the
sum over residual gaps of the squared number of open sequences with that gap is smallest. That
keeps the gaps varied, so that later pieces find one that fits. The sequences that are still open
when a group's pieces end have no later pieces to wait for: their pieces are placed once more,
largest first into the smallest gap that takes them.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from repograph.llm.tokens import WordTokenizer
from repograph.stage import staged

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_GROUP_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer: str, size: int, text: str = "text",
           end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """Pieces of every whole text: its ids and one end id, cut at multiples of `size`.

    A worker keeps the words it has met for its next task, unless other work shares its memory.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        encode = WordTokenizer.shared(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, flat, offsets in encode.encode(texts):
                out = []
                for r in range(len(offsets) - 1):
                    own = np.append(flat[offsets[r]:offsets[r + 1]], np.uint32(end_id))
                    doc = ids[first + r].as_py()
                    for k, at in enumerate(range(0, len(own), size)):
                        cut = own[at:at + size]
                        out.append((doc, k, at, len(cut), zlib.crc32(cut.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep_words:
            encode.forget()

    return docs.select("doc_id", text).mapInArrow(run, _PIECE)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for every length, placed in the given order."""
    open_count = np.zeros(size + 1, np.int64)     # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        if n == size:
            sequence[i], offset[i], made = made, 0, made + 1
            continue
        # The change of the sum: gap g loses one sequence, gap g - n gains one; a full sequence
        # is no longer open.
        taken = open_count[n:size]
        change = 2 * (open_count[:size - n] - taken) + 2
        change[0] = 1 - 2 * taken[0]
        change[taken == 0] = np.iinfo(np.int64).max
        # Of equally good gaps the smallest, that is the fullest sequence.
        g = n + int(np.argmin(change))
        if open_count[g] == 0 or change[g - n] > 2 * open_count[size - n] + 1:
            bin_, g, made = made, size, made + 1
        else:
            bin_ = stacks[g].pop()
            open_count[g] -= 1
        sequence[i], offset[i] = bin_, size - g
        if g > n:
            stacks[g - n].append(bin_)
            open_count[g - n] += 1
    return sequence, offset


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for every length: largest first, each into the smallest gap."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[tuple[int, int]] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(gaps, (n, -1))
        gap, bin_ = gaps.pop(at) if at < len(gaps) else (size, made)
        made += bin_ == made
        sequence[i], offset[i] = bin_, size - gap
        if gap > n:
            bisect.insort(gaps, (gap - n, bin_))
    return sequence, offset


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squares, then the pieces of sequences left open anew by best fit."""
    sequence, offset = sum_of_squares(lengths, size)
    if not len(lengths):
        return sequence, offset
    filled = np.bincount(sequence, weights=lengths)
    loose = filled[sequence] < size
    again, offset[loose] = best_fit(lengths[loose], size)
    sequence[loose] = again + len(filled)
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, text: str = "text",
         keep_words: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the end id alone. Repeated rows are packed as often as they stand there; rows with a null
    doc_id keep it. Other columns are not read. An empty table gives an empty result.

    Groups hold about 50,000 pieces each, whatever the size of the table, and are dealt by a hash
    of the piece's contents and place, so no document or source can swell one.
    """
    cut = staged(pieces(docs, tokenizer, size, text, keep_words=keep_words))
    groups = max(1, -(-cut.count() // _GROUP_ROWS))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                           F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"),
                               ("piece", "ascending")])
        sequence, offset = place(table.column("length").to_numpy(), size)
        group = table.column("group")
        ids = pc.add(pc.multiply(group, 1 << 20), pa.array(sequence))
        return (table.drop_columns(["group"]).append_column("sequence_id", ids)
                .append_column("offset", pa.array(offset)))

    return dealt.groupBy("group").applyInArrow(
        run, _PIECE + ", sequence_id bigint, offset bigint")
