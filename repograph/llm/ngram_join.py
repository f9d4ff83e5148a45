"""Similar documents by Jaccard similarity of word n-grams, with Bayesian pruning of candidates.

1. Documents with the same words are one class; its least doc_id represents it.
2. MinHash values of a representative form bands. Representatives that share a band key are
   candidates; each bucket links its members to their least one, which keeps the number of rows
   linear, and the connected components of these links hold every candidate pair.
3. Within a component, pairs are worked on block by block. MinHash values are compared a few at a
   time. After m agreements in n values, under a uniform prior, the probability that the similarity
   reaches the threshold t is P(Binomial(n + 1, t) <= m); a pair for which that falls below the
   tolerance is dropped. What remains is verified exactly on the n-gram sets.
4. Each block reports links per document and a forest of its links, not pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repograph.llm import words
from repograph.llm.components import components
from repograph.llm.hot import join_counted
from repograph.stage import staged

_BANDS, _ROWS = 40, 5        # a pair at 0.8 shares no band with odds 1e-7
_KEPT_VALUES = 128           # of the MinHash values, for the comparison
_STEP = 16
_TOLERANCE = 1e-7
_BLOCK = 256                 # documents
_BROADCAST_DOCS = 100_000    # documents of several texts up to which they are broadcast
_U = np.uint64
_MULTIPLY = words.mix(np.arange(1, _BANDS * _ROWS + 1, dtype=_U)) | _U(1)
_ADD = words.mix(np.arange(10_001, 10_001 + _BANDS * _ROWS, dtype=_U))


def _shingles(part: words.Slice, n: int):
    """Hashes and rows of all n-grams; a shorter text with words is one shorter n-gram."""
    hashes, offsets = part.word_hashes(), part.word_offsets
    counts = np.diff(offsets)
    starts, rows = words.windows(offsets, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    starts, ends = np.append(starts, offsets[short]), np.append(starts + n, offsets[short + 1])
    rows = np.append(rows, short)
    order = np.argsort(rows, kind="stable")
    sums = words.prefix_sums(hashes)
    return words.stretch_hashes(sums, starts[order], ends[order]), rows[order], hashes, sums


def _minhashes(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have n-grams, and their MinHash values, one line per row."""
    some, begins = np.unique(rows, return_index=True)
    out = np.empty((len(some), len(_MULTIPLY)), np.uint32)
    if len(some):
        for j, (a, b) in enumerate(zip(_MULTIPLY, _ADD)):
            out[:, j] = np.minimum.reduceat((keys * a + b) >> _U(32), begins)
    return some, out


_SIGNED = "doc_id bigint, d1 bigint, d2 bigint, bands array<bigint>, signature binary"


def _signed(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Per row: a 128-bit digest of its words, band keys and MinHash values; null without words."""
    def run(batches):
        for batch in batches:
            for part in words.slices(batch.column(1)):
                keys, rows, hashes, sums = _shingles(part, n)
                some, values = _minhashes(keys, rows)
                a, b = part.word_offsets[:-1][some], part.word_offsets[1:][some]
                d1 = words.stretch_hashes(sums, a, b)
                d2 = words.stretch_hashes(words.prefix_sums(words.mix(hashes)), a, b)
                flat = words.mix(values.reshape(-1, _ROWS).astype(_U))
                band = words.mix(words.stretch_hashes(
                    words.prefix_sums(flat.ravel()), np.arange(len(flat)) * _ROWS,
                    np.arange(1, len(flat) + 1) * _ROWS)
                    + np.tile(_ADD[:_BANDS], len(some))).view(np.int64)
                whole = {r: i for i, r in enumerate(some.tolist())}
                at = [whole.get(r) for r in range(part.rows)]
                small = values[:, :_KEPT_VALUES].astype(np.uint16)
                bands = band.reshape(-1, _BANDS)
                pick = lambda x: [None if i is None else x[i] for i in at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.first:part.first + part.rows],
                     pa.array(pick(d1.view(np.int64)), pa.int64()),
                     pa.array(pick(d2.view(np.int64)), pa.int64()),
                     pa.array(pick(bands), pa.list_(pa.int64())),
                     pa.array([None if i is None else small[i].tobytes() for i in at],
                              pa.binary())],
                    names=["doc_id", "d1", "d2", "bands", "signature"])

    return docs.select("doc_id", text).mapInArrow(run, _SIGNED)


def least_agreements(threshold: float, tolerance: float, values: int, step: int) -> dict[int, int]:
    """After n compared values: the fewest agreements with which a pair stays a candidate."""
    out = {}
    for n in range(step, values + 1, step):
        p, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while True:
            total += p
            if total >= tolerance:
                break
            p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out[n] = m
    return out


def _candidates(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    alive = np.ones((len(left), len(right)), bool)
    agree = np.zeros(alive.shape, np.int16)
    before = 0
    for n, needed in least.items():
        agree += (left[:, None, before:n] == right[None, :, before:n]).sum(-1, dtype=np.int16)
        alive &= agree >= needed
        before = n
        if not alive.any():
            break
    return alive


def _common(left: list[np.ndarray], right: list[np.ndarray], pairs) -> np.ndarray:
    """Sizes of the intersections of the paired sets."""
    if len(pairs[0]) < 32:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True))
                         for i, j in zip(*pairs)], np.int64)
    everything = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    new = np.append(True, everything[1:] != everything[:-1])
    column = np.cumsum(new) - 1
    # Only n-grams of two sets or more can be common.
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(column)])):
        slab = np.zeros((len(left) + len(right), width), np.float32)
        slab[owner[a:b], column[a:b] - k * width] = 1
        total += slab[:len(left)] @ slab[len(left):].T
    return total[pairs].astype(np.int64)


def _verified(threshold: float, least: dict[int, int]):
    """Runs over the members of blocks pairs, sorted by component and pair of blocks."""
    limit = Fraction(threshold).limit_denominator(10_000)

    def solve(rows: list[tuple]):
        key = rows[0][:3]
        sides = [[r for r in rows if r[3] == s] for s in ((0,) if key[1] == key[2] else (0, 1))]
        left, right = sides[0], sides[-1]
        if not left or not right:
            return []
        nodes = [np.array([r[4] for r in s], np.int64) for s in (left, right)]
        copies = [np.array([r[5] for r in s], np.int64) for s in (left, right)]
        signs = [np.frombuffer(b"".join(r[6] for r in s), np.uint16).reshape(len(s), -1)
                 for s in (left, right)]
        sets = [[np.frombuffer(r[7], np.uint64) for r in s] for s in (left, right)]
        alive = _candidates(*signs, least)
        if left is right:
            alive &= np.arange(len(left))[:, None] < np.arange(len(left))
        alive &= nodes[0][:, None] != nodes[1]
        pairs = np.nonzero(alive)
        if not len(pairs[0]):
            return []
        common = _common(*sets, pairs)
        sizes = [np.array([len(x) for x in s]) for s in sets]
        either = sizes[0][pairs[0]] + sizes[1][pairs[1]] - common
        linked = common * limit.denominator >= limit.numerator * either
        i, j = pairs[0][linked], pairs[1][linked]
        n = len(left) + (0 if left is right else len(right))
        j = j if left is right else j + len(left)
        every = nodes[0] if left is right else np.concatenate(nodes)
        weight = copies[0] if left is right else np.concatenate(copies)
        links = (np.bincount(i, weights=weight[j], minlength=n)
                 + np.bincount(j, weights=weight[i], minlength=n)).astype(np.int64)
        label = np.arange(n)
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        got = np.flatnonzero(links)
        return list(zip(every[got].tolist(), links[got].tolist(), every[label[got]].tolist()))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield _linked(out)
        if held:
            yield _linked(solve(held))
    return run


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    node, links, root = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (node, links, root)], names=["node", "links", "root"])


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """Members with the sorted set of their n-gram hashes instead of their text."""
    def run(batches):
        for batch in batches:
            d1 = batch.column("d1").to_numpy()
            for part in words.slices(batch.column("text")):
                keys, of, _, sums = _shingles(part, n)
                own = words.stretch_hashes(sums, part.word_offsets[:-1], part.word_offsets[1:])
                bounds = np.searchsorted(of, np.arange(part.rows + 1))
                sets = [np.unique(keys[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
                to = slice(part.first, part.first + part.rows)
                cols = [batch.column(c)[to] for c in ("comp", "size", "node", "copies", "signature")]
                table = pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=[
                    "comp", "size", "node", "copies", "signature", "grams"])
                # Of rows with the class's least doc_id only those whose text is the class's.
                yield table.filter(pa.array(own.view(np.int64) == d1[to]))

    return rows.mapInArrow(run, "comp bigint, size bigint, node bigint, copies bigint, "
                           "signature binary, grams binary").dropDuplicates(["node", "comp"])


def ngram_join(docs: DataFrame, text: str = "text", n: int = 5,
               threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    Two documents are linked if the sets of their n-grams of n words (a text of fewer words is one
    n-gram) have a Jaccard similarity of `threshold` or more. class_id is the least doc_id of the
    documents that links connect; n_links counts linked rows other than the row itself; n_copies
    counts the rows with the same words. Words are compared as they stand, case included. A null
    text, a text without words and a row with a null doc_id are linked to nothing: class_id is
    that of the document's other rows, else the doc_id, and n_links is 0. Repeated rows are copies of each other. Rows with one doc_id and
    different texts are one document: its class holds what any of its texts is linked to, while
    n_links and n_copies are those of the row's text. doc_ids lie below 2**62. Other columns are
    not read; an empty table gives an empty result.
    """
    signed = staged(_signed(docs, text, n))
    worded = signed.filter("doc_id IS NOT NULL AND d1 IS NOT NULL")
    # Documents of several texts: few, mostly none.
    several = staged(worded.groupBy("doc_id").agg(
        F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi"))
        .filter("lo <> hi").select(F.col("doc_id").alias("doc")))
    marks = several.withColumn("several", F.lit(True))
    marks = F.broadcast(marks) if several.count() <= _BROADCAST_DOCS else marks
    # A class is a node named by its least document, or by its texts where that has other ones too.
    named = F.when(F.col("several"), F.shiftrightunsigned(F.xxhash64("d1", "d2"), 2)
                   .bitwiseOR(F.lit(1 << 62))).otherwise(F.col("doc"))
    classes = staged(worded.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"),
        F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
        .join(marks, "doc", "left").withColumn("node", named).drop("several"))

    members = classes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(
        F.min("node").alias("least"), F.max("node").alias("most"),
        F.count(F.lit(1)).alias("n")).filter("least < most")
    total = max(1000, classes.count() * _BANDS)
    stars = join_counted(members, buckets, ["band"], "n", total, "inner").select("node", "least")
    grouped = components(stars)
    sizes = grouped.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    roots = sizes.select(F.col("root").alias("node"), F.col("root").alias("comp"), "size")
    others = join_counted(grouped, sizes, ["root"], "size", max(1000, grouped.count()), "inner")
    placed = staged(others.select("node", F.col("root").alias("comp"), "size").unionByName(roots)
                    .join(classes.drop("bands", "d2"), "node"))

    found = _with_sets(docs.select(F.col("doc_id").alias("doc"), F.col(text).alias("text"))
                       .join(placed, "doc"), n)
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (found.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("comp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies",
                     "signature", "grams"))
    least = least_agreements(threshold, _TOLERANCE, _KEPT_VALUES, _STEP)
    links = staged(dealt.repartition(_partitions(docs), "comp", "a", "b")
                   .sortWithinPartitions("comp", "a", "b")
                   .mapInArrow(_verified(threshold, least), "node bigint, links bigint, root bigint"))
    # The texts of a document of several are tied to the document.
    ties = (worded.select(F.col("doc_id").alias("doc"), "d1", "d2").join(several, "doc").distinct()
            .join(classes.select("d1", "d2", "node"), ["d1", "d2"])
            .select("node", F.col("doc").alias("root")))
    roots_ = components(links.select("node", "root").unionByName(ties))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = staged(classes.select("d1", "d2", "node", "copies").join(counted, "node", "left")
                   .join(roots_, "node", "left").select(
        "d1", "d2", F.coalesce("root", "node").alias("class_id"), "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = signed.select("doc_id", "d1", "d2")
    joined = join_counted(worded.select("doc_id", "d1", "d2"), known, ["d1", "d2"],
                          "copies", max(1000, rows.count()), "inner")
    alone = rows.filter("doc_id IS NULL OR d1 IS NULL").select("doc_id")
    # A row without words belongs to the class that other rows of its document have.
    homes = (worded.select("doc_id", "d1", "d2").join(alone.distinct(), "doc_id", "left_semi")
             .join(known.select("d1", "d2", "class_id"), ["d1", "d2"])
             .groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    alone = alone.join(homes, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return joined.select("doc_id", "class_id", "n_links",
                         F.col("copies").alias("n_copies")).unionByName(alone)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
