"""Term divergence between sources of one language, by chunk factorization.

Chunks are runs of characters other than white space; the terms of a chunk are its runs of letters.
Texts hold far fewer distinct chunks than chunks, so chunks are counted first and cut later.

1. Documents are read in blocks of a few megabytes. A block keeps its distinct chunks, numbered in
   the order of their hashes, and how often each document holds each of them.
2. The chunks of all blocks meet in buckets of the hash. A bucket cuts every distinct chunk into its
   terms once and sends the terms back to the blocks that hold the chunk.
3. A block joins the terms to its counts: for every term and group (language, source) the documents
   and the occurrences. These meet in buckets of the term's hash and are added up; a term stays in
   a language if enough of its documents hold it.
4. Groups are compared from the added counts by exact integer arithmetic.

What is shuffled is one entry per block and distinct chunk or term, packed; a word that every
document holds is one entry a block. The number of buckets follows the number of entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from repograph.llm import words
from repograph.stage import staged

_BLOCK_SLICES = 8            # slices of words.SLICE_BYTES that make one block
_BUCKET_CHUNKS = 250_000     # entries of blocks that one bucket takes, on average
_SHARD_TERMS, _BLOCK_SOURCES = 4096, 256
_MERGE = 4_000_000           # entries of a bucket that are held before they are added up
#: Letters of ASCII and everything beyond it make terms; A-Z are lowered; a line feed parts chunks.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 or b == 10 else b + 32 if 65 <= b <= 90 else 32
               for b in range(256))


# --- packing

def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as 4-byte integers, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
              for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def _unpack(body: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(body), np.uint8).reshape(n, 4, -1)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)


def _lines(body: bytes) -> list[bytes]:
    return zstandard.decompress(body).split(b"\n")


def _buckets(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that sorted hashes fall into: equal ranges of the hash."""
    if not len(hashes):
        return []
    of = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return list(zip(of[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(of)]))


def _line_slice(lines: list[bytes]) -> words.Slice:
    """One row per line."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    return words.Slice(0, np.frombuffer(b"".join(lines), np.uint8),
                       np.concatenate([[0], np.cumsum(lengths)]))


# --- step 1: blocks of documents

def _distinct(part: words.Slice) -> tuple[np.ndarray, ...]:
    """Sorted distinct hashes with their bytes, and (row, place, count) of a slice."""
    hashes, first, where = np.unique(part.word_hashes(), return_index=True, return_inverse=True)
    body = part.data.tobytes()
    texts = [body[a:b] for a, b in zip(part.starts[first].tolist(), part.ends[first].tolist())]
    pairs, counts = np.unique(part.word_rows() * max(len(hashes), 1) + where, return_counts=True)
    return hashes, texts, pairs // max(len(hashes), 1), pairs % max(len(hashes), 1), counts


class _Block:
    """Rows gathered from consecutive slices of one batch."""

    def __init__(self):
        self.hashes, self.texts, self.parts, self.groups = [], [], [], []
        self.rows = 0

    def add(self, part: words.Slice, groups: list[tuple[str, str]]) -> None:
        hashes, texts, rows, places, counts = _distinct(part)
        self.parts.append((rows + self.rows, places, counts))
        self.hashes.append(hashes)
        self.texts += texts
        self.groups += groups
        self.rows += part.rows

    def packed(self) -> tuple | None:
        """n_chunks, n_docs, langs, sources, groups of documents, counts, chunks."""
        hashes, first, where = np.unique(np.concatenate(self.hashes), return_index=True,
                                         return_inverse=True)
        if not len(hashes):
            return None
        kinds = sorted(set(self.groups))
        code = {g: k for k, g in enumerate(kinds)}
        of = np.array([code[g] for g in self.groups], np.int64)
        # Documents are numbered by group, so that a group is a stretch of numbers.
        order = np.argsort(of, kind="stable")
        number = np.empty(self.rows, np.int64)
        number[order] = np.arange(self.rows)
        begins = np.cumsum([0, *map(len, self.hashes)])
        docs = np.concatenate([number[r] for r, _, _ in self.parts])
        chunks = np.concatenate([where[p + b] for (_, p, _), b in zip(self.parts, begins)])
        counts = np.concatenate([c for _, _, c in self.parts])
        by = np.lexsort((chunks, docs))
        docs, chunks, counts = docs[by], chunks[by], counts[by]
        gaps = np.diff(chunks, prepend=0)
        gaps = np.where(np.diff(docs, prepend=-1) > 0, chunks, gaps)
        return (len(hashes), self.rows, [g[0] for g in kinds], [g[1] for g in kinds],
                _pack(of[order]), _pack(np.diff(docs, prepend=0), gaps, counts),
                zstandard.compress(b"\n".join([self.texts[k] for k in first.tolist()]), 1))


_BLOCK = ("block bigint, n_chunks bigint, n_docs bigint, langs array<string>, "
          "sources array<string>, groups binary, counts binary, chunks binary")


def _blocks(batches):
    """From (lang, source, text) to blocks."""
    number = (TaskContext.get().partitionId() << 32) - 1
    kinds = [pa.int64()] * 3 + [pa.list_(pa.string())] * 2 + [pa.binary()] * 3
    for batch in batches:
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        block, slices = _Block(), 0
        rest = words.slices(batch.column(2))
        part = next(rest, None)
        while part is not None:
            block.add(part, groups[part.first:part.first + part.rows])
            slices += 1
            part = next(rest, None)
            if slices == _BLOCK_SLICES or part is None:
                out = block.packed()
                block, slices = _Block(), 0
                if out:
                    number += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip((number, *out), kinds)],
                        names=["block", "n_chunks", "n_docs", "langs", "sources", "groups",
                               "counts", "chunks"])


# --- step 2: every distinct chunk is cut once

def _dealt(buckets: int):
    """From (block, chunks) to (bucket, block, chunks): the block's chunks of each bucket."""
    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = _lines(body)
                some = _buckets(_line_slice(lines).word_hashes(), buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in some], pa.int32()),
                     pa.array([block] * len(some), pa.int64()),
                     pa.array([zstandard.compress(b"\n".join(lines[a:b]), 1) for _, a, b in some],
                              pa.binary())], names=["bucket", "block", "chunks"])
    return run


def cut_chunks(chunks: list[bytes]) -> list[bytes]:
    """The terms of every chunk, lowered, with spaces between them."""
    return b"\n".join(chunks).translate(_TERMS).split(b"\n") if chunks else []


def _cut(batches):
    """From sorted (bucket, block, chunks) to (block, bucket, terms of the chunks, in order)."""
    at, known = None, {}
    for batch in batches:
        out = []
        for bucket, block, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if bucket != at:
                at, known = bucket, {}
            chunks = _lines(body)
            new = [c for c in chunks if c not in known]
            known.update(zip(new, cut_chunks(new)))
            terms = b"\n".join(map(known.__getitem__, chunks))
            out.append((block, bucket, zstandard.compress(terms, 1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))],
            names=["block", "bucket", "terms"])


# --- step 3: terms join the counts of their block

def _joined(block: dict, terms: list[bytes], buckets: int) -> Iterator[tuple]:
    """(bucket, langs, sources, n, terms, entries) of a block.

    An entry is (term, group, documents, occurrences), the term as its place among `terms`.
    """
    lines = [line for body in terms for line in _lines(body)]
    assert len(lines) == block["n_chunks"]
    cut = _line_slice(lines)
    hashes, first, where = np.unique(cut.word_hashes(), return_index=True, return_inverse=True)
    if not len(hashes):
        return
    gaps, steps, counts = _unpack(block["counts"], 3)
    docs = np.cumsum(gaps)
    # Chunks were stored as gaps within a document.
    total = np.cumsum(steps)
    new = np.flatnonzero(np.append(True, gaps[1:] > 0))
    chunks = total - np.repeat(total[new] - steps[new], np.diff(np.append(new, len(steps))))
    n = np.diff(cut.word_offsets)[chunks]
    ends = np.cumsum(n)
    source = np.arange(n.sum()) + np.repeat(cut.word_offsets[chunks] - (ends - n), n)
    n_docs = block["n_docs"]
    key, occurrences = where[source] * n_docs + np.repeat(docs, n), np.repeat(counts, n)
    order = np.argsort(key, kind="stable")
    key, occurrences = key[order], occurrences[order]
    once = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sums = np.add.reduceat(occurrences, once)
    key = key[once]
    groups = _unpack(block["groups"], 1)[0]
    of = key // n_docs * len(block["langs"]) + groups[key % n_docs]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    in_docs = np.diff(np.append(begin, len(of)))
    sums, of = np.add.reduceat(sums, begin), of[begin]
    term, group = of // len(block["langs"]), of % len(block["langs"])
    body = cut.data.tobytes()
    texts = [body[a:b] for a, b in zip(cut.starts[first].tolist(), cut.ends[first].tolist())]
    for bucket, a, b in _buckets(hashes, buckets):
        some = slice(*np.searchsorted(term, [a, b]))
        yield (bucket, block["langs"], block["sources"],
               zstandard.compress(b"\n".join(texts[a:b]), 1),
               _pack(term[some] - a, group[some], in_docs[some],
                     sums[some] & 0xFFFFFFFF, sums[some] >> 32))


_ENTRIES = "bucket int, langs array<string>, sources array<string>, terms binary, entries binary"


def _counted(buckets: int):
    """From sorted (block, kind, bucket, ...) rows, a block's own row first, to packed entries."""
    def run(batches):
        kinds = [pa.int32()] + [pa.list_(pa.string())] * 2 + [pa.binary()] * 2
        block, terms = None, []

        def done():
            for row in _joined(block, terms, buckets) if block else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in zip(row, kinds)],
                    names=["bucket", "langs", "sources", "terms", "entries"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    yield from done()
                    block, terms = row, []
                else:
                    terms.append(row["terms"])
        yield from done()
    return run


class _Sums:
    """Documents and occurrences by (term, group) of one bucket."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, langs, sources, terms: bytes, entries: bytes) -> None:
        term = np.array([self.terms.setdefault(t, len(self.terms)) for t in _lines(terms)], np.int64)
        group = np.array([self.groups.setdefault(g, len(self.groups))
                          for g in zip(langs, sources)], np.int64)
        t, g, docs, low, high = _unpack(entries, 5)
        self.held.append(np.stack([term[t], group[g], docs, low + (high << 32)]))
        self.size += len(t)
        if self.size > _MERGE:
            self._merge()

    def _merge(self) -> None:
        t, g, docs, occurrences = np.concatenate(self.held, axis=1)
        order = np.lexsort((g, t))
        t, g = t[order], g[order]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])))
        self.held = [np.stack([t[first], g[first], np.add.reduceat(docs[order], first),
                               np.add.reduceat(occurrences[order], first)])]
        # What is left can't shrink; wait until as much again has come.
        self.size = min(len(first), _MERGE // 2)

    def kept(self, least: int) -> pa.RecordBatch | None:
        if not self.held:
            return None
        self._merge()
        t, g, docs, occurrences = self.held[0]
        groups, terms = list(self.groups), list(self.terms)
        langs = sorted({lang for lang, _ in groups})
        lang = np.array([langs.index(x) for x, _ in groups], np.int64)[g]
        order = np.lexsort((lang, t))
        first = np.flatnonzero(np.append(True, (t[order][1:] != t[order][:-1])
                                         | (lang[order][1:] != lang[order][:-1])))
        enough = np.add.reduceat(docs[order], first) >= least
        some = order[np.repeat(enough, np.diff(np.append(first, len(order))))]
        return pa.RecordBatch.from_arrays(
            [pa.array([groups[k][0] for k in g[some].tolist()], pa.string()),
             pa.array([groups[k][1] for k in g[some].tolist()], pa.string()),
             pa.array([terms[k].decode() for k in t[some].tolist()], pa.string()),
             pa.array(occurrences[some], pa.int64())], names=["lang", "source", "term", "count"])


def _added(least: int):
    """From rows sorted by bucket to (lang, source, term, count) of the terms that stay."""
    def run(batches):
        at, sums = None, _Sums()
        for batch in batches:
            for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if bucket != at:
                    out = sums.kept(least)
                    if out is not None:
                        yield out
                    at, sums = bucket, _Sums()
                sums.add(*row)
        out = sums.kept(least)
        if out is not None:
            yield out
    return run


def term_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, source, term, count: occurrences of the terms that `least` documents of the language
    hold, of the groups that hold them.

    Null text, lang and source count as ''. Repeated rows are documents of their own.
    """
    none = F.lit("")
    blocks = staged(docs.select(F.coalesce("lang", none).alias("lang"),
                                F.coalesce("source", none).alias("source"),
                                F.coalesce("text", none).alias("text")).mapInArrow(_blocks, _BLOCK))
    entries = blocks.agg(F.sum("n_chunks")).first()[0] or 0
    buckets = max(1, -(-entries // _BUCKET_CHUNKS))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = (blocks.select("block", "chunks").mapInArrow(
        _dealt(buckets), "bucket int, block bigint, chunks binary")
        .repartition(min(tasks, buckets), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_cut, "block bigint, bucket int, terms binary"))
    own = blocks.drop("chunks").withColumns({"kind": F.lit(0), "bucket": F.lit(0),
                                             "terms": F.lit(None).cast("binary")})
    both = own.unionByName(cut.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    packed = (both.repartition(tasks, "block").sortWithinPartitions("block", "kind", "bucket")
              .mapInArrow(_counted(buckets), _ENTRIES))
    return (packed.repartition(min(tasks, buckets), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_added(least), "lang string, source string, term string, count bigint"))


# --- step 4: groups are compared

def _share(count: str, total: str = "total") -> str:
    """1 + floor(10**9 * (count + 5) / (total + 5 * v)), exactly."""
    return f"1 + (1000000000BD * (CAST({count} AS DECIMAL(25,0)) + 5)) div ({total} + 5 * v)"


_GAP = "lang string, source string, item string, gap bigint"


def _gaps(table: pa.Table) -> pa.Table:
    """Of terms of one shard and the sources of two blocks: by how much the sum of |p - q| over
    these terms differs from what it would be if neither source held any.

    A row without a term names a source, which need not hold any of the terms.
    """
    source, code = _codes(table["source"])
    _, term = _codes(table["term"])
    held = term >= 0
    lang, i, j = (table[c][0].as_py() for c in ("lang", "i", "j"))
    absent, block = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
    absent[code], block[code] = table["absent"].to_numpy(), table["source_block"].to_numpy()
    shares = np.repeat(absent[:, None], term.max(initial=-1) + 1, 1)
    shares[code[held], term[held]] = table["p"].filter(pa.array(held)).to_numpy()
    out = [[], [], []]
    right = np.flatnonzero(block == j)
    for a in np.flatnonzero(block == i).tolist():
        gap = (np.abs(shares[right] - shares[a]).sum(1)
               - np.abs(absent[right] - absent[a]) * shares.shape[1])
        both = [(a, right)] if i == j else [(a, right), (right, a)]
        for x, y in both:
            out[0].append(np.broadcast_to(x, len(right)))
            out[1].append(np.broadcast_to(y, len(right)))
            out[2].append(gap)
    x, y, gap = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
    apart = x != y
    names = pa.array(source, pa.string())
    return pa.table({"lang": pa.array([lang] * int(apart.sum()), pa.string()),
                     "source": names.take(pa.array(x[apart])), "item": names.take(pa.array(y[apart])),
                     "gap": pa.array(gap[apart], pa.int64())})


def _codes(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy()


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how the groups of a language differ in their terms.

    A language keeps the terms that `least` of its documents hold, v of them. Every group and the
    language gives each of them p = 1 + floor(10**9 * (count + 5) / (all counts + 5 * v)). Part
    `pair`: every other source of the language, value the sum of |p - q| over all kept terms, 0
    without any. Part `term`: the `top` terms that the group holds and gives more than the language
    does, by how much. Ranks go by value, then by item.

    Null text, lang and source count as ''; repeated rows are documents of their own; a group with
    no terms takes part with counts of 0. An empty table gives an empty result. Other columns are
    not read.
    """
    none = F.lit("")
    counts = staged(term_counts(docs, least))
    of_lang = staged(counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count")))
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"),
                                        F.sum("lang_count").alias("lang_total"))
    named = docs.select(F.coalesce("lang", none).alias("lang"),
                        F.coalesce("source", none).alias("source")).distinct()
    many = named.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / _BLOCK_SOURCES).cast("int").alias("blocks"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = staged(named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                    .join(many, "lang").select(
        "lang", "source", "lang_total", "blocks", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("v", F.lit(0)).alias("v"),
        F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("source_block"))
        .withColumn("absent", F.expr(f"CASE WHEN v > 0 THEN {_share('0')} ELSE 0 END")))
    shares = (counts.join(groups, ["lang", "source"])
              .withColumn("p", F.expr(_share("count"))))

    terms = (shares.join(of_lang, ["lang", "term"])
             .withColumn("q", F.expr(_share("lang_count", "lang_total")))
             .filter("p > q").select("lang", "source", F.lit("term").alias("part"),
                                     F.col("term").alias("item"), F.expr("p - q").alias("value")))

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shards = F.ceil(F.col("v") / _SHARD_TERMS)
    # Every source takes part in every shard of its language, with or without terms there.
    present = groups.filter("v > 0").withColumns({
        "term": F.lit(None).cast("string"), "p": F.lit(None).cast("bigint"),
        "shard": F.explode(F.sequence(F.lit(0).cast("bigint"), shards - 1))})
    gaps = (shares.withColumn("shard", F.pmod(F.xxhash64("term"), shards))
            .unionByName(present, allowMissingColumns=True)
            .select("lang", "source", "term", "p", "absent", "source_block", "shard", other.alias("y"))
            .withColumns({"i": F.least("source_block", "y"), "j": F.greatest("source_block", "y")})
            .groupBy("lang", "shard", "i", "j").applyInArrow(_gaps, _GAP)
            .groupBy("lang", "source", "item").agg(F.sum("gap").alias("gap")))
    left = groups.select("lang", "source", "absent", "v", other.alias("block"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"),
                          F.col("source_block").alias("block"))
    pairs = (left.join(right, ["lang", "block"]).filter("source <> item")
             .join(gaps, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.expr("v * abs(absent - other) + coalesce(gap, 0)").alias("value")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    return (pairs.withColumn("rank", rank)
            .unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top)))
