"""Benchmark decontamination: a broadcast set of test n-grams, and one scan of the documents' windows.

1. Every window of `size` consecutive normalised words of a benchmark item is one gram; an item of
   fewer words, but not none, is one gram of all its words. Equal grams are one, with all its items.
2. The grams are measured. Those that fit `broadcast_bytes` are broadcast as sorted 64-bit hashes,
   with their words beside them.
3. Documents stream past once. The hash of every window is looked up; a window whose hash is found
   is verified word for word, byte for byte, and only then its words are hit.

Nothing is shuffled but the benchmark. A benchmark beyond the bound is dealt by hash over parts that
fit it; each part is broadcast to a scan of its own, and what the parts find in a text is united by
two 64-bit hashes of the text. Results do not depend on the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from repograph.llm import words
from repograph.llm.hot import join_counted
from repograph.stage import staged

#: Letters, digits and everything beyond ASCII make words; A-Z are lowered; all else separates.
_NORMAL = np.where(np.arange(256) < 128, 32, np.arange(256)).astype(np.uint8)
for _first, _last in (b"09", b"az"):
    _NORMAL[_first:_last + 1] = np.arange(_first, _last + 1)
_NORMAL[65:91] = np.arange(97, 123)
_FILTER_BITS = 22           # a bitmap of so many bits of the hash is asked before the sorted hashes


def _spelled(part: words.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice with one space behind each, and where each begins and ends there."""
    lengths = part.ends - part.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    source = np.arange(int(lengths.sum())) + np.repeat(part.starts - (np.cumsum(lengths) - lengths),
                                                       lengths)
    out[source + np.repeat(starts - part.starts, lengths)] = part.data[source]
    return out, starts, ends


def _grams(size: int):
    """From (item_id, text) to (gram, n, item_id): the words of a gram joined by one space."""
    def run(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            for part in words.slices(batch.column(1), table=_NORMAL):
                body, starts, ends = _spelled(part)
                body = body.tobytes()
                out = []
                for row in range(part.rows):
                    lo, hi = part.word_offsets[row:row + 2].tolist()
                    n = min(size, hi - lo)
                    item = items[part.first + row]
                    out += [(body[starts[k]:ends[k + n - 1]].decode(), n, item)
                            for k in range(lo, hi - n + 1) if n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []),
                                                    (pa.string(), pa.int32(), pa.string()))],
                    names=["gram", "n", "item_id"])
    return run


def benchmark_grams(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """gram, n (its words), items (distinct item_ids as text, sorted) of every distinct gram.

    Rows with one item_id are one item. A null text has no grams. The grams of a null item_id are
    hit like others, but belong to no item.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            F.col("text").alias("text"))
    return (rows.mapInArrow(_grams(size), "gram string, n int, item_id string")
            .groupBy("gram", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items")))


class GramSet:
    """Distinct grams by word count: sorted hashes, their bytes, and the items of each."""

    def __init__(self, grams: list[str], sizes: list[int], items: list[list[str]]):
        names = sorted({i for own in items for i in own})
        code = {name: k for k, name in enumerate(names)}
        self.names, self.by_size = names, {}
        for n in sorted(set(sizes)):
            own = [k for k, m in enumerate(sizes) if m == n]
            texts = [grams[k].encode() for k in own]
            hashes = np.concatenate([words.window_hashes(p.word_hashes(), p.word_offsets, n)[0]
                                     for p in words.slices(pa.array([grams[k] for k in own]))])
            order = np.argsort(hashes, kind="stable")
            self.by_size[n] = _SizedGrams(hashes[order], [texts[k] for k in order.tolist()],
                                          [[code[i] for i in items[own[k]]] for k in order.tolist()])


class _SizedGrams:
    def __init__(self, hashes: np.ndarray, texts: list[bytes], items: list[list[int]]):
        self.hashes = hashes
        self.body = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.items = np.array([i for own in items for i in own], np.int64)
        self.item_ends = np.cumsum([len(own) for own in items])
        self.present = np.zeros(1 << _FILTER_BITS, bool)
        self.present[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def matches(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in `hashes` and a gram with that hash."""
        at = np.flatnonzero(self.present[hashes >> np.uint64(64 - _FILTER_BITS)])
        lo = np.searchsorted(self.hashes, hashes[at], "left")
        counts = np.searchsorted(self.hashes, hashes[at], "right") - lo
        ends = np.cumsum(counts)
        grams = np.arange(counts.sum()) + np.repeat(lo - (ends - counts), counts)
        return np.repeat(at, counts), grams

    def equal(self, grams: np.ndarray, body: np.ndarray, begins: np.ndarray, ends: np.ndarray
              ) -> np.ndarray:
        """Whether body[begins:ends] is the gram, byte for byte."""
        lengths = self.ends[grams] - self.begins[grams]
        same = lengths == ends - begins
        some = np.flatnonzero(same)
        n = lengths[some]
        if len(some):
            first = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(first, n)
            ok = (body[inside + np.repeat(begins[some], n)]
                  == self.body[inside + np.repeat(self.begins[grams[some]], n)])
            same[some] = np.logical_and.reduceat(ok, first)
        return same

    def items_of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in `grams` and item, for all items of the grams."""
        counts = self.item_ends[grams] - np.where(grams > 0, self.item_ends[grams - 1], 0)
        first = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(self.item_ends[grams] - counts - first, counts)
        return np.repeat(np.arange(len(grams)), counts), self.items[at]


def _hits(part: words.Slice, grams: GramSet) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which words of the slice are hit, and of (row, item code) the occurring pairs."""
    change = np.zeros(len(part.starts) + 1, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    spelled, hashes = None, part.word_hashes()
    for n, own in grams.by_size.items():
        keys, starts, rows = words.window_hashes(hashes, part.word_offsets, n)
        at, gram = own.matches(keys)
        if not len(at):
            continue
        spelled = spelled or _spelled(part)
        body, begins, ends = spelled
        real = own.equal(gram, body, begins[starts[at]], ends[starts[at] + n - 1])
        at, gram = at[real], gram[real]
        np.add.at(change, starts[at], 1)
        np.add.at(change, starts[at] + n, -1)
        where, item = own.items_of(gram)
        found.append(np.unique(np.stack([rows[at[where]], item], 1), axis=0))
    return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(found), axis=0)


_KEYS = ["text_hash", "text_hash2"]
_FOUND = StructType([StructField(name, kind) for name, kind in {
    "text_hash": LongType(), "text_hash2": LongType(), "n_words": LongType(), "n_hit": LongType(),
    "items": ArrayType(StringType()), "starts": ArrayType(LongType()),
    "ends": ArrayType(LongType()), "clean": StringType()}.items()])


def _cut(body: np.ndarray, part: words.Slice, row: int, starts: np.ndarray, ends: np.ndarray) -> str:
    """The row's text without the characters from the first to the last word of each run."""
    keep, at = [], int(part.offsets[row])
    for a, b in zip(starts.tolist(), ends.tolist()):
        keep.append(body[at:part.starts[a]])
        at = int(part.ends[b - 1])
    return np.concatenate([*keep, body[at:part.offsets[row + 1]]]).tobytes().decode()


def _runs(part: words.Slice, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and the one behind the last, of every run of hit words within one row."""
    edges = np.diff(hit.astype(np.int8), prepend=0, append=0)
    between = np.unique(part.word_offsets[1:-1])
    between = between[(between > 0) & (between < len(hit))]
    between = between[hit[between] & hit[between - 1]]
    return (np.sort(np.concatenate([np.flatnonzero(edges == 1), between])),
            np.sort(np.concatenate([np.flatnonzero(edges == -1), between])))


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """One list per row of the values that belong to it; `rows` is sorted."""
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _scan(grams, kept: list[str], only_hit: bool, clean: bool):
    """From the kept columns, the hashes and the text to the kept columns and `_FOUND`.

    `clean` is the cut text of a row that is hit, if asked for.
    """
    width = len(kept)

    def run(batches):
        own = grams.value
        for batch in batches:
            texts = batch.column(width + 2)
            raw = words.slices(texts) if clean else iter(())
            for part in words.slices(texts, table=_NORMAL):
                body = next(raw).data if clean else None
                hit, pairs = _hits(part, own)
                starts, ends = _runs(part, hit)
                of = np.searchsorted(part.word_offsets, starts, "right") - 1
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[part.word_offsets])
                cut = [None] * part.rows
                if clean:
                    bounds = np.searchsorted(of, np.arange(part.rows + 1))
                    for row in np.flatnonzero(n_hit).tolist():
                        some = slice(bounds[row], bounds[row + 1])
                        cut[row] = _cut(body, part, row, starts[some], ends[some])
                move = part.word_offsets[of]
                out = pa.RecordBatch.from_arrays(
                    [*(c.slice(part.first, part.rows) for c in batch.columns[:width + 2]),
                     pa.array(np.diff(part.word_offsets), pa.int64()), pa.array(n_hit, pa.int64()),
                     _lists(pairs[:, 0], part.rows,
                            pa.array([own.names[k] for k in pairs[:, 1].tolist()], pa.string())),
                     _lists(of, part.rows, pa.array(starts - move, pa.int64())),
                     _lists(of, part.rows, pa.array(ends - move, pa.int64())),
                     pa.array(cut, pa.string())],
                    names=[*kept, *_FOUND.names])
                yield out.filter(pa.array(n_hit > 0)) if only_hit else out
    return run


def _united(batches):
    """Unite the runs and items that several parts found in one text, and cut its text anew."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs: list[list[int]] = []
            for a, b in sorted((a, b) for f in r["found"] for a, b in zip(f["starts"], f["ends"])):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            starts, ends = [a for a, _ in runs], [b for _, b in runs]
            out.append({**{k: r[k] for k in (*_KEYS, "n_words", "holders")},
                        "n_hit": sum(b - a for a, b in runs), "starts": starts, "ends": ends,
                        "items": sorted({i for f in r["found"] for i in f["items"]})})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            *((k, pa.int64()) for k in (*_KEYS, "n_words", "holders", "n_hit")),
            ("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int64()))]))


def _recut(batches):
    """From (row, text, n_words, n_hit, items, starts, ends) to the same with the cut text."""
    for batch in batches:
        out = []
        for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 5, 6))):
            if not starts:
                out.append(None)
                continue
            raw = next(words.slices(pa.array([text])))
            part = next(words.slices(pa.array([text]), table=_NORMAL))
            out.append(_cut(raw.data, part, 0, np.array(starts), np.array(ends)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(out, pa.string())],
            names=["row", *batch.schema.names[2:], "clean"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = 10,
                       clean: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """row, n_words, n_hit, items, starts, ends of every row of `docs`, and `clean` if asked for.

    A word is a run of letters, digits and characters beyond ASCII, A-Z lowered. It is hit if a
    window that is a gram of `benchmark` covers it. items: item_ids as text, sorted, whose grams
    occur. starts and ends: the runs of hit words, each as its first word and the one behind its
    last. clean: the text without the characters from the first to the last word of each run; null
    where nothing is hit. row: a struct of the columns in `keep`, so no name can clash.

    A null or empty text has no words. Every row is judged for itself, whatever its doc_id; equal
    rows give equal results. An empty benchmark hits nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    grams = staged(benchmark_grams(benchmark, size))
    # 16 bytes a gram for the hash and the place of its text, 8 for each item.
    need = grams.agg(F.sum(F.octet_length("gram") + 16 + 8 * F.size("items"))).first()[0] or 0
    parts = max(1, -(-need // broadcast_bytes))
    text = F.col("text")
    read = docs.select(F.struct(*keep).alias("row"), text, F.xxhash64(text).alias("text_hash"),
                       F.xxhash64(text, F.lit(1)).alias("text_hash2"))
    found = ["n_words", "n_hit", "items", "starts", "ends"]

    def scan(own: GramSet, kept: list[str], only_hit: bool, cut: bool) -> DataFrame:
        schema = StructType([read.schema[c] for c in kept] + _FOUND.fields)
        return read.select(*kept, *_KEYS, text.alias("_text")).mapInArrow(
            _scan(spark.sparkContext.broadcast(own), kept, only_hit, cut), schema)

    def gram_set(k: int) -> GramSet:
        own = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toArrow().to_pydict()
        return GramSet(own["gram"], own["n"], own["items"])

    if parts == 1:
        return scan(gram_set(0), ["row"], False, clean).select(
            "row", *found, *(["clean"] if clean else []))
    hits = None
    for k in range(parts):
        # Rows with equal hashes have one text and find the same: one speaks for all.
        one = scan(gram_set(k), [], True, False).groupBy(*_KEYS).agg(
            F.count(F.lit(1)).alias("holders"), F.first("n_words").alias("n_words"),
            F.first(F.struct("items", "starts", "ends")).alias("found"))
        hits = one if hits is None else hits.unionByName(one)
    united = staged(hits.groupBy(*_KEYS).agg(
        F.max("holders").alias("holders"), F.first("n_words").alias("n_words"),
        F.collect_list("found").alias("found")).mapInArrow(
            _united, "text_hash bigint, text_hash2 bigint, n_words bigint, holders bigint, "
            "n_hit bigint, items array<string>, starts array<bigint>, ends array<bigint>"))
    total = max(united.agg(F.sum("holders")).first()[0] or 0, 1000)
    carried = ["row", "text"] if clean else ["row"]
    counted = scan(GramSet([], [], []), carried, False, False).select(*carried, *_KEYS, "n_words")
    joined = join_counted(counted, united.drop("n_words"), _KEYS, "holders", total).select(
        *carried, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        *[F.coalesce(c, F.array().cast(_FOUND[c].dataType)).alias(c)
          for c in ("items", "starts", "ends")])
    if not clean:
        return joined
    return joined.mapInArrow(_recut, StructType(
        [f for f in joined.schema if f.name != "text"] + [_FOUND["clean"]]))


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10,
                 broadcast_bytes: int = 64 << 20) -> DataFrame:
    """`docs` with the runs of hit words cut out of `text`; no other column or row changes.

    A run goes from its first word's first character to its last word's last; what stands around
    it stays. A null text stays null.
    """
    found = find_contamination(docs, benchmark, docs.columns, size, True, broadcast_bytes)
    return found.select(*[F.coalesce("clean", "row.text").alias("text") if c == "text"
                          else F.col(f"row.`{c}`") for c in docs.columns])


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, share: float = 0.0,
                     broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of `docs` of which at most `share` of the words are hit."""
    found = find_contamination(docs, benchmark, docs.columns, size, False, broadcast_bytes)
    return found.filter(F.col("n_hit") <= F.lit(share) * F.col("n_words")).select("row.*")
