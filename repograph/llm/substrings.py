"""Removal of passages that an earlier document holds too, located by Aho-Corasick automata.

A window is `size` consecutive words. Every window holds anchors: phrases of `phrase` words whose
hash is the least among the phrases of the window, so equal windows hold equal anchors. About one
word in seventeen starts an anchor.

1. Anchors of all documents are counted by hash; windows of phrases in two documents are counted
   too. A window in two documents recurs and is confirmed; its first document (least doc_id)
   holds the original.
2. The first documents are dealt over shards. A shard compiles one automaton (pyahocorasick) over
   the first words of the anchors of its confirmed windows; each word is three letters of small
   alphabets.
3. Of documents that hold such an anchor, the stretches around it (found by hash) stream through
   the shard's automaton, which locates the phrases. The windows that hold one are looked up by
   two hashes among the shard's confirmed windows, each kept once with its first document; those
   of an earlier document are covered. A phrase costs one look-up per window, however many first
   documents hold it.

A document streams only through shards that hold phrases of its own; a phrase whose windows have
first documents in many shards sends its holders to each of them. The readers of a busy shard are
dealt over copies of it.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repograph.llm import words
from repograph.llm.hot import join_counted
from repograph.stage import staged

_SHARD_WINDOWS = 500_000
_COPY_READERS = 2_000
_GAP = 1                     # stands for no word
_LEAD = 6                    # words of a phrase in the automaton; the look-up tests the rest
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)     # makes the second hash of a window
# A word is three letters of 7 bits, each with an alphabet of its own, so that matches begin and end
# with words and no state has more than 128 followers.
_WORD_LETTERS, _LETTER_BITS, _FIRST_LETTER = 3, 7, 0x100
_RUN_WORDS = 1 << 20        # words of readers or originals worked on at once


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `size` consecutive values."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _least(hashes: np.ndarray, offsets: np.ndarray, size: int, phrase: int):
    """Phrases (hash, first word, row), and per window at a phrase its least hash; 0 if no window."""
    keys, starts, rows = words.window_hashes(hashes, offsets, phrase)
    span = size - phrase + 1
    if len(keys) < span:
        return keys, starts, rows, keys[:0]
    least = _sliding(keys, span, np.minimum)
    least[rows[:len(least)] != rows[span - 1:]] = 0          # crosses a row
    return keys, starts, rows, least


def _anchors(hashes: np.ndarray, offsets: np.ndarray, size: int, phrase: int):
    """Hash, first word and row of the phrases that are least in some window of their row."""
    keys, starts, rows, least = _least(hashes, offsets, size, phrase)
    if not len(least):
        return keys[:0], starts[:0], rows[:0]
    span = size - phrase + 1
    edge = np.zeros(span - 1, np.uint64)
    # The greatest of the minima of all windows that hold the phrase; equal only if it is least.
    greatest = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    chosen = np.flatnonzero((greatest == keys) & (keys > 0))
    return keys[chosen], starts[chosen], rows[chosen]


def _windows(hashes: np.ndarray, offsets: np.ndarray, size: int, phrase: int):
    """Hash, least phrase, first word and row of every window."""
    _, starts, rows, least = _least(hashes, offsets, size, phrase)
    at = np.flatnonzero(least)
    starts = starts[at]
    found = words.stretch_hashes(words.prefix_sums(hashes), starts, starts + size)
    return found, least[at], starts, rows[at]


_BASE = "doc_id bigint, text_hash bigint, n_words bigint, kept_sha256 string, anchors array<bigint>"


def _scanned(docs: DataFrame, size: int, phrase: int) -> DataFrame:
    """Per row: its key, number of words, digest of all words, and distinct anchors."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for part in words.slices(texts):
                keys, _, rows = _anchors(part.word_hashes(), part.word_offsets, size, phrase)
                _, once = np.unique(words.in_row(keys, rows), return_index=True)
                once.sort()
                bounds = np.searchsorted(rows[once], np.arange(part.rows + 1))
                flat = pa.array(keys[once].view(np.int64))
                data = part.data.tobytes()
                digests = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest()
                           for a, b in zip(part.offsets, part.offsets[1:])]
                to = slice(part.first, part.first + part.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[to], batch.column(1)[to],
                     pa.array(np.diff(part.word_offsets)), pa.array(digests),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)],
                    names=["doc_id", "text_hash", "n_words", "kept_sha256", "anchors"])

    return docs.mapInArrow(run, _BASE)


def _flat(column: pa.Array) -> np.ndarray:
    return np.unique(column.flatten().to_numpy().view(np.uint64))


def _among(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def _confirming(size: int, phrase: int):
    """Windows with a recurring phrase: hash, least and greatest doc_id of the batch."""
    def run(batches):
        for batch in batches:
            shared = _flat(batch.column("shared"))
            ids = batch.column("doc_id").to_numpy()
            for part in words.slices(batch.column("text")):
                found, least, _, rows = _windows(part.word_hashes(), part.word_offsets, size, phrase)
                ok = _among(least, shared)
                found, doc = found[ok], ids[part.first + rows[ok]]
                order = np.lexsort((doc, found))
                found, doc = found[order], doc[order]
                new = np.flatnonzero(np.append(True, found[1:] != found[:-1])[:len(found)])
                last = np.append(new[1:], len(found)) - 1 if len(new) else new
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[new].view(np.int64)), pa.array(doc[new]), pa.array(doc[last])],
                    names=["window", "first", "last"])
    return run


_ORIGINAL = ("shard int, doc_id bigint, text_hash bigint, hashes binary, starts binary, "
             "windows binary, phrases array<bigint>")


def _cut(own: np.ndarray, at: np.ndarray, windows: np.ndarray, size: int, phrase: int):
    """The words around the phrases at `at`, no word (0) between stretches.

    Then the places there of the phrases, and of the windows as runs (first window, how many).
    """
    side = size - phrase
    begins, ends = np.maximum(at - side, 0), np.minimum(at + size, len(own))
    opens = np.append(True, begins[1:] > ends[:-1])[:len(at)]
    new = np.flatnonzero(opens)
    if not len(new):
        return own[:0], at, np.zeros((0, 2), np.int64)
    begins, ends = begins[new], ends[np.append(new[1:], len(at)) - 1]
    gap = np.zeros(side, np.uint64)
    places = np.cumsum(ends - begins + side) - (ends - begins + side)
    moved = at + (places - begins)[np.cumsum(opens) - 1]
    # Every window lies in the stretch around its least phrase.
    windows = windows + (places - begins)[np.searchsorted(begins, windows, "right") - 1]
    runs = np.flatnonzero(np.append(True, np.diff(windows) != 1)[:len(windows)])
    lengths = np.diff(np.append(runs, len(windows)))
    return np.concatenate([x for p, q in zip(begins.tolist(), ends.tolist())
                           for x in (own[p:q], gap)]), moved, np.stack([windows[runs], lengths], 1)


def _originals(size: int, phrase: int):
    """First documents: the words around the anchors of their confirmed windows.

    starts: the anchors' places there; windows: runs of confirmed windows.
    """
    def run(batches):
        for batch in batches:
            confirmed = _flat(batch.column("windows"))
            for part in words.slices(batch.column("text")):
                hashes = part.word_hashes()
                to = slice(part.first, part.first + part.rows)
                out = []
                for r in range(part.rows):
                    own = hashes[part.word_offsets[r]:part.word_offsets[r + 1]]
                    bounds = np.array([0, len(own)])
                    found, least, begins, _ = _windows(own, bounds, size, phrase)
                    ok = _among(found, confirmed)
                    wanted = np.unique(least[ok])
                    keys, starts, _ = _anchors(own, bounds, size, phrase)
                    stretches, at, runs = _cut(own, starts[_among(keys, wanted)], begins[ok], size,
                                               phrase)
                    out.append((stretches.tobytes(), at.astype(np.int64).tobytes(),
                                runs.astype(np.int64).tobytes(), wanted.view(np.int64)))
                own, at, runs, wanted = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard")[to], batch.column("doc_id")[to],
                     batch.column("text_hash")[to], pa.array(own, pa.binary()),
                     pa.array(at, pa.binary()), pa.array(runs, pa.binary()),
                     pa.array(wanted, pa.list_(pa.int64()))],
                    names=["shard", "doc_id", "text_hash", "hashes", "starts", "windows",
                           "phrases"])
    return run


_STREAM = ("shard int, copy int, kind int, doc_id bigint, text_hash bigint, hashes binary, "
           "starts binary, windows binary")


def _readers(copies: dict[int, int], size: int, phrase: int):
    """One row per document and shard: the stretches around the anchors that the shard has.

    hashes: the words of the stretches, with a gap between them; starts: where each stretch begins
    in the document, and its length; windows: null.
    """
    side = size - phrase
    gap = np.full(side, _GAP, np.uint64)

    def run(batches):
        for batch in batches:
            routes, ids = batch.column("routes").to_pylist(), batch.column("doc_id").to_pylist()
            text_hash = batch.column("text_hash").to_pylist()
            for part in words.slices(batch.column("text")):
                hashes = part.word_hashes()
                keys, starts, _ = _anchors(hashes, part.word_offsets, size, phrase)
                bounds = np.searchsorted(starts, part.word_offsets)
                out = []
                for r in range(part.rows):
                    at, (a, b) = part.first + r, part.word_offsets[r:r + 2]
                    own, places = keys[bounds[r]:bounds[r + 1]], starts[bounds[r]:bounds[r + 1]]
                    for route in routes[at]:
                        wanted = np.sort(np.array(route["anchors"], np.int64).view(np.uint64))
                        hit = places[_among(own, wanted)]
                        begins, ends = np.maximum(hit - side, a), np.minimum(hit + size, b)
                        new = np.flatnonzero(np.append(True, begins[1:] > ends[:-1])[:len(hit)])
                        spans = list(zip(begins[new].tolist(),
                                         ends[np.append(new[1:], len(hit)) - 1].tolist()))
                        if not spans:
                            continue
                        parts = [x for p, q in spans for x in (hashes[p:q], gap)]
                        s = route["shard"]
                        out.append((
                            s, (text_hash[at] ^ ids[at]) % copies.get(s, 1), 1, ids[at],
                            text_hash[at], np.concatenate(parts).tobytes(),
                            np.array([(p - a, q - p) for p, q in spans], np.int64).tobytes(),
                            None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, [
                        pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(),
                        pa.binary(), pa.binary(), pa.binary()])],
                    names=["shard", "copy", "kind", "doc_id", "text_hash", "hashes", "starts",
                           "windows"])
    return run


def _letters(hashes: np.ndarray) -> str:
    """The letters of all words; equal words get equal letters."""
    out = np.empty((len(hashes), _WORD_LETTERS), "<u2")
    for j in range(_WORD_LETTERS):
        bits = (hashes >> np.uint64(j * _LETTER_BITS)) & np.uint64((1 << _LETTER_BITS) - 1)
        out[:, j] = bits + np.uint64(_FIRST_LETTER + (j << _LETTER_BITS))
    return out.tobytes().decode("utf-16-le")


class _Shard:
    """The recurring phrases of some first documents, and their confirmed windows."""

    def __init__(self, size: int, phrase: int):
        self.size, self.phrase, self.side = size, phrase, size - phrase
        self.lead = min(_LEAD, phrase)
        self.phrases: set[str] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.automaton = None

    def _hashes(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return words.stretch_hashes(words.prefix_sums(hashes), at, at + self.size)

    def add(self, doc: int | np.ndarray, hashes: np.ndarray, starts: np.ndarray,
            runs: np.ndarray) -> None:
        """Words of a first document, or of several one after another (doc: whose each word is), the
        places of their phrases, and their confirmed windows as runs (first window, how many)."""
        letters, n = _letters(hashes), _WORD_LETTERS
        self.phrases.update(letters[s * n:(s + self.lead) * n] for s in starts.tolist())
        first, n = runs.T
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        self.parts.append((self._hashes(hashes, at), self._hashes(words.mix(hashes ^ _SECOND), at),
                           np.broadcast_to(doc, len(hashes))[at]))

    def compiled(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for key in self.phrases:
            self.automaton.add_word(key, True)
        self.automaton.make_automaton()
        window, second, owner = (np.concatenate(x) for x in zip(*self.parts))
        self.phrases, self.parts = set(), []
        order = np.lexsort((owner, window))
        once = order[np.append(True, np.diff(window[order]) != 0)[:len(order)]]
        self.window, self.second, self.owner = window[once], second[once], owner[once]

    def covered(self, doc: int | np.ndarray, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that windows of earlier documents cover, of a document or of several one after
        another (doc: whose each word is) with a gap between them.
        """
        last = np.fromiter((end for end, _ in self.automaton.iter(_letters(hashes))), np.int64)
        n = len(hashes) - self.size + 1
        if not len(last) or n < 1 or not len(self.window):
            return []
        phrases = last // _WORD_LETTERS - self.lead + 1
        holding = np.zeros(n + 1, np.int64)
        np.add.at(holding, np.minimum(np.maximum(phrases - self.side, 0), n), 1)
        np.add.at(holding, np.minimum(phrases + 1, n), -1)
        at = np.flatnonzero(np.cumsum(holding)[:n] > 0)
        found = self._hashes(hashes, at)
        place = np.minimum(np.searchsorted(self.window, found), len(self.window) - 1)
        ok = (self.window[place] == found) & (self.owner[place] < np.broadcast_to(doc, len(hashes))[at])
        at, place = at[ok], place[ok]
        at = at[self._hashes(words.mix(hashes ^ _SECOND), at) == self.second[place]]
        cover = np.zeros(len(hashes) + 1, np.int64)
        cover[at] += 1
        cover[at + self.size] -= 1
        inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _joined(values: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _add_originals(shard: _Shard, rows: list[dict]) -> None:
    sizes = np.array([len(r["hashes"]) // 8 for r in rows])
    base = np.cumsum(sizes) - sizes
    starts, runs = _joined([r["starts"] for r in rows], np.int64), _joined(
        [r["windows"] for r in rows], np.int64).reshape(-1, 2).copy()
    starts = starts + np.repeat(base, [len(r["starts"]) // 8 for r in rows])
    runs[:, 0] += np.repeat(base, [len(r["windows"]) // 16 for r in rows])
    shard.add(np.repeat([r["doc_id"] for r in rows], sizes),
              _joined([r["hashes"] for r in rows], np.uint64), starts, runs)


def _covered_readers(shard: _Shard, rows: list[dict], side: int) -> list[tuple]:
    """doc_id, text_hash and the covered stretches of every reader that has some."""
    sizes = np.array([len(r["hashes"]) // 8 for r in rows])
    spans = np.array(shard.covered(np.repeat([r["doc_id"] for r in rows], sizes),
                                   _joined([r["hashes"] for r in rows], np.uint64)))
    if not len(spans):
        return []
    # From the stretches of all readers to the words of each one's document.
    begins, lengths = _joined([r["starts"] for r in rows], np.int64).reshape(-1, 2).T
    places = np.cumsum(lengths + side) - (lengths + side)
    move = (begins - places)[np.searchsorted(places, spans[:, 0], "right") - 1]
    bounds = np.searchsorted(spans[:, 0], np.concatenate([[0], np.cumsum(sizes)]))
    spans = spans + move[:, None]
    return [(r["doc_id"], r["text_hash"], spans[a:b, 0], spans[a:b, 1])
            for r, a, b in zip(rows, bounds.tolist(), bounds[1:].tolist()) if a < b]


def _located(size: int, phrase: int):
    names = ["shard", "copy", "kind", "doc_id", "text_hash", "hashes", "starts", "windows"]

    def runs(batch):
        """Rows of one shard, copy and kind, of at most _RUN_WORDS words or one row."""
        run, key, held = [], None, 0
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            n = len(row[5]) // 8
            if run and (row[:3] != key or held + n > _RUN_WORDS):
                yield key, run
                run, held = [], 0
            key, held = row[:3], held + n
            run.append(dict(zip(names, row)))
        if run:
            yield key, run

    def located(batches):
        current, shard = None, None
        for batch in batches:
            out = []
            for (s, c, kind), rows in runs(batch):
                if (s, c) != current:
                    current, shard = (s, c), _Shard(size, phrase)
                if kind == 0:
                    _add_originals(shard, rows)
                    continue
                if shard.automaton is None:
                    if not shard.parts:
                        continue
                    shard.compiled()
                out += _covered_readers(shard, rows, size - phrase)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [
                        pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])],
                    names=["doc_id", "text_hash", "starts", "ends"])
    return located


def _keep_words(text: str, starts: list, ends: list) -> tuple[bytes, int]:
    own = (text or "").encode().split()
    drop = np.zeros(len(own), bool)
    for a, b in zip(starts, ends):
        drop[a:b] = True
    return b" ".join([w for w, d in zip(own, drop.tolist()) if not d]), int(drop.sum())


def repeated_stretches(docs: DataFrame, text: str = "text", size: int = 50, phrase: int = 18
                       ) -> tuple[DataFrame, DataFrame]:
    """What `remove_repeats` is made of.

    First: doc_id, text_hash, n_words, kept_sha256 (of all words) of every row. Second: doc_id,
    text_hash, text, starts, ends: the stretches of words to remove, of rows that have some.
    """
    spark = docs.sparkSession
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    base = staged(_scanned(read, size, phrase))
    keys = ["doc_id", "text_hash"]
    anchors = (base.filter("doc_id IS NOT NULL AND size(anchors) > 0")
               .select(*keys, F.explode("anchors").alias("anchor")))
    recurring = staged(anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.count(F.lit(1)).alias("holders")).filter("first < last").drop("last"))
    total = max(recurring.agg(F.sum("holders")).first()[0] or 0, 1000)
    held = staged(join_counted(anchors, recurring.select("anchor", "holders"), ["anchor"],
                               "holders", total, "inner"))
    involved = staged(read.filter("doc_id IS NOT NULL").join(
        held.groupBy(*keys).agg(F.collect_set("anchor").alias("shared")), keys))
    confirmed = staged(involved.mapInArrow(
        _confirming(size, phrase), "window bigint, first bigint, last bigint").groupBy("window")
        .agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last")
        .select("window", "first"))
    shards = max(1, -(-confirmed.count() // _SHARD_WINDOWS))
    firsts = confirmed.groupBy(F.col("first").alias("doc_id")).agg(
        F.collect_list("window").alias("windows"),
        F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard"))
    originals = staged(involved.drop("shared").join(firsts, "doc_id").mapInArrow(
        _originals(size, phrase), _ORIGINAL))
    # Shards by anchor: with the number of its holders, for the join.
    placed = (originals.select("shard", F.explode("phrases").alias("anchor"))
              .groupBy("anchor").agg(F.collect_set("shard").alias("shards"))
              .join(recurring.select("anchor", "holders"), "anchor"))
    by_shard = (join_counted(held.select(*keys, "anchor"), placed, ["anchor"], "holders", total,
                             "inner")
                .select(*keys, "anchor", F.explode("shards").alias("shard"))
                .groupBy(*keys, "shard").agg(F.collect_set("anchor").alias("anchors")))
    routes = staged(by_shard.groupBy(*keys).agg(
        F.collect_list(F.struct("shard", "anchors")).alias("routes")))
    busy = {r["shard"]: r["count"] for r in routes.select(F.explode("routes.shard").alias("shard"))
            .groupBy("shard").count().filter(f"count > {_COPY_READERS}").collect()}
    copies = {s: -(-n // _COPY_READERS) for s, n in busy.items()}
    many = F.create_map(*[F.lit(x) for s, n in copies.items() for x in (s, n)]) if copies else None
    last = F.lit(0) if many is None else F.coalesce(F.try_element_at(many, "shard"), F.lit(1)) - 1
    sources = originals.select("shard", F.explode(F.sequence(F.lit(0), last)).alias("copy"),
                               F.lit(0).alias("kind"), "doc_id", "text_hash", "hashes", "starts", "windows")
    streams = involved.drop("shared").join(routes, keys).mapInArrow(
        _readers(copies, size, phrase), _STREAM).unionByName(sources)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    located = (streams.repartition(parts, "shard", "copy")
               .sortWithinPartitions("shard", "copy", "kind")
               .mapInArrow(_located(size, phrase), "doc_id bigint, text_hash bigint, "
                           "starts array<bigint>, ends array<bigint>"))
    spans = located.groupBy(*keys).agg(F.flatten(F.collect_list("starts")).alias("starts"),
                                       F.flatten(F.collect_list("ends")).alias("ends"))
    return base.drop("anchors"), involved.select(*keys, "text").join(spans, keys)


def remove_repeats(docs: DataFrame, text: str = "text", size: int = 50,
                   phrase: int = 18) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, where words go, kept_text, of every row.

    A word goes if a window of `size` words that covers it also starts in a document with a
    smaller doc_id. Windows are those of the input. kept_sha256 is of the kept words joined by one
    space. A null text has no words. A row with a null doc_id neither loses words nor makes others
    lose any. Rows with one doc_id are not earlier than each other. Other columns are not read.
    """
    base, hit = repeated_stretches(docs, text, size, phrase)

    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            out = [(doc, h, *_keep_words(t, a, b)) for doc, h, t, a, b in zip(*cols)]
            kept = [k.decode() for _, _, k, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for *_, n in out], pa.int64()),
                 pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
                 pa.array(kept, pa.string())],
                names=["doc_id", "text_hash", "n_removed", "sha", "kept_text"])

    changed = hit.mapInArrow(run, "doc_id bigint, text_hash bigint, n_removed bigint, sha string, "
                             "kept_text string").dropDuplicates(["doc_id", "text_hash"])
    return base.join(changed, ["doc_id", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"), "kept_text")
