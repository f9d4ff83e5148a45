"""Katz backoff language model over words, trained on part of the corpus and applied to all of it.

Tokens are lower-case words and one end per text. P(w | h) for the word h before (or the start):
for a pair counted c times in training d(c) * c / c(h), with Good-Turing discounts d for counts up
to five; for others alpha(h) * P(w), where alpha(h) spreads what the discounts left so that the
probabilities of all words sum to one. P(w) is discounted the same way, and what that leaves is the
probability of an unknown word.

Words and pairs are known by 64-bit hashes. The documents of a task form blocks of about one
million tokens; a block asks each shard of the count tables about its distinct words, then about
its distinct pairs, in sorted arrays. A shard adds up the training counts of all blocks and answers
each. So a word or pair costs one entry per block however often it stands there, and the busiest
ones no more than others. Contexts with more than a shard's share of all tokens are spread over
the shards by the second word, and their sums are added up afterwards.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from repograph.llm import words
from repograph.stage import stage_folder, staged

_BLOCK_TOKENS = 1_000_000
_CUT = 5                     # counts beyond it are not discounted
_U = np.uint64
_END = words.mix(np.array([0x456E64], _U))[0]
_START = words.mix(np.array([0x5374617274], _U))[0]

_BLOCK = ("block bigint, docs binary, known_id binary, learn binary, sizes binary, tokens binary, "
          "words binary")
_ASK = "block bigint, shard int, words binary, counts binary"


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts d[1..5] from the numbers of items counted 1..6 times.

    Where the estimate is not between 0 and 1, half a count is taken off.
    """
    n = [0, *of_counts]
    d = np.ones(_CUT + 1)
    rest = (_CUT + 1) * n[_CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, _CUT + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """P(w) from a word's count; the probability of an unknown word."""

    def __init__(self, total: int, of_counts: list[int]):
        self.total, self.d = total, discounts(of_counts)
        used = sum(self.d[r] * r * of_counts[r - 1] for r in range(1, _CUT + 1))
        low = sum(r * of_counts[r - 1] for r in range(1, _CUT + 1))
        # Without low counts nothing is left over: then an unknown word counts as one more token.
        self.spare = 0 if low else 1
        self.unknown = (low - used) / total if low else 1 / (total + 1)
        if not total:
            self.unknown = 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        rate = counts * self.d[np.minimum(counts, _CUT + 1) % (_CUT + 1)]
        return np.where(counts > 0, rate / max(self.total + self.spare, 1), self.unknown)


def _pack(x: np.ndarray) -> bytes:
    """Counts compressed: the width and number of the values, then their first bytes, second, ..."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return (bytes([width]) + len(x).to_bytes(8, "little")
            + pa.compress(planes, codec="zstd", asbytes=True))


def _unpack(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = pa.decompress(b[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    rows = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T)
    return rows.view(f"<u{width}").ravel().astype(np.int64)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
             "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)],
                                      names=[n for n, _ in fields])


def _blocks():
    """Documents as blocks: ids, sizes, and tokens as places in the block's sorted words."""
    def run(batches):
        held, have, made = [], 0, 0

        def block():
            hashes = np.concatenate([h[3] for h in held])
            found, place = np.unique(hashes, return_inverse=True)
            ids = np.concatenate([h[0] for h in held])
            name = (TaskContext.get().partitionId() << 24) + made
            return (name, *(np.concatenate([h[i] for h in held]).tobytes() for i in (0, 4, 1, 2)),
                    place.astype(np.int32).tobytes(), found.tobytes()) if len(ids) else None

        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid()).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for part in words.slices(batch.column(2)):
                part.data = words.LOWER[part.data]
                own = part.word_hashes()
                ends = part.word_offsets[1:]
                hashes = np.insert(own, ends, _END)
                to = slice(part.first, part.first + part.rows)
                held.append((ids[to], learn[to],
                             (np.diff(part.word_offsets) + 1).astype(np.int32), hashes, known[to]))
                have += len(hashes)
                if have >= _BLOCK_TOKENS:
                    yield _batch(_BLOCK, [block()])
                    held, have, made = [], 0, made + 1
        if held:
            yield _batch(_BLOCK, [block()])
    return run


class _Read:
    """A block's arrays."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.known_id = np.frombuffer(row["known_id"], np.uint8)
        self.learn = np.frombuffer(row["learn"], np.uint8)
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.tokens = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
        self.words = np.frombuffer(row["words"], _U)
        self.learned = np.repeat(self.learn, self.sizes)          # per token

    def pairs(self):
        """Distinct (context, word) codes, and each token's place among them; the start is last."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        codes, place = np.unique(before * (len(self.words) + 1) + self.tokens, return_inverse=True)
        return *np.divmod(codes, len(self.words) + 1), place


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _cuts(sorted_shards: np.ndarray):
    edges = np.flatnonzero(np.diff(sorted_shards)) + 1
    edges = [0, *edges.tolist(), len(sorted_shards)]
    return [(int(sorted_shards[a]), a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _ask_words(bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _Read(row)
                counts = np.bincount(own.tokens, weights=own.learned, minlength=len(own.words))
                yield _batch(_ASK, [
                    (row["block"], s, own.words[a:b].tobytes(), _pack(counts[a:b]))
                    for s, a, b in _cuts(_shard(own.words, bits))])
    return run


def _grouped(batches, key: str):
    """Rows of one key after another; the input is sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in range(1, _CUT + 2)]


_TOLD = "block bigint, shard int, counts binary, facts array<bigint>"


def _tell_words(batches):
    """Training counts of every word that a block asked for; per shard N, V and counts of counts."""
    for rows in _grouped(batches, "shard"):
        asked = [np.frombuffer(r["words"], _U) for r in rows]
        found, place = np.unique(np.concatenate(asked), return_inverse=True)
        given = np.concatenate([_unpack(r["counts"]) for r in rows])
        total = np.bincount(place, weights=given, minlength=len(found)).astype(np.int64)
        sizes = np.cumsum([0, *map(len, asked)])
        out = [(r["block"], r["shard"], _pack(total[place[a:b]]), None)
               for r, a, b in zip(rows, sizes, sizes[1:])]
        facts = [int(total.sum()), int((total > 0).sum()), *_of_counts(total)]
        yield _batch(_TOLD, [*out, (None, rows[0]["shard"], None, facts)])


def _summed(told: DataFrame) -> list[int]:
    rows = told.filter("block IS NULL").select(F.posexplode("facts")).groupBy("pos").agg(
        F.sum("col").alias("n")).collect()
    found = {r["pos"]: int(r["n"]) for r in rows}
    return [found.get(i, 0) for i in range(_CUT + 3)]


_ASK_PAIRS = ("block bigint, shard int, contexts binary, sizes binary, spread binary, keys binary, "
              "counts binary, singles binary")


def _word_counts(row: dict) -> np.ndarray:
    return np.concatenate([_unpack(t["counts"]) for t in
                           sorted(row["told"], key=lambda t: t["shard"])])


def _pair_plan(own: _Read, counts: np.ndarray, bits: int, share: float):
    """The block's pairs in the order in which the shards are asked."""
    context, word, place = own.pairs()
    start = context == len(own.words)
    heads = np.append(own.words, _START)
    spread = start | (np.append(counts, 0)[context] > share)
    shard = np.where(spread, _shard(words.mix(own.words[word]), bits), _shard(heads[context], bits))
    order = np.lexsort((word, context, shard))
    return context, word, place, heads, spread, shard, order


def _ask_pairs(bits: int, share: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, counts = _Read(row), _word_counts(row)
                context, word, place, heads, spread, shard, order = _pair_plan(
                    own, counts, bits, share)
                seen = np.bincount(place, weights=own.learned, minlength=len(context))
                keys = words.mix(heads[context] * _U(3) ^ own.words[word])
                out = []
                for s, a, b in _cuts(shard[order]):
                    at = order[a:b]
                    c = context[at]
                    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                    out.append((row["block"], s, heads[c[first]].tobytes(),
                                _pack(np.diff(np.append(first, len(c)))),
                                spread[at[first]].astype(np.uint8).tobytes(), keys[at].tobytes(),
                                _pack(seen[at]), _pack(counts[word[at]])))
                yield _batch(_ASK_PAIRS, out)
    return run


_TOLD_PAIRS = ("block bigint, shard int, counts binary, low binary, mass binary, bare binary, "
               "facts array<bigint>, context bigint, sums array<double>")


def _unseen(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Contexts of a question with a pair that training lacks: only these need alpha."""
    return np.logical_or.reduceat(counts == 0, np.cumsum(sizes) - sizes)


def _tell_pairs(single: Unigrams):
    """Training counts of every pair that a block asked for, and per context what alpha needs."""
    def run(batches):
        for rows in _grouped(batches, "shard"):
            keys = [np.frombuffer(r["keys"], _U) for r in rows]
            _, first, place = np.unique(np.concatenate(keys), return_index=True,
                                        return_inverse=True)
            total = np.bincount(place, weights=np.concatenate(
                [_unpack(r["counts"]) for r in rows]), minlength=len(first)).astype(np.int64)
            contexts = [np.frombuffer(r["contexts"], _U) for r in rows]
            every, of = np.unique(np.concatenate(contexts), return_inverse=True)
            owner = np.repeat(of, np.concatenate([_unpack(r["sizes"]) for r in rows]))[first]
            known = total > 0
            chance = single.probability(np.concatenate(
                [_unpack(r["singles"]) for r in rows])[first]) * known
            mass = np.bincount(owner, weights=chance, minlength=len(every))
            low = np.stack([np.bincount(owner[total == r], minlength=len(every))
                            for r in range(1, _CUT + 1)], axis=1)
            sizes = np.cumsum([0, *map(len, keys)])
            ends = np.cumsum([0, *map(len, contexts)])
            bare = (low.sum(1) == 0).astype(np.uint8)
            out = []
            for r, a, b, c, d in zip(rows, sizes, sizes[1:], ends, ends[1:]):
                counts, mine = total[place[a:b]], of[c:d]
                some = mine[_unseen(counts, _unpack(r["sizes"]))]
                out.append((r["block"], r["shard"], _pack(counts), _pack(low[some].ravel()),
                            mass[some].tobytes(), bare[mine].tobytes(), None, None, None))
            facts = [int(total.sum()), int(known.sum()), *_of_counts(total)]
            out.append((None, rows[0]["shard"], None, None, None, None, facts, None, None))
            wide = np.zeros(len(every), bool)
            wide[of] = np.concatenate([np.frombuffer(r["spread"], np.uint8) for r in rows]) > 0
            out += [(None, rows[0]["shard"], None, None, None, None, None, int(every[k].view(np.int64)),
                     [*map(float, low[k]), float(mass[k])]) for k in np.flatnonzero(wide)]
            yield _batch(_TOLD_PAIRS, out)
    return run


_SCORED = ("doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, base_score double, "
           "score double")


def _score(bits: int, share: float, total: int, kinds: int, texts: int, single: Unigrams,
           pair_d: np.ndarray, wide: dict[int, list[float]]):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, counts = _Read(row), _word_counts(row)
                context, word, place, heads, spread, shard, order = _pair_plan(
                    own, counts, bits, share)
                told = sorted(row["pairs"], key=lambda t: t["shard"])
                c = np.empty(len(context), np.int64)
                c[order] = np.concatenate([_unpack(t["counts"]) for t in told])
                # Contexts stand in the order of the question, the spread ones several times.
                low, mass = np.zeros((len(heads), _CUT)), np.zeros(len(heads))
                bare = np.zeros(len(heads), bool)
                for (_, a, b), t in zip(_cuts(shard[order]), told):
                    k = context[order[a:b]]
                    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                    some = _unseen(c[order[a:b]], np.diff(np.append(first, len(k))))
                    k = k[first]
                    bare[k] = np.frombuffer(t["bare"], np.uint8)
                    low[k[some]] = _unpack(t["low"]).reshape(-1, _CUT)
                    mass[k[some]] = np.frombuffer(t["mass"])
                for k in np.unique(context[spread]).tolist():
                    sums = wide[int(heads[k].view(np.int64))]
                    low[k], mass[k] = sums[:_CUT], sums[_CUT]
                    bare[k] = low[k].sum() == 0
                history = np.append(counts, texts)
                taken = low @ ((1 - pair_d[1:]) * np.arange(1, _CUT + 1))
                # Without low counts one more token is set aside.
                room = np.where(bare, 1, taken) / np.maximum(history + bare, 1)
                alpha = np.where(history > 0, room / np.maximum(1 - mass, 1e-300), 1.0)
                p1 = single.probability(counts)[word]
                rate = c * pair_d[np.minimum(c, _CUT + 1) % (_CUT + 1)]
                p2 = np.where(c > 0, rate / np.maximum(history + bare, 1)[context],
                              alpha[context] * p1)
                base = np.log10((counts + 1) / (total + kinds + 1))
                ends = np.cumsum(own.sizes)
                begins = ends - own.sizes
                out = [np.add.reduceat(x, begins) for x in (
                    (counts > 0)[own.tokens].astype(np.int64), base[own.tokens],
                    np.log10(p2)[place])]
                ids = pa.array(own.docs, pa.int64(), mask=own.known_id == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.learn == 1), pa.array(own.sizes), *map(pa.array, out)],
                    names=["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of every row.

    `learn` names the rows to train on. A null text is empty: its one token is the end. score is
    the log10 probability of the text and its end under the model; base_score that of the words
    taken singly with one added to every count; n_known counts tokens that training has. Repeated
    rows count as rows. With no training rows every word is unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(parts - 1, 0).bit_length()
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(learn, F.lit(False)).alias("learn"), text)
    # Bucketed by block, so that answers come to the blocks and blocks stay where they are.
    name = f"katz_blocks_{uuid.uuid4().hex}"
    (read.mapInArrow(_blocks(), _BLOCK).write.bucketBy(parts, "block").format("parquet")
     .option("compression", "zstd").option("path", f"{stage_folder(spark)}/{name}")
     .saveAsTable(name))
    blocks = spark.table(name)

    def per_shard(asked: DataFrame) -> DataFrame:
        return asked.repartition(parts, "shard").sortWithinPartitions("shard", "block")

    def answered(told: DataFrame, fields: list[str], as_: str) -> DataFrame:
        return (told.filter("block IS NOT NULL").groupBy("block")
                .agg(F.collect_list(F.struct("shard", *fields)).alias(as_)))

    told = staged(per_shard(blocks.mapInArrow(_ask_words(bits), _ASK)).mapInArrow(
        _tell_words, _TOLD))
    total, kinds, *of_counts = _summed(told)
    single = Unigrams(total, of_counts)
    texts = read.filter("learn").count()
    share = total / max(1 << bits, 1)
    counted = blocks.join(answered(told, ["counts"], "told"), "block")
    pairs = staged(per_shard(counted.mapInArrow(_ask_pairs(bits, share), _ASK_PAIRS)).mapInArrow(
        _tell_pairs(single), _TOLD_PAIRS))
    pair_d = discounts(_summed(pairs.filter("facts IS NOT NULL"))[2:])
    # Fewer contexts than there are shards pass a shard's share; and the start.
    wide = {r["context"]: r["sums"] for r in pairs.filter("context IS NOT NULL").groupBy("context")
            .agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(_CUT + 1)]).alias("sums"))
            .collect()}
    scored = counted.join(answered(pairs, ["counts", "low", "mass", "bare"], "pairs"), "block").mapInArrow(
        _score(bits, share, total, kinds, texts, single, pair_d, wide), _SCORED)
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
