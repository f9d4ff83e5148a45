"""Product codes of vectors: each part's nearest codebook entry, found by walking a trie.

A vector of integers is cut into `parts` equal consecutive parts; each position has a codebook. The
distinct parts of a position, sorted, are the leaves of a lexicographic trie: one level a dimension.
The walk goes depth first and carries the squared distances to all entries, summed over the
dimensions of the path, so parts with a common prefix share its sums. At a leaf the least sum names
the entry, and the leaf's vector counts there with its weight. A subtree of few leaves is walked
level by level, all its nodes at once; memory is one such block and one vector of sums per level.

Training reads a table of distinct parts and their weights, sorted and range-partitioned, so that
neighbours in the trie stand in one task. A round sends one row per entry and task, added up by
Spark; the codebooks (`parts` x `entries` rows) are broadcast. Codes of the vectors are then found
batch by batch, by a trie over the batch's distinct parts, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from repograph.llm.hot import join_counted
from repograph.stage import staged

#: Components whose integer is at least this far from 0 make a vector unfit: within it all
#: distances of vectors of up to 512 components are exact in 64 bits.
LIMIT = 1 << 26
_BLOCK = 256                # leaves of a subtree that is walked level by level
_SMALL = 1 << 31


def walk(rows: np.ndarray, codebook: np.ndarray, at_leaves) -> None:
    """Depth first over the trie of sorted distinct `rows`.

    Calls at_leaves(first, last, entries, distances) for consecutive stretches of rows.
    """
    n, width = rows.shape
    if not n:
        return
    reach = int(max(np.abs(rows).max(initial=0), np.abs(codebook).max(initial=0)))
    # Sums of 32 bits are exact while no distance can pass them, and twice as fast.
    kind = np.int32 if width * (2 * reach) ** 2 < _SMALL else np.int64
    rows, entries = rows.astype(kind), np.ascontiguousarray(codebook.T.astype(kind))

    def visit(lo: int, hi: int, depth: int, sums: np.ndarray) -> None:
        if hi - lo <= _BLOCK or depth == width:
            leaves(lo, hi, depth, sums)
            return
        column = rows[lo:hi, depth]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + 1 + lo
        begins = [lo, *cuts.tolist(), hi]
        k = 0
        while k < len(begins) - 1:
            a, b = begins[k], begins[k + 1]
            if b - a > _BLOCK:
                gap = entries[depth] - rows[a, depth]
                visit(a, b, depth + 1, sums + gap * gap)
                k += 1
                continue
            # Small children side by side are one block below the same node.
            while k < len(begins) - 1 and begins[k + 1] - a <= _BLOCK:
                k += 1
            leaves(a, begins[k], depth, sums)

    def leaves(lo: int, hi: int, depth: int, sums: np.ndarray) -> None:
        own = rows[lo:hi]
        parent, node_sums = np.zeros(hi - lo, np.intp), sums[None, :]
        new = np.zeros(hi - lo, bool)
        new[:1] = True
        for d in range(depth, width):
            new[1:] |= own[1:, d] != own[:-1, d]
            first = np.flatnonzero(new)
            gap = own[first, d, None] - entries[d]
            gap *= gap
            gap += node_sums[parent[first]]
            node_sums, parent = gap, np.cumsum(new) - 1
        best = node_sums.argmin(1)
        least = node_sums[np.arange(len(node_sums)), best]
        at_leaves(lo, hi, best[parent], least[parent].astype(np.int64))

    visit(0, n, 0, np.zeros(entries.shape[1], kind))


def nearest(rows: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and squared distance of each of the rows."""
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order[1:]] != keys[order[:-1]])[:len(keys)]
    distinct, where = rows[order[new]], np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    entries, distances = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)

    def at_leaves(lo, hi, own, least):
        entries[lo:hi], distances[lo:hi] = own, least

    walk(distinct, codebook, at_leaves)
    return entries[where], distances[where]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows as byte strings that sort like them: big-endian, the sign turned."""
    flat = np.ascontiguousarray((rows.astype(np.int64) + (1 << 31)).astype(">u4"))
    return flat.view(f"S{4 * rows.shape[1]}").ravel()


def _rows(body: bytes, width: int) -> np.ndarray:
    """The rows of such byte strings, one behind the other."""
    return (np.frombuffer(body, ">u4").astype(np.int64) - (1 << 31)).reshape(-1, width)


def _integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are fit, and their floor(scale * x)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)     # null becomes nan
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * scale)
        bad = ~(np.abs(flat) < LIMIT)
    ends = np.cumsum(size)
    sums = np.concatenate([[0], np.cumsum(bad)])
    fit = (sums[ends] == sums[ends - size]) & (size > 0)
    flat = np.where(bad, 0, flat).astype(np.int64)
    return fit, [flat[e - n:e] for e, n in zip(ends[fit].tolist(), size[fit].tolist())]


def _matrix(scale: int, width: int | None):
    """From (row, vector) to (row, n, ints): the fit vectors' integers as `_keys` spells them."""
    def run(batches):
        for batch in batches:
            fit, own = _integers(batch.column(1), scale)
            if width is not None:
                right = np.array([len(v) == width for v in own], bool)
                fit[np.flatnonzero(fit)] = right
                own = [v for v, r in zip(own, right.tolist()) if r]
            spelled = [(v + (1 << 31)).astype(">u4").tobytes() for v in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fit)), pa.array([len(v) for v in own], pa.int32()),
                 pa.array(spelled, pa.binary())], names=["row", "n", "ints"])
    return run


def _bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Equal consecutive parts; where they can't be equal the first ones are longer by one."""
    edges = np.cumsum([0] + [len(p) for p in np.array_split(np.arange(width), parts)]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _part_rows(bounds: list[tuple[int, int]]):
    """From ints to (position, part, weight): distinct parts of each batch."""
    def run(batches):
        for batch in batches:
            own = _rows(b"".join(batch.column(0).to_pylist()), bounds[-1][1])
            for position, (a, b) in enumerate(bounds):
                if a == b or not len(own):
                    continue
                keys, counts = np.unique(_keys(own[:, a:b]), return_counts=True)
                spelled, n = keys.tobytes(), 4 * (b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), position, np.int32)),
                     pa.array([spelled[k:k + n] for k in range(0, len(spelled), n)], pa.binary()),
                     pa.array(counts, pa.int64())], names=["position", "part", "weight"])
    return run


def _round(codebooks, bounds: list[tuple[int, int]]):
    """From sorted (position, part, weight) to (position, entry, weight, sums) of a task."""
    def run(batches):
        books = codebooks.value
        totals = {}
        for batch in batches:
            position = batch.column(0).to_numpy()
            weight = batch.column(2).to_numpy()
            for p in np.unique(position).tolist():
                at = np.flatnonzero(position == p)
                a, b = bounds[p]
                rows = _rows(b"".join(batch.column(1).take(pa.array(at)).to_pylist()), b - a)
                if p not in totals:
                    # Exact however many rows there are: Python integers take what a batch adds.
                    totals[p] = np.zeros((len(books[p]), b - a + 1), object)
                own = np.zeros((len(books[p]), b - a + 1), np.int64)

                def at_leaves(lo, hi, entries, _):
                    w = weight[at[lo:hi], None]
                    np.add.at(own, entries, np.concatenate([w, rows[lo:hi] * w], 1))

                walk(rows, books[p], at_leaves)
                totals[p] += own
        out = [(p, e, *map(str, total[e].tolist())) for p, total in totals.items()
               for e in range(len(total)) if total[e][0]]
        widest = max(b - a for a, b in bounds)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
             pa.array([r[2] for r in out], pa.string()),
             *[pa.array([r[3 + k] if len(r) > 3 + k else None for r in out], pa.string())
               for k in range(widest)]],
            names=["position", "entry", "weight", *[f"s{k}" for k in range(widest)]])
    return run


def _coded(codebooks, bounds: list[tuple[int, int]]):
    """From (row, ints) to (row, codes, error)."""
    def run(batches):
        books = codebooks.value
        for batch in batches:
            own = _rows(b"".join(batch.column(1).to_pylist()), bounds[-1][1])
            codes = np.zeros((len(own), len(bounds)), np.uint16)
            error = np.zeros(len(own), np.int64)
            for p, (a, b) in enumerate(bounds):
                if a < b and len(own):
                    entries, least = nearest(own[:, a:b], books[p])
                    codes[:, p], error = entries, error + least
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(
                    pa.array(codes.ravel().astype(np.int32)), len(bounds)).cast(pa.list_(pa.int32())),
                 pa.array(error)], names=["row", "codes", "error"])
    return run


def fit_vectors(vectors: DataFrame, vector: str, keep: list[str], scale: int = 1024,
                width: int | None = None) -> DataFrame:
    """row (a struct of the columns in `keep`), n and ints of the vectors that take part.

    Left out: null and empty vectors, those that hold a null, a non-finite component or one whose
    integer is beyond `LIMIT`, and with `width` those of another length.
    """
    rows = vectors.select(F.struct(*keep).alias("row"), F.col(vector).alias("vector"))
    schema = StructType([rows.schema["row"], StructField("n", IntegerType()),
                         StructField("ints", BinaryType())])
    return rows.mapInArrow(_matrix(scale, width), schema)


def train(fit: DataFrame, first: list[bytes], parts: int, rounds: int) -> list[np.ndarray]:
    """Codebooks of the vectors in `fit.ints`, starting from the vectors `first`."""
    spark = fit.sparkSession
    seeds = np.concatenate([_rows(v, len(v) // 4) for v in first])
    bounds = _bounds(seeds.shape[1], parts)
    books = [seeds[:, a:b].copy() for a, b in bounds]
    widest = max(b - a for a, b in bounds)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    distinct = staged(fit.select("ints").mapInArrow(
        _part_rows(bounds), "position int, part binary, weight bigint")
        .groupBy("position", "part").agg(F.sum("weight").alias("weight"))
        .repartitionByRange(tasks, "position", "part").sortWithinPartitions("position", "part"))
    sums = [f"s{k}" for k in range(widest)]
    schema = "position int, entry int, weight string" + "".join(f", {s} string" for s in sums)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        got = distinct.mapInArrow(_round(sent, bounds), schema).groupBy("position", "entry").agg(
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("weight", *sums)])
        for r in got.collect():
            own = books[r["position"]]
            own[r["entry"]] = [int(r[s]) // int(r["weight"]) for s in sums[:own.shape[1]]]
    return books


def compress(vectors: DataFrame, vector: str, key: str, label: str, parts: int = 4,
             entries: int = 256, rounds: int = 4, scale: int = 1024
             ) -> tuple[DataFrame, list[np.ndarray]]:
    """row, codes, error, label_error of every vector that takes part, and the codebooks.

    row: struct of `key` and `label`; codes: index of the nearest entry at every position; error:
    squared distances summed over positions; label_error: the errors of all rows with the label,
    null labels together.

    Codebooks start with the vectors of the `entries` least keys (equal keys: the lexicographically
    lesser vector, null keys last) and follow `rounds` of assignment (ties to the lower index) and
    floored means; an entry without parts stays. With fewer vectors there are fewer entries.
    All vectors have the length of the first of these; others are left out, as are those that
    `fit_vectors` names. A length that `parts` doesn't divide gives the first parts one component
    more. Repeated rows count as rows. No fit vector gives an empty result and no codebooks.
    """
    first: list = []
    fit = fit_vectors(vectors, vector, [key, label], scale)
    while not first or any(r["n"] != first[0]["n"] for r in first):
        # Asked again only if lengths differ, then with the first one's length.
        first = fit.orderBy(F.col(f"row.`{key}`").asc_nulls_last(), "ints").limit(entries).select(
            "n", "ints").collect()
        if not first:
            break
        fit = fit_vectors(vectors, vector, [key, label], scale, first[0]["n"])
    books = train(fit, [bytes(r["ints"]) for r in first], parts, rounds) if first else []
    width = first[0]["n"] if first else 0
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    schema = StructType([fit.schema["row"], StructField("codes", ArrayType(IntegerType())),
                         StructField("error", LongType())])
    label_of = F.col(f"row.`{label}`")
    coded = staged(fit.select("row", "ints").mapInArrow(_coded(sent, _bounds(width, parts)), schema)
                   .withColumns({"no_label": label_of.isNull(),
                                 "label_text": F.coalesce(label_of.cast("string"), F.lit(""))}))
    sums = staged(coded.groupBy("no_label", "label_text").agg(
        F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("holders")))
    joined = join_counted(coded, sums, ["no_label", "label_text"], "holders", max(coded.count(), 1000))
    return joined.select("row", "codes", "error", "label_error"), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All components in decimal, by position, entry and place within the part, comma-joined."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())
