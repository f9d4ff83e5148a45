"""Exact top-k by integer inner product, over vectors keyed by nearest pivot and distance.

Components become floor(scale * x). With M the largest squared norm, every vector v gets one more
component sqrt(M - |v|^2) and every query a zero; then |q - v|^2 = |q|^2 + M - 2 q.v, so the largest
inner products are the smallest distances. A vector is keyed by its nearest pivot and its distance
to it; sorted by these keys, consecutive vectors of one pivot form blocks: annuli of a bounded
number of rows. For a query at distance d from the pivot, all vectors of the annulus [lo, hi] are at
least max(lo - d, d - hi) away (triangle inequality), which bounds their inner product from above.

A query first searches the annuli around its own distance to its nearest pivot; that gives its
k-th best score so far. Consecutive annuli of a pivot make up rings, each held by one task; blocks
of queries go only to the rings whose bound reaches their scores. There only annuli whose bound
reaches a query's score are multiplied, nearest first, and the score to beat rises on the way.
Bounds carry slack for rounding, so nothing is lost.

Vectors and queries meet by shuffles alone. What is broadcast is one row a ring; the driver gets
the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from repograph.stage import staged

_SLACK = 1e-6


def integer_vectors(rows: DataFrame, is_query: Column, key: str, vector: str,
                    scale: float) -> DataFrame:
    """id, v (array of bigint) and asks; rows without id or with a null or non-finite component go."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (rows.select(F.col(key).cast("bigint").alias("id"),
                        F.col(vector).cast("array<double>").alias("v"),
                        F.coalesce(is_query, F.lit(False)).alias("asks"))
            .filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite)
            .withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x))))


def _norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _pivots(vectors: DataFrame, count: int, width: int, largest: float, pivots: int,
            sample: int) -> np.ndarray:
    """Sampled rows (smallest hashes), chosen so that each next one is far from those before.

    The choice is made in one task over at most `sample` rows; the driver gets what it chose.
    """
    def choose(batches):
        rows = [_matrix(b.column(0), width) for b in batches if b.num_rows]
        if not rows:
            return
        rows = np.concatenate(rows)
        at = _padded(rows, largest)
        chosen = [0]
        away = ((at - at[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(at)):
            best = int(np.argmax(away))
            if away[best] <= 0:
                break
            chosen.append(best)
            away = np.minimum(away, ((at - at[best]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(list(rows[chosen]), pa.list_(pa.int64()))],
                                         names=["v"])

    hashed = vectors.select("v", F.xxhash64("id", "v").alias("hash"))
    # Hashes up to here belong to about four times as many rows as are needed.
    upto = -2 ** 63 + 2 ** 64 * 4 * sample // max(count, 1)
    few = hashed.filter(F.col("hash") <= upto) if upto < 2 ** 63 else hashed
    for some in (few, hashed):  # the second where rows repeat so often that no hash is small
        found = (some.orderBy("hash").limit(sample).select("v")
                 .mapInArrow(choose, "v array<bigint>").collect())
        if found:
            break
    return _padded(np.array([r[0] for r in found], np.int64), largest)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a column of lists, shorter ones padded with zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _padded(rows: np.ndarray, largest: float) -> np.ndarray:
    m = rows.astype(np.float64)
    return np.hstack([m, np.sqrt(np.maximum(largest - (m * m).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _to_pivots(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    f = queries.astype(np.float64)
    return _distances(np.hstack([f, np.zeros((len(f), 1))]), centres)


def _stored(top: int) -> type:
    """The smallest type for components from -1 - top to top."""
    return next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)


def _top(rows: np.ndarray) -> int:
    return max(int(rows.max(initial=0)), -int(rows.min(initial=0)))


def _exact(width: int, most: int) -> type:
    """A type for exact sums of `width` products of at most `most`; floating point where it can be."""
    most *= width
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 52 else np.int64


_BLOCK = pa.schema([
    ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()),
    ("norm", pa.float64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
    ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64()))])
_BLOCK_SQL = ("pivot int, lo double, hi double, n int, norm double, ids array<bigint>, "
              "vectors binary, near array<double>, far array<double>")


def _blocks(vectors: DataFrame, centres: np.ndarray, largest: float, size: int, queries: bool,
            stored: type) -> DataFrame:
    """Annuli: at most `size` consecutive rows of one pivot, ordered by distance, as one row.

    pivot and lo..hi: the nearest pivot and the distances to it; n: the rows; norm: the largest
    squared norm. Of queries also near and far: the least and greatest distance to every pivot.
    """
    width = centres.shape[1] - 1

    def key(batches):
        for batch in batches:
            v = _matrix(batch.column(1), width)
            d = _to_pivots(v, centres) if queries else _distances(_padded(v, largest), centres)
            home = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in v.astype(stored)], pa.binary()),
                 pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home])],
                names=["id", "v", "pivot", "distance"])

    def cut(batches):
        for batch in batches:
            pivot, own = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ids = batch.column(0).to_numpy()
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), stored).reshape(-1, width)
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            rows = []
            for a, b in ((x, min(x + size, to)) for at, to in zip(edges, edges[1:])
                         for x in range(at, to, size)):
                d = _to_pivots(v[a:b], centres) if queries else np.zeros((1, 0))
                norm = (v[a:b].astype(np.float64) ** 2).sum(1).max()
                rows.append((pivot[a], own[a], own[b - 1], b - a, norm, ids[a:b], v[a:b].tobytes(),
                             d.min(0), d.max(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOCK)],
                schema=_BLOCK)

    order = ["pivot", "distance", "id"]
    keyed = vectors.select("id", "v").mapInArrow(
        key, "id bigint, v binary, pivot int, distance double")
    return (keyed.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(cut, _BLOCK_SQL))


_FOUND = "query_id bigint, query_block bigint, vec_id bigint, score bigint"
_LOWEST = np.iinfo(np.int64).min


def _reachable(norm, largest: float, away):
    """Upper bound of the inner products of vectors at least `away` from a query, with slack."""
    bound = (norm + largest - np.maximum(away * (1 - _SLACK) - _SLACK, 0) ** 2) / 2
    return bound + np.abs(bound) * _SLACK + 1


def _with_hits(best: np.ndarray, owner: np.ndarray, row: np.ndarray, score: np.ndarray,
               ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best and owner (k scores a row and their ids) with hits of some rows; equal ones by smaller id."""
    n, k = best.shape
    rows = np.concatenate([np.repeat(np.arange(n), k), row])
    scores = np.concatenate([best.ravel(), score])
    owners = np.concatenate([owner.ravel(), ids])
    order = np.lexsort((owners, ~scores, rows))
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    kept = order[place < k]
    return scores[kept].reshape(n, k), owners[kept].reshape(n, k)


def _searcher(k: int, centres: np.ndarray, largest: float, stored: type):
    """Runs over the annuli of a ring, then the query blocks that meet it."""
    width = centres.shape[1] - 1

    def search(ids, q, floor, annuli):
        d, top = _to_pivots(q, centres), _top(q)
        pivot, lo, hi = (np.array([a[i] for a in annuli]) for i in range(3))
        away = np.maximum(np.maximum(lo - d[:, pivot], d[:, pivot] - hi), 0)
        bound = _reachable((q.astype(np.float64) ** 2).sum(1)[:, None], largest, away)
        best, owner = np.full((len(ids), k), _LOWEST, np.int64), np.zeros((len(ids), k), np.int64)
        for a in np.argsort(away.min(0), kind="stable"):
            live = np.flatnonzero(bound[:, a] >= floor)
            if not len(live):
                continue
            others, rows_top, rows = annuli[a][3:]
            exact = _exact(width, top * rows_top)
            scores = q[live].astype(exact) @ rows.astype(exact, copy=False).T
            least = floor[live].astype(np.result_type(scores, np.float32))
            r, c = np.divmod(np.flatnonzero(scores >= least[:, None]), len(others))
            own = ids[live[r]] == others[c]
            r, c = r[~own], c[~own]
            if not len(r):
                continue
            best[live], owner[live] = _with_hits(best[live], owner[live], r,
                                                 scores[r, c].astype(np.int64), others[c])
            # What has been seen raises the score to beat.
            kth = best[:, -1]
            floor = np.maximum(floor, np.where(kth > _LOWEST, kth.astype(np.float64), -np.inf))
        return best, owner

    def run(batches):
        ring, annuli = None, []
        for batch in batches:
            rings, numbers, pivot, lo, hi = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if rings[i] != ring:
                    ring, annuli = rings[i], []
                ids = np.array(batch.column(5)[i].values)
                v = np.frombuffer(batch.column(6)[i].as_buffer(), stored).reshape(-1, width)
                if pivot[i] is not None:
                    top = _top(v)
                    annuli.append((pivot[i], lo[i], hi[i], ids, top,
                                   v.astype(_exact(width, top * top))))
                    continue
                if not annuli:
                    continue
                best, owner = search(ids, v, np.array(batch.column(7)[i].values), annuli)
                r, c = np.nonzero(best > _LOWEST)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r]), pa.array(np.full(len(r), numbers[i], np.int64)),
                     pa.array(owner[r, c]), pa.array(best[r, c])],
                    names=["query_id", "query_block", "vec_id", "score"])
    return run


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _met(annuli: DataFrame, asking: DataFrame, search) -> DataFrame:
    """The best of each `ring`: its annuli come to one task and are held, then its query blocks."""
    null = lambda kind: F.lit(None).cast(kind)
    held = annuli.select("ring", F.col("block").alias("number"), "pivot", "lo", "hi", "ids",
                         "vectors", null("array<double>").alias("floors"))
    asked = asking.select("ring", F.col("query_block").alias("number"), null("int").alias("pivot"),
                          null("double").alias("lo"), null("double").alias("hi"), "ids", "vectors",
                          "floors")
    return (held.unionByName(asked).repartition(_tasks(annuli.sparkSession), "ring")
            .sortWithinPartitions("ring", F.col("pivot").isNull(), "number")
            .mapInArrow(search, _FOUND))


def _rings(index: DataFrame, held: int) -> DataFrame:
    """Consecutive annuli of one pivot, of about `held` rows: pivot, ring, lo, hi and both ends.

    Few rows: one for each `held` vectors and at most one more for each pivot.
    """
    before = Window.partitionBy("pivot").orderBy("lo", "block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at = F.struct("lo", "block")
    return staged(
        index.select("pivot", "lo", "hi", "block", "n")
        .withColumn("nth", F.sum("n").over(before) - 1)
        .groupBy("pivot", F.floor(F.col("nth") / held).alias("nth"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(at).alias("first"),
             F.max(at).alias("last"))
        .withColumn("ring", F.col("pivot") * F.lit(2 ** 32) + F.col("nth")))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id",
          vector: str = "embedding", scale: float = 256.0, pivots: int = 32, sample: int = 4096,
          block: int = 1024, query_block: int = 256, held: int = 2 ** 23) -> DataFrame:
    """The k highest scores of every query against all other rows: query_id, rank, vec_id, score.

    Rows without id, with a null vector or with a null or non-finite component take no part. A
    shorter vector counts as padded with zeros. A row with the query's own id is not its candidate;
    of several query rows with one id the smallest vector asks; repeated candidate rows each count.
    Equal scores go to the smaller id. Fewer than k candidates give fewer rows; an empty table
    gives none. Other columns are not read. Scores must fit a long.

    The pivots are chosen among the `sample` rows with the smallest hashes; every row is indexed.
    Queries are a stated set, matched with all rows in blocks. A task holds about `held` components
    of vectors at once, fewer where there are few queries; a query gets at most k rows from each
    such ring; there is at least one for each pivot.
    """
    spark = rows.sparkSession
    vectors = staged(integer_vectors(rows, is_query, key, vector, scale))
    facts = vectors.agg(
        F.max(F.size("v")).alias("w"), F.max(_norm(F.col("v"))).alias("m"),
        F.count("*").alias("n"), F.count_if("asks").alias("asks"),
        F.max(F.greatest(F.array_max("v"), -1 - F.array_min("v"))).alias("top")).first()
    if facts["w"] is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, largest = max(facts["w"], 1), facts["m"]
    centres = _pivots(vectors, facts["n"], width, largest, pivots, sample)
    stored = _stored(facts["top"] or 0)
    search = _searcher(k, centres, largest, stored)

    index = staged(_blocks(vectors, centres, largest, block, False, stored)
                   .select("pivot", "lo", "hi", "n", "ids", "vectors")
                   .withColumn("block", F.monotonically_increasing_id()))
    asked = vectors.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    batches = staged(_blocks(asked, centres, largest, query_block, True, stored).select(
        F.xxhash64("ids").alias("query_block"), F.col("pivot").alias("home"),
        F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), "ids", "vectors",
        F.col("norm").alias("q_norm"), "near", "far"))

    # First the two annuli of the home pivot nearest to the queries' own distances.
    gap = F.greatest(F.col("lo") - F.col("q_hi"), F.col("q_lo") - F.col("hi"), F.lit(0.0))
    nearest = Window.partitionBy("query_block").orderBy("gap", "lo", "block")
    first = (batches.select("query_block", "home", "q_lo", "q_hi")
             .join(index.select(F.col("pivot").alias("home"), "lo", "hi", "block"), "home")
             .withColumn("gap", gap).withColumn("n", F.row_number().over(nearest))
             .filter("n <= 2").select("query_block", F.col("block").alias("ring")))
    unknown = F.transform("ids", lambda _: F.lit(float("-inf")))
    # Tables with vectors are never broadcast: how small they look on disk says little.
    seeds = _met(index.withColumn("ring", F.col("block")).hint("merge")
                 .join(first.select("ring").distinct(), "ring", "left_semi"),
                 batches.hint("merge").join(first, "query_block").withColumn("floors", unknown),
                 search)
    floors = (_ranked(seeds, k).filter(F.col("rank") == k).groupBy("query_block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", F.col("score").cast("double"))))
        .alias("by_id")))
    floored = batches.hint("merge").join(floors, "query_block", "left").withColumn(
        "floors", F.transform("ids", lambda i: F.coalesce(
            F.try_element_at("by_id", i), F.lit(float("-inf"))))).drop("by_id")

    # Then every annulus that may still hold one of the k best.
    rings = _rings(index, max(block, min(held // width, max(16 * block, facts["asks"] // 2))))
    away = F.greatest(F.col("lo") - F.get("far", F.col("pivot")),
                      F.get("near", F.col("pivot")) - F.col("hi"), F.lit(0.0))
    reach = F.greatest(away * (1 - _SLACK) - _SLACK, F.lit(0.0))
    bound = (F.col("q_norm") + F.lit(largest) - reach * reach) / 2
    asking = (floored.repartition(_tasks(spark), "query_block")
              .join(F.broadcast(rings.select("pivot", "ring", "lo", "hi")),
                    bound + F.abs(bound) * _SLACK + 1 >= F.array_min("floors")))
    within = F.struct("lo", "block").between(F.col("first"), F.col("last"))
    placed = (index.join(F.broadcast(rings.select("pivot", "ring", "first", "last")), "pivot")
              .filter(within))
    found = _met(placed, asking, search)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                                    "score")
