"""Toxicity scores: boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: words, and beginnings of words of four to eight bytes, that toxic training
texts hold far more often than others. Inflected and compound forms so share an entry. Words are
compared in lower case with look-alike characters replaced. The trees and the calibration are
fitted on a sample of labelled rows of at most `per_class` rows of either class, picked by a hash
of doc_id; scores are computed for every row where it is read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from repograph.llm import held, words
from repograph.stage import staged

#: Look-alike characters and the letters they stand for.
_LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Second-person words of the languages in use.
_SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton
 ta tes vous votre vos tú ti tuyo usted ustedes vosotros""".split()
_PREFIXES = (4, 5, 6, 7, 8)
_NEAR = 5
_FEATURES = ["lexicon_density", "lexicon_hits", "lexicon_weight", "lexicon_kinds", "near_second",
             "second_density", "capitals", "shouted", "exclaimed", "punctuation", "obfuscated",
             "stretched", "words"]

_PLAIN = words.LOWER.copy()
for _from, _to in _LOOK_ALIKES.items():
    _PLAIN[ord(_from)] = ord(_to)
_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 65:91] = True                                     # capitals
_CLASS[1, 97:123] = _CLASS[1, 65:91] = _CLASS[1, 128:] = True   # letters
_CLASS[2, [ord("!"), ord("?")]] = True
_CLASS[3, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
_CLASS[4, [ord(c) for c in _LOOK_ALIKES] + [ord("*"), ord("#")]] = True


def _seconds() -> np.ndarray:
    part = next(words.slices(pa.array([" ".join(_SECOND_PERSON)])))
    return np.sort(part.word_hashes())


def _contains(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


class _Words:
    """The words of a slice without punctuation at their ends, hashed whole and by beginnings."""

    def __init__(self, part: words.Slice):
        data = part.data
        core = _CLASS[1][_PLAIN[data]]
        # First and last letter of each word; words without a letter stay as they are.
        at = np.flatnonzero(core)
        first = np.searchsorted(at, part.starts)
        last = np.searchsorted(at, part.ends) - 1
        some = last >= first
        self.starts, self.ends = part.starts.copy(), part.ends.copy()
        if len(at):
            self.starts[some] = at[first[some]]
            self.ends[some] = at[last[some]] + 1
        self.sums = words.prefix_sums(words._BYTE[_PLAIN[data]])

    def keys(self):
        """The whole words, then each length of beginnings with the words that have one."""
        everything = np.arange(len(self.starts))
        yield everything, words.stretch_hashes(self.sums, self.starts, self.ends)
        for n in _PREFIXES:
            long = np.flatnonzero(self.ends - self.starts > n)
            starts = self.starts[long]
            yield long, words.stretch_hashes(self.sums, starts, starts + n) ^ np.uint64(n)


def _lexicon(sample: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and weights of at most `size` words and beginnings that speak for toxicity."""
    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy().astype(bool)
            for part in words.slices(batch.column(0)):
                rows = part.word_rows()
                keys, of = [np.concatenate(x) for x in zip(*(
                    (k, rows[i]) for i, k in _Words(part).keys()))]
                _, once = np.unique(words.in_row(keys, of), return_index=True)
                keys, label = keys[once], toxic[part.first + of[once]]
                found, inverse = np.unique(keys, return_inverse=True)
                pos = np.bincount(inverse, weights=label, minlength=len(found))
                both = np.bincount(inverse, minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(pos.astype(np.int64)),
                     pa.array(both - pos.astype(np.int64))], names=["key", "pos", "neg"])

    totals = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    odds = (F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = (sample.select("text", "toxic")
            .mapInArrow(run, "key bigint, pos bigint, neg bigint")
            .groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter("pos >= 3").withColumn("odds", odds).filter(F.col("odds") > math.log(6))
            .withColumn("z", F.col("odds") / error).filter("z > 2")
            .orderBy(F.desc("z"), "key").limit(size).collect())
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in best])[order]


def _features(texts: pa.Array, lexicon: tuple[np.ndarray, np.ndarray],
              seconds: np.ndarray) -> np.ndarray:
    out = [np.zeros((0, len(_FEATURES)))]
    keys, weights = lexicon
    for part in words.slices(texts):
        rows, n = part.word_rows(), np.diff(part.word_offsets)
        count = lambda flags: np.bincount(rows[flags], minlength=part.rows)
        own = _Words(part)
        weight, whole = np.zeros(len(rows)), None
        for i, k in own.keys():
            whole = k if whole is None else whole
            hit, at = _contains(keys, k)
            weight[i[hit]] = np.maximum(weight[i[hit]], weights[at[hit]])
        hits = weight > 0
        kind_rows, kind = rows[hits], words.in_row(whole[hits], rows[hits])
        _, once = np.unique(kind, return_index=True)
        second, _ = _contains(seconds, whole)
        near = np.zeros(len(rows), bool)
        spots = np.flatnonzero(second)
        for k in range(-_NEAR, _NEAR + 1):
            to = spots + k
            ok = (to >= 0) & (to < len(rows))
            near[to[ok]] |= rows[to[ok]] == rows[spots[ok]]
        data = part.data
        chars = np.maximum(np.diff(part.offsets), 1)
        of_class = [part.per_row(c[data]) for c in _CLASS]
        sums = [np.concatenate([[0], np.cumsum(c[data])]) for c in (_CLASS[0], _CLASS[1], _CLASS[4])]
        caps, letters, odd = (s[part.ends] - s[part.starts] for s in sums)
        stretched = part.per_row(np.concatenate([
            np.zeros(min(2, len(data)), bool), (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
            & _CLASS[1][data[2:]]]))
        total = np.maximum(n, 1)
        hit_count = count(hits)
        out.append(np.column_stack([
            hit_count / total, np.log1p(hit_count),
            np.bincount(rows, weights=weight, minlength=part.rows) / total,
            np.bincount(kind_rows[once], minlength=part.rows),
            count(hits & near) / np.maximum(hit_count, 1), count(second) / total,
            of_class[0] / np.maximum(of_class[1], 1), count((caps > 2) & (caps == letters)) / total,
            of_class[2] / total, of_class[3] / chars, count((odd > 0) & (letters > 0)) / total,
            stretched / chars, np.log1p(n)]))
    return np.concatenate(out)


def _with_features(docs: DataFrame, keep: list[str], text: str, lexicon, seconds) -> DataFrame:
    def run(batches):
        held.tables("toxicity")
        for batch in batches:
            found = _features(batch.column(len(keep)), lexicon, seconds)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(_FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], flat.cast(pa.list_(pa.float64()))],
                names=[*keep, "features"])

    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
                       + ["features array<double>"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema).withColumn(
        "features", array_to_vector("features"))


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, text: str, label: str,
            per_class: int) -> DataFrame:
    """Labelled training rows: doc_id, text, toxic, weight (labelled rows per sampled row)."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic")).filter(learn))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {c: min(1.0, per_class / n) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(
        ((F.col("toxic") == 1) & (draw < share.get(1, 0.0)))
        | ((F.col("toxic") == 0) & (draw < share.get(0, 0.0))))
    weight = F.when(F.col("toxic") == 1, 1 / share.get(1, 1.0)).otherwise(1 / share.get(0, 1.0))
    # Rows are drawn singly, so their number stays within a few hundredths of 2 * per_class.
    chosen = F.broadcast(picked.withColumn("weight", weight))
    return (docs.select("doc_id", F.col(text).alias("text")).filter("text IS NOT NULL")
            .join(chosen, "doc_id").groupBy(F.xxhash64("text").alias("h"), "toxic")
            .agg(F.any_value("text").alias("text"), F.min("doc_id").alias("doc_id"),
                 F.sum("weight").alias("weight")).drop("h"))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], learn: Column,
                   text: str = "text", label: str = "toxic", per_class: int = 10_000,
                   lexicon_size: int = 2048) -> DataFrame:
    """The columns in `keep` and a score from 0 to 1 for every row: the probability of the label.

    `learn` is a condition on doc_id that names the rows whose labels may be used. Labels other
    than 0 and 1 are ignored; of several labels of a document the larger counts; copies of a text
    in the sample count as one with their summed weight. Null texts score as empty ones. Repeated
    rows are scored as often as they stand there. With labels of one class only every score is
    that class's; without labels every score is 0. Other columns are not read.

    Isotonic steps leave ties; a thousandth of the trees' own probability orders within them.
    """
    sample = staged(_sample(docs, labels, learn, text, label, per_class))
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if min(seen.get(0, 0), seen.get(1, 0)) < 2:
        only = 1.0 if seen.get(1, 0) and not seen.get(0, 0) else 0.0
        return docs.select(*keep, F.lit(only).alias("score"))
    lexicon, seconds = _lexicon(sample, lexicon_size), _seconds()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    train = staged(_with_features(
        sample.repartition(min(parts, 12)), ["toxic", "weight", "doc_id"], "text", lexicon, seconds)
        .withColumn("label", F.col("toxic").cast("double")).withColumn("calibrates", fold))
    train = train.coalesce(4)
    fit = train.filter("NOT calibrates")
    classes = {r[0] for r in fit.select("label").distinct().collect()}
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="class_",
                          maxIter=15, maxDepth=3, stepSize=0.3, maxBins=32, seed=7).fit(
        fit if len(classes) == 2 else train)
    raw = vector_to_array("probability")[1]
    held = trees.transform(train).withColumn("raw", raw)
    inner = held.filter("calibrates")
    if len({r[0] for r in inner.select("label").distinct().collect()}) < 2:
        inner = held
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight",
                               predictionCol="steps_").fit(inner)
    scored = trees.transform(_with_features(docs, keep, text, lexicon, seconds)).withColumn(
        "raw", raw)
    blended = 0.999 * F.greatest(F.least(F.col("steps_"), F.lit(1.0)), F.lit(0.0)) \
        + 0.001 * F.col("raw")
    return steps.transform(scored.select(*keep, "raw")).select(*keep, blended.alias("score"))
