"""Quality rules judged by host: failures are counted per host, and a rule binds where it fails often.

Every document is measured once. Two rules always bind (too few words; more than half of the words
in repeated three-word windows). The other rules are weak signs for a single document, so a host's
record decides: its failure rate of a rule is shrunk by a beta prior fitted to all hosts, and where
the shrunk rate passes the threshold, the host's documents that fail the rule are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repograph.llm import words
from repograph.llm.hot import join_counted
from repograph.stage import staged

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeats(hashes, offsets, rows) -> np.ndarray:
    """Words of each row that lie in a three-word window found twice or more in the row."""
    keys, starts, of = words.window_hashes(hashes, offsets, 3)
    _, inverse, counts = np.unique(words.in_row(keys, of), return_inverse=True, return_counts=True)
    again = starts[counts[inverse] > 1]
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(rows[covered[:len(rows)]], minlength=len(offsets) - 1)


def _lines(part: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word in each row, and those of them that equal an earlier line of the row."""
    data, offsets = part.data, part.offsets
    feeds = np.flatnonzero(data == 10)
    begins = np.concatenate([offsets[:-1], feeds + 1])
    rows = np.concatenate([np.arange(part.rows),
                           np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((begins, rows))
    begins, rows = begins[order], rows[order]
    ends = np.append(begins[1:], len(data))
    last = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last, offsets[1:][rows], ends - 1)
    worded = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, begins)
    begins, ends, rows = begins[worded], ends[worded], rows[worded]
    sums = words.prefix_sums(words._BYTE[data])
    _, first = np.unique(words.in_row(words.stretch_hashes(sums, begins, ends), rows),
                         return_index=True)
    lines = np.bincount(rows, minlength=part.rows)
    return lines, lines - np.bincount(rows[first], minlength=part.rows)


def _measured(texts: pa.Array) -> list[np.ndarray]:
    parts = [[np.zeros(0, np.int64)] for _ in _MEASURES]
    for part in words.slices(texts):
        rows = part.word_rows()
        points = part.per_row(part.inside & ((part.data & 0xC0) != 0x80))
        lines, dups = _lines(part)
        got = [np.diff(part.word_offsets), points, part.per_row(_SYMBOL[part.data]), lines, dups,
               _repeats(part.word_hashes(), part.word_offsets, rows)]
        for have, new in zip(parts, got):
            have.append(new.astype(np.int64))
    return [np.concatenate(p) for p in parts]


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in `keep` and the counts of every whole text; a null text counts as empty.

    n_words; word_chars: code points in words; n_symbols: characters of `#*$%&|<>`; n_lines:
    lines with a word; n_dup_lines: those that equal an earlier line; n_repeat_words: words in
    three-word windows that the text holds twice or more.
    """
    def run(batches):
        for batch in batches:
            counts = [pa.array(x, pa.int64()) for x in _measured(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *counts], names=[*keep, *_MEASURES])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in
                        docs.select(*keep).schema] + [f"{m} bigint" for m in _MEASURES])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


#: Rules that bind only on hosts that fail them often.
HOST_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
}
BASE_RULE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _priors(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Beta parameters per rule by the method of moments over all hosts, weighted by documents."""
    n = F.col("host_docs")
    rate = {r: F.col(f"f_{r}") / n for r in names}
    sums = [F.sum(n).alias("n"), F.count(F.lit(1)).alias("hosts")]
    for r in names:
        sums += [F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(n * rate[r] * rate[r]).alias(f"q_{r}")]
    row = hosts.agg(*sums).first()
    out = {}
    for r in names:
        if not row["n"]:
            out[r] = (0.5, 0.5)
            continue
        mean = min(max(row[f"f_{r}"] / row["n"], 1e-6), 1 - 1e-6)
        spread = row[f"q_{r}"] / row["n"] - (row[f"f_{r}"] / row["n"]) ** 2
        # Chance alone spreads the rates of hosts of this size by so much.
        between = max(spread - mean * (1 - mean) * row["hosts"] / row["n"], 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(measured: DataFrame, host: str = "source", threshold: float = 0.5) -> DataFrame:
    """Per host: its number of documents, and for every host rule whether it binds there."""
    failed = [F.sum(F.expr(rule).cast("bigint")).alias(f"f_{r}") for r, rule in HOST_RULES.items()]
    hosts = (measured.filter(F.col(host).isNotNull()).groupBy(host)
             .agg(F.count(F.lit(1)).alias("host_docs"), *failed))
    priors = _priors(hosts, list(HOST_RULES))
    rates = {r: (F.col(f"f_{r}") + a) / (F.col("host_docs") + a + b)
             for r, (a, b) in priors.items()}
    return hosts.select(host, "host_docs", *[(x > threshold).alias(f"binds_{r}")
                                             for r, x in rates.items()])


def apply_host_rules(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source",
                     threshold: float = 0.5) -> DataFrame:
    """Measures of every document, whether it fails a base rule, and whether it is kept.

    A null host has no record, so only the base rules bind there. Repeated rows are judged and
    counted as rows. An empty table gives an empty result. `keep` must hold the host column;
    other columns are not read.
    """
    measured = staged(measures(docs, keep, text))
    verdicts = staged(host_verdicts(measured, host, threshold))
    joined = join_counted(measured, verdicts, [host], "host_docs", measured.count())
    bound = F.lit(False)
    for r, rule in HOST_RULES.items():
        bound = bound | F.coalesce(F.col(f"binds_{r}") & F.expr(rule), F.lit(False))
    base = F.expr(BASE_RULE)
    return joined.select(*keep, *_MEASURES, base.alias("base_failed"),
                         (~base & ~bound).alias("kept"))
