"""Language of whole texts by cross parsing against labelled text of each language.

A text is cut into phrases, each the longest stretch, from where the last one ended, that occurs in
a language's sample text. A suffix automaton of the sample finds it: the state follows the text
letter by letter, and where it has no way on, a phrase ends and the next begins with that letter.
A phrase costs log2 of the sample's length, the price of pointing to it; the language with the
lowest cost wins.

The samples are bounded: `per_language` characters of each language, from the labelled documents
with the smallest hashes. The automata are tables (state, letter) -> state; all texts of a batch
walk through them side by side, one letter per step.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from repograph.llm import held, words

_STRETCH = 1024              # letters per lane; a phrase ends where a stretch ends
_MOST_LETTERS = 96
_NONE, _SPACE, _OTHER = 0, 1, 2


class Alphabet:
    """Lower-case letters as small numbers; other characters are spaces, rare letters one number."""

    def __init__(self, samples: list[str]):
        counts: dict[str, int] = {}
        for text in samples:
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        common = sorted(counts, key=lambda c: (-counts[c], c))[:_MOST_LETTERS]
        self.size = 3 + len(common)
        number = {c: 3 + k for k, c in enumerate(sorted(common))}
        table = np.full(0x110000, _SPACE, np.uint8)
        for point in range(0x110000):
            if point < 128 and not chr(point).isalpha():
                continue
            if 0xD800 <= point < 0xE000 or unicodedata.category(chr(point))[0] != "L":
                continue
            table[point] = number.get(chr(point).lower(), _OTHER)
        self.table = table

    def codes(self, text: np.ndarray) -> np.ndarray:
        return self.table[text]

    def of(self, text: str) -> np.ndarray:
        raw = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = np.append(True, (raw[1:] != _SPACE) | (raw[:-1] != _SPACE))[:len(raw)]
        return raw[keep]


def suffix_automaton(codes: list[int], letters: int) -> np.ndarray:
    """Row s, column c: the state after c, or -1; state 0 is the empty string."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(follow), letters), -1, np.int32)
    for state, ways in enumerate(follow):
        for c, to in ways.items():
            table[state, c] = to
    return table


def parser_table(automaton: np.ndarray) -> np.ndarray:
    """(state, letter) -> four times the offset of the next state, plus the phrases that ended.

    Where a text has no way on, a phrase ends and the next one begins with the letter. A letter
    that the sample lacks is a phrase of its own. State 0 is between phrases.
    """
    states, letters = automaton.shape
    fresh = automaton[0]
    # In 32 bits from the start: every worker builds one for each language.
    out = automaton * np.int32(letters * 4)
    anew = np.maximum(fresh, 0) * (letters * 4) + np.where(fresh >= 0, 1, 2)
    np.copyto(out, anew.astype(np.int32), where=automaton < 0)
    out[0, fresh < 0] = 1
    out[:, _NONE] = np.arange(states) * letters * 4          # beyond a lane's end nothing moves
    return out.ravel()


class Parser:
    """Phrases of many texts against every language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.alphabet = Alphabet([t for texts in samples.values() for t in texts])
        tables, self.bits = [], []
        for language in self.languages:
            codes = self.alphabet.of(" ".join(samples[language]))
            tables.append(parser_table(suffix_automaton(codes.tolist(), self.alphabet.size)))
            self.bits.append(np.log2(max(len(codes), 2)))
        self.tables = tables

    @classmethod
    def shared(cls, samples: dict[str, list[str]]) -> Parser:
        """One per worker process and set of samples, until other work takes the process."""
        mark = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
        kept = held.tables("language")
        if mark not in kept:
            kept.clear()
            kept[mark] = cls(samples)
        return kept[mark]

    def phrases(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and letters by text."""
        counts, letters = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        for part in words.slices(texts):
            text = part.data.tobytes().decode()
            raw = self.alphabet.codes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
            # Characters per row: bytes that do not continue one.
            sizes = part.per_row((part.data & 0xC0) != 0x80)
            rows = np.repeat(np.arange(part.rows), sizes)
            first = np.append(True, rows[1:] != rows[:-1])[:len(rows)]
            keep = (raw != _SPACE) | ~np.append(False, raw[:-1] == _SPACE)[:len(raw)] | first
            raw, rows = raw[keep], rows[keep]
            letters.append(np.bincount(rows[raw != _SPACE], minlength=part.rows))
            counts.append(self._walk(raw, rows, part.rows))
        return np.concatenate(counts), np.concatenate(letters)

    def _walk(self, codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        sizes = np.bincount(rows, minlength=n)
        lanes = -(-sizes // _STRETCH)
        row_of = np.repeat(np.arange(n), lanes)
        begins = np.cumsum(sizes) - sizes
        within = np.arange(len(row_of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = begins[row_of] + within * _STRETCH
        lengths = np.minimum(sizes[row_of] - within * _STRETCH, _STRETCH)
        order = np.argsort(-lengths, kind="stable")              # so that lanes end in turn
        row_of, starts, lengths = row_of[order], starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(_STRETCH), "left")    # lanes longer than t
        out = np.zeros((n, len(self.languages)))
        for k, table in enumerate(self.tables):
            state = np.zeros(len(starts), np.int32)
            ended = np.zeros(len(starts), np.int32)
            for t in range(int(lengths[0]) if len(lengths) else 0):
                m = live[t]
                way = table[state[:m] + codes[starts[:m] + t]]
                ended[:m] += way & 3
                state[:m] = way >> 2
            out[:, k] = np.bincount(row_of, weights=ended + (state > 0), minlength=n)
        return out


def _samples(docs: DataFrame, learn: Column, text: str, language: str,
             per_language: int) -> dict[str, list[str]]:
    """Stretches of labelled documents, at most `per_language` characters of each language.

    Sampled texts are used whole; only the last one is cut where the sample is full.
    """
    known = docs.filter(learn & F.col(language).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(language).count().collect()}
    want = max(1, per_language // 1000)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items()
                            for x in (lang, min(1.0, 4 * want / n))]) if counts else None
    if chance is None:
        return {}
    found = (known.filter(draw < F.element_at(chance, F.col(language)))
             .select(language, F.left(text, F.lit(per_language)).alias("t"), draw.alias("d")).collect())
    out: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r["d"], r["t"])):
        lang = r[language]
        room = per_language - used.get(lang, 0)
        if room > 0:
            out.setdefault(lang, []).append(r["t"][:room])
            used[lang] = used.get(lang, 0) + len(r["t"][:room])
    return out


def identify(docs: DataFrame, keep: list[str], learn: Column, text: str = "text",
             language: str = "lang", per_language: int = 40_000) -> DataFrame:
    """The columns in `keep`, lang_pred and score (0 to 1) of every row.

    `learn` names the rows whose text and language may be used. lang_pred is a learned language,
    or `und` if the text is null or has no letter, or if nothing was learned. Equal costs go to the
    language that sorts first. score: 1 - cost of the winner / cost of the second; 0 for `und`, 1
    with one language only. Repeated rows are judged as rows; other columns are not read.
    """
    samples = _samples(docs, learn, text, language, per_language)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    if not samples:
        return kept.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        parser = Parser.shared(samples)
        names = np.array([*parser.languages, "und"])
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            phrases, letters = parser.phrases(texts)
            cost = phrases * np.array(parser.bits)
            best = cost.argmin(1)
            own = cost[np.arange(len(cost)), best]
            cost[np.arange(len(cost)), best] = np.inf
            second = cost.min(1)
            some = letters > 0
            score = np.where(some, 1 - own / np.maximum(second, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)],
                 pa.array(names[np.where(some, best, len(names) - 1)].tolist(), pa.string()),
                 pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in
                        docs.select(*keep).schema] + ["lang_pred string", "score double"])
    return kept.mapInArrow(run, schema)
