"""Decontamination, source divergence and part codes against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from repograph.llm import decontaminate, divergence
from repograph.llm.decontaminate import find_contamination, remove_documents, remove_spans
from repograph.llm.divergence import source_divergence
from repograph.llm.part_codes import codebooks_text, compress, nearest

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- decontamination

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _gram_words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def _expected_hits(docs, items, size=10):
    grams = defaultdict(set)
    for item, text in items:
        w = _gram_words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1):
            if n:
                grams[tuple(w[k:k + n])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, own = _gram_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    own |= grams[tuple(w[k:k + n])]
        out.append((doc, len(w), len(hit), sorted(str(i) for i in own if i is not None)))
    return sorted(out, key=repr)


def _contamination_tables(seed=3):
    rnd = random.Random(seed)
    item = [" ".join(rnd.choice(["The", "cat", "É", "9", "sat", "über", "on", "mat"])
                     for _ in range(n)) for n in (14, 25, 10, 3, 1, 12)]
    items = [*enumerate(item), (6, None), (7, "... !!"), (2, item[0]), (None, item[5]), (11, item[1])]
    docs = [(1, None), (2, ""), (3, "?!"), (None, item[0]), (None, item[0]), (4, item[3])]
    for k in range(5, 60):
        parts = [" ".join(rnd.choice(["a", "b", "zz", "mat", "9"]) for _ in range(rnd.randrange(9)))]
        for _ in range(rnd.randrange(3)):
            some = rnd.choice(item).split()
            a = rnd.randrange(len(some))
            parts += [",-".join(some[a:]).upper(), "x y"]
        docs.append((k % 50, "\n".join(parts)))
    docs.append((70, "w " * 300_000 + item[1] + " w" * 300_000))
    return docs, items


@pytest.mark.parametrize("bound", [64 << 20, 700])
def test_contamination_is_that_of_brute_force(spark, bound):
    docs, items = _contamination_tables()
    # Extra columns with names of the operator's own.
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs],
                                  "doc_id bigint, text string, row string, n_hit int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, gram string")
    got = find_contamination(table, bench, ["doc_id", "row", "n_hit"], broadcast_bytes=bound)
    rows = [(r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"], r["starts"], r["ends"])
            for r in got.collect()]
    assert sorted([r[:4] for r in rows], key=repr) == _expected_hits(docs, items)
    for r in rows:
        assert sum(b - a for a, b in zip(r[4], r[5])) == r[2]
        assert all(b < a for b, a in zip(r[5], r[4][1:]))
    assert any(r[2] for r in rows) and any(r[1] > 600_000 for r in rows)


@pytest.mark.parametrize("bound", [64 << 20, 300])
def test_spans_and_documents_go(spark, bound):
    gram = "one two three four five six seven eight nine ten"
    docs = [(1, f"Keep, this! {gram.upper()}; and that."), (2, "clean text"), (3, None),
            (4, f"{gram} eleven\n{gram}"), (5, gram), (None, f"é {gram} ü")]
    table = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id bigint, text string, clean string")
    bench = spark.createDataFrame([(1, gram), (2, "alpha beta " * 6), (3, "gamma delta " * 7)],
                                  "item_id bigint, text string")
    cut = remove_spans(table, bench, broadcast_bytes=bound)
    assert cut.columns == table.columns
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted([
        (1, "Keep, this! ; and that.", "c"), (2, "clean text", "c"), (3, None, "c"),
        (4, " eleven\n", "c"), (5, "", "c"), (None, "é  ü", "c")], key=repr)
    left = remove_documents(table, bench, share=0.75, broadcast_bytes=bound)
    assert left.columns == table.columns
    assert sorted([r[0] for r in left.collect()], key=repr) == [1, 2, 3]


def test_equal_hashes_do_not_hit(spark, monkeypatch):
    """With all hashes equal every window is found, and only real grams are verified."""
    grams = decontaminate.GramSet(["a b", "c d"], [2, 2], [["1"], ["2"]])
    own = grams.by_size[2]
    monkeypatch.setattr(own, "hashes", np.zeros(2, np.uint64))
    own.present[:] = True
    monkeypatch.setattr(decontaminate.words, "window_hashes", lambda h, o, n: (
        np.zeros(max(len(h) - n + 1, 0), np.uint64), np.arange(max(len(h) - n + 1, 0)),
        np.zeros(max(len(h) - n + 1, 0), np.int64)))
    part = next(decontaminate.words.slices(pa.array(["a c d x a b"]), table=decontaminate._NORMAL))
    hit, pairs = decontaminate._hits(part, grams)
    assert hit.tolist() == [False, True, True, False, True, True]
    assert pairs.tolist() == [[0, 0], [0, 1]]


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert find_contamination(docs.limit(0), bench, ["doc_id"]).count() == 0
    row = find_contamination(docs, bench.limit(0), ["doc_id"]).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


# --- source divergence

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _expected_divergence(rows, least, top):
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    held, count = defaultdict(set), Counter()
    for k, (text, lang, source) in enumerate(rows):
        for term in _TERM.findall(text):
            term = term.translate(_LOWER)
            held[lang, term].add(k)
            count[lang, source, term] += 1
    out = []
    groups = sorted({(la, s) for _, la, s in rows})
    for lang, source in groups:
        terms = [t for (la, t), ks in held.items() if la == lang and len(ks) >= least]
        v = len(terms)
        others = [s for la, s in groups if la == lang and s != source]

        def shares(sources):
            own = {t: sum(count[lang, s, t] for s in sources) for t in terms}
            n = sum(own.values())
            return {t: 1 + 10**9 * (c + 5) // (n + 5 * v) for t, c in own.items()}

        p, q = shares([source]), shares([source, *others])
        pairs = [(s, sum(abs(p[t] - x) for t, x in shares([s]).items())) for s in others]
        gaps = [(t, p[t] - q[t]) for t in terms if count[lang, source, t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", gaps)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items)
                    if part == "pair" or k < top]
    return sorted(out)


def _divergence_rows():
    rnd = random.Random(5)
    forms = ["the", "The,", "THE.", "don't", "über-Über", "É", "é!", "9x9", "--", "a b", "zeta"]
    rows = [(None, None, None), ("", "en", "empty"), ("!! 12", "en", "none"), ("the", "xx", "s"),
            (None, "en", None), ("a\x00b\x7fc the_the", "en", "s1")]
    for k in range(300):
        some = rnd.sample(forms, rnd.randrange(1, len(forms)))
        rows.append((rnd.choice([" ", "\n", "\t"]).join(rnd.choice(some) for _ in range(20)),
                     "en" if k % 3 else "de", "hot" if k % 2 else f"s{k % 7}"))
    rows += [rows[-1]] * 20 + [("long " * 400_000 + "the", "en", "s1")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, small):
    if small:
        # Many blocks, buckets, shards and blocks of sources.
        monkeypatch.setattr(divergence, "_BUCKET_CHUNKS", 7)
        monkeypatch.setattr(divergence, "_SHARD_TERMS", 3)
        monkeypatch.setattr(divergence, "_BLOCK_SOURCES", 2)
    rows = _divergence_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "text string, lang string, source string, count int, term string")
    got = source_divergence(table.repartition(5), least=10, top=3)
    assert sorted(map(tuple, got.collect())) == _expected_divergence(rows, 10, 3)


def test_divergence_without_terms(spark):
    table = spark.createDataFrame([("a", "en", "s"), ("b", "en", "t")],
                                  "text string, lang string, source string")
    assert sorted(map(tuple, source_divergence(table).collect())) == [
        ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert source_divergence(table.limit(0)).collect() == []


def test_every_distinct_chunk_is_cut_once(monkeypatch):
    seen = []
    cut = divergence.cut_chunks
    monkeypatch.setattr(divergence, "cut_chunks", lambda c: seen.extend(c) or cut(c))
    import zstandard
    bodies = [zstandard.compress(b) for b in (b"a,\nb", b"b\nc-d", b"a,\nc-d")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0, 0], pa.int32()), pa.array([1, 2, 3], pa.int64()), pa.array(bodies, pa.binary())],
        names=["bucket", "block", "chunks"])
    out = [zstandard.decompress(b) for x in divergence._cut([batch]) for b in x.column(2).to_pylist()]
    assert out == [b"a \nb", b"b\nc d", b"a \nc d"]
    assert sorted(seen) == [b"a,", b"b", b"c-d"]


def test_counts_beyond_32_bits_survive_packing():
    block = divergence._pack(np.array([1 << 31]), np.array([7]))
    assert divergence._unpack(block, 2).tolist() == [[1 << 31], [7]]
    sums = divergence._Sums()
    import zstandard
    many = (1 << 40) + 3
    for _ in range(2):
        sums.add(["en"], ["s"], zstandard.compress(b"t"), divergence._pack(
            *(np.array([x]) for x in (0, 0, 30, many & 0xFFFFFFFF, many >> 32))))
    assert sums.kept(60).to_pylist() == [{"lang": "en", "source": "s", "term": "t", "count": 2 * many}]
    assert sums.kept(61).num_rows == 0


# --- part codes

def _expected_codes(rows, entries=256, rounds=4, parts=4):
    fit = [(i, [math.floor(1024 * x) for x in v], la) for i, v, la in rows
           if v and all(x is not None and math.isfinite(x) for x in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not fit:
        return [], ""
    width = len(fit[0][1])
    fit = [r for r in fit if len(r[1]) == width]
    edges = np.cumsum([0] + [len(p) for p in np.array_split(range(width), parts)]).tolist()
    cut = [[tuple(v[a:b]) for a, b in zip(edges, edges[1:])] for _, v, _ in fit]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[near(p, c[p])[1]].append(c[p])
            for k, some in own.items():
                books[p][k] = tuple(sum(x) // len(some) for x in zip(*some))
    coded = [[near(p, c[p]) for p in range(parts)] for c in cut]
    by_label = Counter()
    for r, c in zip(fit, coded):
        by_label[r[2]] += sum(d for d, _ in c)
    return (sorted([(r[0], [k for _, k in c], sum(d for d, _ in c), by_label[r[2]])
                    for r, c in zip(fit, coded)], key=repr),
            ",".join(str(x) for b in books for e in b for x in e))


def _vector_rows(width, n=400, seed=2):
    rnd = random.Random(seed)
    rows = [(i, [round(rnd.gauss(0, 0.2), 3) for _ in range(width)], rnd.choice([None, 1, 2, 3]))
            for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.1] * (width - 1), 1), (n + 2, [], 2),
             (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] * width, None),
             (n + 5, [0.5] * (width + 1), 1), (None, [0.25] * width, 2), (3, [0.2] * width, 3)]
    # A large group of copies, and parts with long common prefixes.
    rows += [(n + 10 + k, rows[0][1], 9) for k in range(300)]
    rows += [(n + 400 + k, [0.125] * (width - 1) + [k / 1024], 1) for k in range(600)]
    return rows


@pytest.mark.parametrize("width, entries", [(16, 20), (8, 256), (10, 5), (3, 4)])
def test_codes_are_those_of_brute_force(spark, width, entries):
    rows = _vector_rows(width)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], la) for i, v, la in rows]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, "
                                  "label int, codes string, error int").repartition(7)
    got, books = compress(table, "embedding", "vec_id", "label", entries=entries)
    out = sorted([(r["row"]["vec_id"], r["codes"], r["error"], r["label_error"])
                  for r in got.collect()], key=repr)
    expected, text = _expected_codes(rows, entries)
    assert codebooks_text(books) == text
    assert out == expected


def test_large_values_are_exact():
    rows = np.array([[1 << 25, -(1 << 25)], [3, 4], [1 << 25, 0]])
    book = np.array([[-(1 << 25), 1 << 25], [0, 0], [0, 0]])
    entries, least = nearest(rows, book)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in book] for r in rows]
    assert least.tolist() == [min(d) for d in exact]
    assert entries.tolist() == [d.index(min(d)) for d in exact]


def test_no_fit_vectors(spark):
    table = spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int")
    for t in (table, table.limit(0)):
        got, books = compress(t, "embedding", "vec_id", "label")
        assert got.collect() == [] and books == []
