"""Katz scores against a model built from dictionaries."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from repograph.llm.katz import discounts, score


def brute(docs):
    """docs: (doc_id, learned, text). Returns scores and the model's probability function."""
    def tokens(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
    uni, pair, texts = Counter(), Counter(), 0
    for _, learned, t in docs:
        if learned:
            own = tokens(t)
            uni.update(own)
            pair.update(zip(["<s>", *own], own))
            texts += 1
    total = sum(uni.values())
    counts = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    d1, d2 = discounts(counts(uni)), discounts(counts(pair))
    history = {**uni, "<s>": texts}
    rest = 1 - sum(c * (d1[c] if c < 6 else 1) for c in uni.values()) / total

    def single(w):
        return uni[w] * (d1[uni[w]] if uni[w] < 6 else 1) / total if uni[w] else rest

    after = {}
    for (h, w), c in pair.items():
        after.setdefault(h, {})[w] = c

    def p(h, w):
        seen = after.get(h)
        if not seen:
            return single(w)
        bare = all(c > 5 for c in seen.values())
        n = history[h] + bare
        if w in seen:
            return seen[w] * (d2[seen[w]] if seen[w] < 6 else 1) / n
        left = 1 - sum(c * (d2[c] if c < 6 else 1) for c in seen.values()) / n
        return left / (1 - sum(map(single, seen))) * single(w)

    out = {}
    for i, _, t in docs:
        own = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in own)
        out[i] = (len(own), sum(uni[w] > 0 for w in own), total, base,
                  sum(math.log10(p(h, w)) for h, w in zip(["<s>", *own], own)))
    return out, p, uni


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, learned boolean, text string, score int")


def test_matches_brute_force_and_sums_to_one(spark):
    lines = ["a b c a b", "A  b\td", "the the the the the the the of", "", None, "x y z a b c",
             "of the of the of", "a b c a b"] * 3 + ["q r s", "the unknown words of", "é É e"]
    rows = [(i, i % 7 != 2, t) for i, t in enumerate(lines)]
    want, p, uni = brute(rows)
    got = score(_docs(spark, [(*r, 5) for r in rows]), F.col("learned")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, value = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-9 and abs(r["score"] - value) < 1e-9
    for h in ["a", "the", "<s>", "nowhere"]:
        assert abs(sum(p(h, w) for w in [*uni, "unheard"]) - 1) < 1e-9


def test_edges(spark):
    rows = [(None, True, "a b", 1), (1, True, "a b", 1), (1, True, "a b", 1), (2, False, None, 1)]
    got = score(_docs(spark, rows), F.col("learned") & F.col("doc_id").isNotNull()).collect()
    assert len(got) == 4
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert {r["n_tokens"] for r in got if r["doc_id"] == 2} == {1}
    assert score(_docs(spark, []), F.col("learned")).count() == 0
    untrained = score(_docs(spark, rows), F.lit(False)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in untrained)
