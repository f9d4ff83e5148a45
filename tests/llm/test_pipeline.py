"""The pipeline's stages on small tables: what goes, what stays, and the columns that they return."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repograph.stage import staged

_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns with names that the operators use themselves.
_CLASHING = ", _text string, features int, raw int, score int, class_id int, _hash int, _kept string, _same int"
_CLASH = ("t", 1, 2, 3, 4, 5, "k", 6)
_FILTERS = dict(corpus_pipeline.STAGES[:-1])


def _passage(first, n=70):
    return " ".join(f"word{first * 1000 + i}" for i in range(n))


def _table(spark, rows, clashing=True):
    own = [(i, t, lang, "s", None if t is None else len(t)) + (_CLASH if clashing else ())
           for i, t, lang in rows]
    return spark.createDataFrame(own, _COLUMNS + (_CLASHING if clashing else ""))


_CLEAN = ["the quick brown fox jumps over the lazy dog", "a kind reader wrote a thoughtful letter",
          "we walked along the river in the morning", "the garden is green after the summer rain"]
_TOXIC = ["you are a stupid worthless idiot", "shut up you moron, nobody wants you",
          "you stupid idiot, you are garbage", "you pathetic moron, shut up"]


_CLEAN_IDS = {i for i in range(240) if i % 3}


def _labelled():
    """Documents of both kinds; every third one is toxic."""
    kinds = [_CLEAN if i in _CLEAN_IDS else _TOXIC for i in range(240)]
    return [(i, f"{kind[i % 4]} {kind[(i // 4) % 4]} {_passage(i, 12)}", "en")
            for i, kind in enumerate(kinds)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labelled documents; edge rows stand behind them."""
    rows = _labelled()
    rows += [(500, None, "en"), (501, "", None), (502, "12 34 !!", "en"), (None, "no id here", "en"),
             (503, _passage(900), "en"), (504, f"before {_passage(900)} after {_passage(901, 30)}", "en"),
             (505, _passage(902, 80), "en"), (506, _passage(902, 80) + " tail", "en"),
             (505, _passage(902, 80), "en")]
    folder = str(tmp_path_factory.mktemp("sf"))
    _table(spark, rows, False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(240)],
                          "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return folder


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", list(_FILTERS))
def test_filters_keep_columns_and_take_edge_rows(spark, sf_dir, name):
    """Nulls, empty texts, repeated rows and clashing extra columns; then an empty table."""
    edges = [(900, None, "en"), (901, "", None), (None, "a text without an id", "en"), (None, None, None),
             (902, _passage(950), "en"), (902, _passage(950), "en"), (903, "word " * 300_000, "en")]
    docs = _table(spark, _labelled() + edges)
    out = staged(_FILTERS[name](spark, docs, sf_dir))
    assert out.columns == docs.columns
    rows = out.collect()
    assert _CLEAN_IDS <= {r["doc_id"] for r in rows}
    assert all(tuple(r)[5:] == _CLASH for r in rows)
    none = staged(_FILTERS[name](spark, docs.limit(0), sf_dir))
    assert none.columns == docs.columns and none.count() == 0


def test_toxic_documents_go(spark, sf_dir):
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(
        spark, _documents(spark, sf_dir), sf_dir).collect()}
    toxic = set(range(240)) - _CLEAN_IDS
    assert len(kept & toxic) <= 0.1 * len(toxic) and _CLEAN_IDS <= kept


def test_documents_without_letters_go(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {500, 501, 502}


def test_one_of_each_group_stays(spark, sf_dir):
    docs = _table(spark, [(1, _passage(1), "en"), (2, _passage(1), "en"), (3, _passage(1) + " x", "en"),
                          (4, _passage(2), "en"), (4, _passage(2), "en"), (None, _passage(1), "en"),
                          (5, _passage(3, 70) + " " + _passage(4, 70), "en"), (6, _passage(3, 70), "en")])
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    # Half of 5 is 6: similar, but far below 0.8.
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 4, 5, 6]


def test_passages_of_earlier_documents_go(spark, sf_dir):
    late = f"before  {_passage(1)}\nafter"
    docs = _table(spark, [(1, _passage(1), "en"), (2, late, "en"), (3, _passage(2), "en"), (4, None, "en"),
                          (None, _passage(1), "en"), (2, "another  text of two", "en")])
    out = corpus_pipeline.substrings(spark, docs, sf_dir).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "", r["n_chars"] or 0) for r in out) == sorted([
        (1, _passage(1), len(_passage(1))), (2, "before after", 12), (3, _passage(2), len(_passage(2))),
        (4, "", 0), (0, _passage(1), len(_passage(1))), (2, "another  text of two", 20)])


def test_whole_run_is_its_stages(spark, sf_dir):
    """Pieces of every kept document, gapless in sequences; each stage's decisions take effect."""
    docs = _documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    want = staged(corpus_pipeline.packing(spark, docs, sf_dir))
    run = staged(corpus_pipeline.run(spark, sf_dir))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: sorted(json.dumps(tuple(r)) for r in df.select(*columns).collect())
    assert key(run) == key(want)
    assert {r["doc_id"] for r in run.collect()} == {r["doc_id"] for r in docs.collect()}
    places = run.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.count_distinct("offset").alias("places"), F.count(F.lit(1)).alias("rows")).collect()
    assert all(r["n"] == r["end"] <= 2048 and r["places"] == r["rows"] for r in places)
    ids = {r["doc_id"] for r in run.collect()}
    assert 500 not in ids and 502 not in ids and 506 not in ids
