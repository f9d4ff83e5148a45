"""Joins to a lookup in which one key has nine tenths of the rows."""

import pytest
from pyspark.sql import functions as F

from catalog import views
from repograph.operators import findings as ops, graph
from repograph.operators.skew import salted_join, split_join
from repograph.stage import staged


def executed(df):
    """The plan as run, without what was planned first."""
    plan = df._jdf.queryExecution()
    plan.executedPlan().execute().count()
    return plan.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 70 == 0, None).when(
            F.col("id") % 30 == 0, "absent").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"),
        (F.col("id") % 2).cast("int").alias("j"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    lookup = spark.createDataFrame(
        [("hot", 0, "H0"), ("hot", 1, None)] + [(f"k{i}", i % 2, f"v{i}") for i in range(0, 400, 3)]
        + [(None, 0, "null"), ("unused", 0, "u")], "k string, j int, v string")
    return rows, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_split_join_is_the_plain_join(tables, how, keys):
    rows, lookup = tables
    lookup = lookup.where("j = 0 OR k <> 'hot'") if keys == ["k"] else lookup
    lookup = lookup.drop("j") if keys == ["k"] else lookup
    plain = rows.join(lookup, keys, how)
    got = split_join(rows, lookup, keys, how)
    assert set(got.columns) == set(plain.columns)
    order = sorted(c for c in plain.columns if c != "m")
    listed = lambda df: sorted(map(str, df.select(*order, F.to_json("m")).collect()))
    assert listed(got) == listed(plain)
    if how != "left_anti":
        assert got.where("k = 'hot'").count() > 20_000


def test_hot_key_is_spread(spark, tables):
    """The rows of the hot key, which nine tenths are, come out of many tasks of the shuffle."""
    rows, lookup = tables
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        out = split_join(rows.repartition(4), lookup.where("j = 0").drop("j"), ["k"], "left")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(sizes) == 4 and max(sizes) < 0.35 * sum(sizes)


def test_split_join_of_empty_tables(tables):
    rows, lookup = tables
    lookup = lookup.where("j = 0").drop("j")
    assert split_join(rows.limit(0), lookup, ["k"], "left").collect() == []
    assert split_join(rows, lookup.limit(0), ["k"], "inner").collect() == []
    assert split_join(rows, lookup.limit(0), ["k"], "left_anti").count() == 30_000


def test_salted_join_is_the_plain_join(tables):
    rows, lookup = tables
    got = salted_join(rows, lookup, ["k", "j"], ["id"], "left")
    assert got.count() == 30_000


def test_salted_join_does_not_broadcast_the_copies_of_a_long_lookup(spark):
    # 120,000 entries are a small file, but 1.9 million copies.
    lookup = staged(spark.range(120_000).select(F.concat(F.lit("src/m"), "id").alias("k")))
    rows = spark.range(400_000).select("id", F.concat(F.lit("src/m"), F.col("id") % 150_000).alias("k"))
    joined = salted_join(rows, lookup, ["k"], ["id"], "left")
    assert joined.count() == 400_000
    assert "BroadcastHashJoin" not in executed(joined)


def test_salted_join_still_broadcasts_a_short_lookup(spark):
    lookup = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "a").otherwise("c").alias("k"))
    joined = salted_join(rows, lookup, ["k"], ["id"])
    assert joined.count() == 90 and "BroadcastHashJoin" in executed(joined)


def test_findings_and_files_are_not_broadcast(spark, tmp_path):
    """However short their files are: both tables grow."""
    spark.sql("SELECT id AS event_id, id % 9 AS user_id, 'view' AS event_type, 1.0D AS value FROM range(500)"
              ).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS doc_id, 'import a.b' AS text, 'en' AS lang, 'src1' AS source FROM range(64)"
              ).write.parquet(f"{tmp_path}/documents.parquet")
    placed = views.file_findings(spark, str(tmp_path))
    assert placed.count() == 500 and "BroadcastHashJoin" not in executed(placed)
    known = staged(ops.file_nodes(placed))
    edges = graph.import_edges(views.code_files(spark, str(tmp_path)), known)
    assert edges.count() == 8 * 3
    assert "SortMergeJoin" in executed(edges)
