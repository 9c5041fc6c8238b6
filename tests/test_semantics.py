"""Missing-value and ordering rules, one small frame each."""

import datetime

import pytest
from pyspark.sql import functions as F

from dyadspark import functions as fx
from dyadspark.operators import relational as rel, reshape


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (2, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, w string")
    inner = rel.merge_tables(a, b, ["k"])
    assert rows(inner, "v") == [(1, "a", "x"), (None, "b", "y"), (None, "c", "y")]
    assert rel.merge_tables(a, b, ["k"], null_safe=False).count() == 1
    assert rel.merge_tables(a, b, ["k"], "left").count() == 4
    full = rel.merge_tables(a, b, ["k"], "full")
    assert rows(full, "v", "w") == [(3, None, "z"), (1, "a", "x"), (None, "b", "y"), (None, "c", "y"), (2, "d", None)]


def test_many_missing_keys_are_spread_without_loss(spark):
    a = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    b = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k bigint, w int")
    joined = rel.merge_tables(a, b, ["k"], "full")
    assert joined.where("k is null").count() == 333 * 2
    assert joined.count() == 333 * 2 + 167


def test_clashing_columns_get_suffixes(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert rel.merge_tables(a, a, ["k"]).columns == ["k", "v_x", "v_y"]


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert df.where(fx.not_in_set("v", ["a"])).count() == 2
    assert df.where(fx.in_set("v", ["a"])).count() == 1


def test_filter_and_case_skip_null_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    assert df.where((F.col("b") > 1)).count() == 1
    out = df.select(F.when(F.col("b") > 1, "hi").otherwise("lo").alias("v"))
    assert sorted(r.v for r in out.collect()) == ["hi", "lo"]


def test_aggregates_propagate_or_skip(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0), (2, 5.0)], "g int, v double")
    strict = {r.g: r for r in fx.summarise_columns(df, ["v"], ["g"]).collect()}
    loose = {r.g: r for r in fx.summarise_columns(df, ["v"], ["g"], na_policy="skip").collect()}
    assert strict[1].v_mean is None and strict[2].v_mean == 4.0
    assert loose[1].v_mean == 2.0 and loose[1].v_sd is None
    assert strict[2].v_se == pytest.approx(1.0)


def test_strict_least_and_greatest(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert rows(df.select(fx.strict_least("a", "b"), fx.strict_greatest("a", "b"))) == [(None, None), (1, 2)]


def test_first_row_follows_the_stated_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 9, "z"), (1, 1, "b")], "k int, o int, v string")
    assert rows(rel.first_by(df, ["k"], ["o"])) == [(1, 1, "a"), (2, 9, "z")]


def test_unlisted_levels_sort_last(spark):
    df = spark.createDataFrame([("x",), ("b",), ("a",), (None,)], "v string")
    out = df.select("v", fx.level_rank("v", ["b", "a"]).alias("r"))
    assert {r.v: r.r for r in out.collect()} == {"b": 1, "a": 2, "x": 999, None: 999}


def test_dates_numbers_and_rounding(spark):
    df = spark.createDataFrame([("03/02/2017", "x"), ("nonsense", "7")], "d string, n string")
    out = df.select(fx.parse_day("d").alias("d"), fx.to_number("n", "int").alias("n")).collect()
    assert out[0].d == datetime.date(2017, 2, 3) and out[0].n is None
    assert out[1].d is None and out[1].n == 7
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(fx.round_half_even("v").alias("v"))
    assert sorted(r.v for r in halves.collect()) == [0.0, 2.0, 2.0]


def test_days_apart_is_unsigned(spark):
    df = spark.sql("select date'2020-01-01' a, date'2020-03-01' b")
    assert df.select(fx.days_apart("a", "b")).first()[0] == 60


def test_distinct_count_on_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert rows(rel.distinct_over(df, ["k"], "v", "n")) == [(1, "a", 2), (1, "a", 2), (1, "b", 2), (2, "c", 1)]


def test_repeated_key_is_reported(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        rel.assert_unique_key(df, ["k"]).collect()


def test_list_cells_fail_loudly_when_too_large(spark):
    df = spark.range(20).selectExpr("1 as k", "'a' as name", "id as v")
    assert len(reshape.pivot_lists(df, ["k"], "name", "v", ["a"]).first()["a"]) == 20
    with pytest.raises(Exception, match="list cell"):
        reshape.pivot_lists(df, ["k"], "name", "v", ["a"], largest=10).collect()


def test_first_k_under_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"), "id")
    got = {(r.k, r.id) for r in rel.first_k(df, ["k"], ["id"], 4).collect()}
    want = {}
    for i in range(3000):
        want.setdefault(0 if i % 3 == 0 else i % 50 + 1, []).append(i)
    assert got == {(k, i) for k, v in want.items() for i in v[:4]}


def test_running_number_and_dense_id(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, null, id % 5) as k", "id * 7 as o")
    got = {(r.k, r.o): r.n for r in rel.running_number(df, ["k"], "o", "n", bucket=100).collect()}
    seen = {}
    for i in range(2000):
        k = None if i % 3 == 0 else i % 5
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, i * 7)] == seen[k]
    pairs = spark.range(1500).selectExpr("if(id % 3 = 0, 7, id % 40) as a", "id % 90 as b")
    ids = rel.dense_id(pairs, ("a", "b"), "d").collect()
    ranks = {p: i + 1 for i, p in enumerate(sorted({(r.a, r.b) for r in ids}))}
    assert len(ids) == 1500 and all(ranks[(r.a, r.b)] == r.d for r in ids)


def test_standardise_with_given_parameters(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "v double")
    local = [r.v_scaled for r in rel.standardise(df, ["v"]).orderBy("v").collect()]
    assert local == pytest.approx([-0.5, 0.0, 0.5])
    given = [r.v_scaled for r in rel.standardise(df, ["v"], params={"v": (1.0, 2.0)}).orderBy("v").collect()]
    assert given == [0.0, 1.0, 2.0]
