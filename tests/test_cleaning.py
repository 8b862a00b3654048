import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as registered
from shelfmate.operators import cleaning
from shelfmate.operators.joins import splittable_join
from shelfmate.plans.categories import build_all_categories, build_interactions
from shelfmate.schemas import INTERACTION_COLUMNS

SCHEMA = "reviewerID string, asin string, rating double, reviewText string, timestamp long, parent_asin string"


def review(user, item, n):
    return [(user, item, 4.0, "x", 1000, item)] * n


FIXTURE = review("U1", "I1", 6) + review("U2", "I2", 5) + review("U3", "I1", 5) + review("U3", "I3", 2)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_core_filter_is_one_pass(spark, partitions):
    df = spark.createDataFrame(FIXTURE, SCHEMA).repartition(partitions)
    kept = cleaning.core_filter(df)
    assert kept.count() == 11
    assert rows(kept.groupBy("reviewerID", "asin").count()) == [("U1", "I1", 6), ("U3", "I1", 5)]


def test_core_filter_drops_null_keys(spark):
    extra = review(None, "I9", 12) + review("U9", None, 12)
    kept = cleaning.core_filter(spark.createDataFrame(FIXTURE + extra, SCHEMA))
    assert kept.count() == 11


def test_core_filter_counts_within_scope(spark):
    df = spark.createDataFrame(FIXTURE, SCHEMA)
    both = df.selectExpr("'a' as category", "*").union(df.where("reviewerID <> 'U3'").selectExpr("'b' as category", "*"))
    kept = cleaning.core_filter(both, scope=["category"])
    assert rows(kept.select("category").distinct()) == [("a",)]


def test_metadata_join_keeps_unmatched_rows(spark):
    reviews = spark.createDataFrame(FIXTURE, SCHEMA)
    meta = spark.createDataFrame([("I1", "Drill", "Tools")], "parent_asin string, product_title string, main_category string")
    joined = cleaning.join_metadata(reviews, meta)
    assert rows(joined.groupBy("product_title").count()) == [("Drill", 11), (None, 7)]


def test_interactions_have_seven_columns_with_and_without_metadata(spark):
    reviews = spark.createDataFrame(FIXTURE, SCHEMA)
    assert build_interactions(reviews, None).columns == INTERACTION_COLUMNS
    meta = spark.createDataFrame([("I1", "Drill", "Tools")], "parent_asin string, product_title string, main_category string")
    table = build_interactions(reviews, meta)
    assert table.columns == INTERACTION_COLUMNS
    assert rows(table.select("product_title").distinct()) == [("Drill",)]


def test_filter_before_join_equals_join_before_filter(spark):
    reviews = spark.createDataFrame(FIXTURE, SCHEMA)
    meta = spark.createDataFrame([("I1", "Drill", "Tools")], "parent_asin string, product_title string, main_category string")
    late = build_interactions(reviews, meta)
    early = cleaning.core_filter(cleaning.join_metadata(reviews, meta)).select(late.columns)
    assert rows(late) == rows(early)


def test_all_categories_in_one_plan(spark):
    reviews = spark.createDataFrame(FIXTURE, SCHEMA).selectExpr("'a b' as category", "*")
    built = build_all_categories(reviews, None)
    assert built.columns == ["category", *INTERACTION_COLUMNS]
    assert built.count() == 11


def test_rating_texts(spark):
    texts = ["4.0", "4", " 5 ", "abc", "", "5d", None, "NaN", "-1", "1e1", "Infinity", "0x1"]
    out = cleaning.coerce_rating(spark.createDataFrame([(t,) for t in texts], "rating string"))
    assert sorted(r.rating for r in out.collect()) == [-1.0, 4.0, 4.0, 5.0, 10.0]


def test_numeric_nan_is_dropped_and_floor_applies(spark):
    df = spark.createDataFrame([(float("nan"),), (3.9,), (4.0,), (None,)], "rating double")
    out = cleaning.min_rating(cleaning.coerce_rating(df))
    assert [r.rating for r in out.collect()] == [4.0]
    assert cleaning.min_rating(df, 0).count() == 4


def test_required_columns(spark):
    df = spark.createDataFrame([("4", 1), ("5", None)], "rating string, timestamp long")
    assert cleaning.coerce_rating(df, also_required=["timestamp"]).count() == 1


def test_rating_floor_and_columns_reach_the_file_reader(spark, tmp_path):
    spark.createDataFrame(FIXTURE, SCHEMA).write.parquet(str(tmp_path / "t"))
    kept = cleaning.min_rating(cleaning.coerce_rating(spark.read.parquet(str(tmp_path / "t")))).select("asin")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rating,4.0)" in plan
    assert "ReadSchema: struct<asin:string,rating:double>" in plan


def test_joined_rows_are_made_once_for_both_counts_and_the_filter(spark, tmp_path):
    lines = [(1, 1, 7, 31.0, "R", "F"), (1, 2, 8, 31.0, "N", "O")]
    lines_schema = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, lines_schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.sql("SELECT 1L AS o_orderkey, 5L AS o_custkey, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    parts = spark.createDataFrame([(7, "seven", "ECONOMY")], "p_partkey long, p_name string, p_type string")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    kept = registered.q_core_filter(spark, str(tmp_path), min_user=2, min_item=1)
    assert "l_orderkey" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert rows(kept, "reviewerID", "asin", "product_title") == [("5", "7", "seven"), ("5", "8", None)]


def test_the_key_added_to_a_join_is_one_bit(spark):
    left = spark.range(1000).withColumn("key", F.col("id").cast("string"))
    joined = splittable_join(left, left.select("key").distinct(), ["key"], "left_semi")
    assert joined.count() == 1000
    assert "shiftrightunsigned" in joined._jdf.queryExecution().optimizedPlan().toString()
