"""One user or item owning a third of all rows is split, not handled by one task."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmate.operators import cleaning, identity, knn, matrix

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def reviews(spark, hot):
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (n % 5000).cast("string")))
    other = F.concat(F.lit("o"), F.pmod(F.xxhash64(n), F.lit(3000)).cast("string"))
    user, item = (key, other) if hot == "user" else (other, key)
    return spark.range(0, 300_000, 1, 16).select(
        user.alias("reviewerID"), item.alias("asin"), item.alias("parent_asin"), F.sha2(n.cast("string"), 256).alias("reviewText")
    )


def final_plan(df):
    """The adaptive plan after running it, with every column in use."""
    frame = df.groupBy().agg(*[F.max(F.xxhash64(c)).alias(c) for c in df.columns])
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", ["user", "item"])
def test_core_filter_splits_the_hot_key(spark, small_limits, hot):
    df = reviews(spark, hot)
    kept = cleaning.core_filter(df, 6, 11)
    assert "skew=true" in final_plan(kept)
    hot_column = "reviewerID" if hot == "user" else "asin"
    assert kept.where(F.col(hot_column) == "hot").count() == 100_000


def test_metadata_join_splits_the_hot_product(spark, small_limits):
    df = reviews(spark, "item")
    meta = df.select("parent_asin").distinct().withColumn("product_title", F.concat(F.lit("T "), "parent_asin"))
    joined = cleaning.join_metadata(df, meta)
    assert "skew=true" in final_plan(joined)
    assert rows(joined.where("parent_asin = 'hot'").groupBy("product_title").count()) == [("T hot", 100_000)]


def test_matrix_scaling_and_encoding_split_the_hot_item(spark, small_limits):
    df = reviews(spark, "item").withColumn("rating", F.lit(4.0))
    df = df.withColumn("reviewerID", F.concat("reviewerID", F.substring("reviewText", 1, 8)))
    cells = matrix.rating_matrix(df)
    items = matrix.coded_items(cells)
    vectors = knn.normalized_cells(cells, items, 2048)
    assert "skew=true" in final_plan(vectors)
    assert vectors.count() == cells.count()
    coded = identity.encode(df, items.select("asin", "item_idx"), "asin")
    assert "skew=true" in final_plan(coded)
