"""Column names and types of the tables that cross module boundaries."""

from pyspark.sql import types as T

USER = "reviewerID"
ITEM = "asin"
JOIN_KEY = "parent_asin"

# The column list and order of the interaction table.
INTERACTION_COLUMNS = [
    "reviewerID",
    "asin",
    "rating",
    "reviewText",
    "timestamp",
    "product_title",
    "main_category",
]

# The fields of a review record. Any field may come as a number in one file and as text in
# another, so all are read as text; numbers are made of them afterwards, and no record is lost over a type.
RAW_REVIEW = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

# The fields of the category configuration.
CATEGORY_CONFIG = T.StructType(
    [
        T.StructField(
            "categories",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("review_file", T.StringType()),
                        T.StructField("meta_file", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

UNKNOWN_TITLE = "Unknown Product"
