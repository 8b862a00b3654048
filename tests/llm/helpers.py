"""Tables with the awkward cases every operator must stand."""

from collections import defaultdict

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("kept", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20000))
PLAIN = "The quick brown fox jumps over the lazy dog and then it sleeps for a long while under the old tree."


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one row twice under two ids."""
    texts = [
        (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, PLAIN.replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n "), (7, LONG), (8, LONG + " end"),
        (None, PLAIN), (None, None), (9, "three short words"), (10, "three short words "), (11, "Ünïcödé 中文 😀 café naïve"),
        (-5, "negative id text with more than five words here"), (12, "a\r\nb\r\na\r\nb\r\n" * 30),
    ]
    rows = [(i, t, None, None if n % 3 == 0 else f"s{n % 3}", None, "k", "s", "n", "w", "i", "y") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def classes_by_hand(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return groups
