import gzip
import json

import pytest
from conftest import rows

from shelfmate.operators.cleaning import coerce_rating
from shelfmate.plans.categories import run_categories
from shelfmate.schemas import INTERACTION_COLUMNS
from shelfmate.sources import json_lines, tables

METADATA = [
    '{"parent_asin":"A","title":"t","main_category":"c"}',
    '{"parent_asin":"A","title":"t2"}',
    '{"title":"x"}',
    '{"asin":"B","title":"x"}',
    '{"parent_asin":null,"title":"n"}',
    '{"parent_asin":"C","title":null}',
    '{"parent_asin":12,"title":true}',
    "not json",
    "[1]",
    "",
    '{"parent_asin":"D"',
    '{"parent_asin":"E"} junk',
    "{'parent_asin':'F'}",
]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_metadata_lines(spark, tmp_path):
    path = write(tmp_path / "meta.jsonl", METADATA)
    out = json_lines.read_metadata(spark, path)
    assert rows(out) == [("12", "true", None), ("A", "t", "c"), ("C", None, None)]


def test_metadata_cache_falls_back_to_item_id(spark, tmp_path):
    path = write(tmp_path / "meta.jsonl", METADATA)
    out = json_lines.write_metadata_cache(spark, path, str(tmp_path / "cache"))
    assert rows(out.select("parent_asin")) == [("12",), ("A",), ("B",), ("C",)]


def test_first_copy_wins_across_many_partitions(spark):
    df = spark.createDataFrame([("k", i, f"t{i}") for i in range(100)], "key string, position int, title string")
    out = json_lines.first_per_key(df.repartition(7), "key", df["position"])
    assert rows(out) == [("k", "t0")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_row_is_found_by_hash_aggregates(spark, tmp_path):
    """A key with a third of the rows, over files and splits; the smallest file name comes first, not the largest file."""
    folder = tmp_path / "meta"
    folder.mkdir()
    for name, count in (("b", 4000), ("a", 50), ("c", 900)):
        lines = [json.dumps({"parent_asin": "hot" if i % 3 == 0 else f"k{i % 70}", "title": f"{name}{i:05d}"}) for i in range(count)]
        write(folder / f"{name}.jsonl", lines)
    want = {}
    for name, count in (("a", 50), ("b", 4000), ("c", 900)):
        for i in range(count):
            want.setdefault("hot" if i % 3 == 0 else f"k{i % 70}", f"{name}{i:05d}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = json_lines.read_metadata(spark, str(folder))
        assert {r.parent_asin: r.product_title for r in out.collect()} == want
        assert "SortAggregate" not in plan_of(out) and "HashAggregate" in plan_of(out)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("zipped", [False, True])
def test_limit_counts_physical_lines(spark, tmp_path, zipped):
    lines = ["broken" if i % 7 == 0 else json.dumps({"user_id": f"u{i}", "asin": "a"}) for i in range(50)]
    if zipped:
        path = str(tmp_path / "r.jsonl.gz")
        with gzip.open(path, "wt") as f:
            f.write("\n".join(lines))
    else:
        path = write(tmp_path / "r.jsonl", lines)
    out = json_lines.read_reviews(spark, path, limit=10)
    assert rows(out.select("reviewerID")) == [(f"u{i}",) for i in (1, 2, 3, 4, 5, 6, 8, 9)]


def test_limited_metadata_reads_three_times_as_many_lines(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [json.dumps({"parent_asin": f"p{i:02d}"}) for i in range(40)])
    assert json_lines.read_metadata(spark, path, limit=5).count() == 15


def test_limit_across_splits(spark, tmp_path):
    lines = [json.dumps({"user_id": f"u{i}", "asin": "a"}) for i in range(3000)]
    path = write(tmp_path / "r.jsonl", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        out = json_lines.read_reviews(spark, path, limit=700)
        assert {r.reviewerID for r in out.collect()} == {f"u{i}" for i in range(700)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reviews(spark, tmp_path):
    lines = [
        '{"user_id":"u1","text":"t","parent_asin":"P","asin":"a","rating":4.0,"timestamp":7,"extra":[1]}',
        '{"user_id":"u2","text":"t","asin":"b","rating":"5","timestamp":8}',
        '{"user_id":"u3", broken',
        "{'user_id':'u4','asin':'c'}",
    ]
    out = json_lines.read_reviews(spark, write(tmp_path / "r.jsonl", lines))
    assert out.count() == 2
    assert rows(out) == [("u1", "a", "4.0", "t", 7, "P"), ("u2", "b", "5", "t", 8, "b")]


def test_no_record_is_lost_over_a_type(spark, tmp_path):
    lines = [
        '{"user_id":"u1","asin":"a","timestamp":"1600000000"}',
        '{"user_id":"u2","asin":"a","timestamp":1.6e12}',
        '{"user_id":3,"asin":"a","timestamp":{"x":1},"rating":[1]}',
        '{"text":"no key"}',
    ]
    path = write(tmp_path / "r.jsonl", lines)
    want = [(None, None), ("3", None), ("u1", 1600000000), ("u2", 1600000000000)]
    for limit in (None, 10):
        assert rows(json_lines.read_reviews(spark, path, limit), "reviewerID", "timestamp") == sorted(want, key=repr)


def test_a_folder_may_mix_types(spark, tmp_path):
    spark.createDataFrame([("u", 4.0)], "reviewerID string, rating double").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("v", "5")], "reviewerID string, rating string").write.mode("append").parquet(str(tmp_path / "t"))
    for path in (tmp_path / "t", tmp_path / "t" / "*.parquet"):
        assert rows(coerce_rating(tables.read_shards(spark, [str(path)]))) == [("u", 4.0), ("v", 5.0)]


def test_the_sink_stores_numbers(spark, tmp_path):
    frame = spark.createDataFrame([("u", "a", "4.0"), ("v", "a", "abc")], "reviewerID string, asin string, rating string")
    tables.write_interactions(frame, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "reviewerID", "rating") == [("u", 4.0), ("v", None)]


def test_shards_with_different_rating_types(spark, tmp_path):
    spark.createDataFrame([("u", "a", 4.0)], "reviewerID string, asin string, rating double").write.parquet(str(tmp_path / "1"))
    spark.createDataFrame([("v", "b", "5"), ("w", "c", "bad")], "reviewerID string, asin string, rating string").write.parquet(
        str(tmp_path / "2")
    )
    shards = tables.read_shards(spark, [str(tmp_path / "2"), str(tmp_path / "1")], ["reviewerID", "rating"])
    assert rows(coerce_rating(shards)) == [("u", 4.0), ("v", 5.0)]
    with pytest.raises(ValueError):
        tables.read_shards(spark, [])


def test_category_run(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    reviews = [json.dumps({"user_id": f"u{i % 2}", "asin": "I", "rating": 5, "timestamp": i}) for i in range(14)]
    write(data / "r.jsonl", reviews)
    write(data / "m.jsonl", ['{"parent_asin":"I","title":"Drill","main_category":"Tools"}'])
    config = {
        "categories": [
            {"name": "A B", "review_file": "r.jsonl", "meta_file": "m.jsonl"},
            {"name": "Gone", "review_file": "missing.jsonl", "meta_file": "m.jsonl"},
            {"name": "Incomplete", "review_file": "r.jsonl"},
        ]
    }
    (tmp_path / "c.json").write_text(json.dumps(config, indent=2))
    run = lambda out, go_on: run_categories(
        spark, str(tmp_path / "c.json"), str(data), str(tmp_path / out), continue_on_error=go_on
    )
    summary = run("out", True)
    assert rows(summary, "category", "status") == [("A B", "success"), ("Gone", "failed"), ("Incomplete", "failed")]
    table = spark.read.parquet(str(tmp_path / "out" / "dev_A_B.parquet"))
    assert table.columns == INTERACTION_COLUMNS and table.count() == 14
    assert rows(table.select("product_title").distinct()) == [("Drill",)]
    report = spark.read.json(str(tmp_path / "out" / "timings_A_B.json")).first()
    assert report.total_s == pytest.approx(report.load_s + report.filter_s + report.to_parquet_s)
    assert run("stop", False).count() == 2
