import json
import sys

import jobs


def run(monkeypatch, *words):
    monkeypatch.setattr(sys, "argv", ["jobs.py", *[str(w) for w in words]])
    jobs.main()


def test_from_json_lines_to_answers(spark, tmp_path, monkeypatch):
    reviews = [
        json.dumps({"user_id": f"u{i % 20}", "asin": f"p{(i * 7 + i // 20) % 15}", "rating": 4 + i % 2, "timestamp": i})
        for i in range(600)
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(reviews))
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"parent_asin": f"p{i}", "title": f"Thing {i}"}) for i in range(15)))
    run(monkeypatch, "interactions", "--source", tmp_path / "r.jsonl", "--meta", tmp_path / "m.jsonl", "--output", tmp_path / "t")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 600

    run(monkeypatch, "train-knn", "--path", tmp_path / "t", "--output", tmp_path / "knn")
    run(monkeypatch, "search", "--model", tmp_path / "knn", "--query", "thing 14", "--output", tmp_path / "found")
    assert [r.asin for r in spark.read.parquet(str(tmp_path / "found")).collect()] == ["p14"]

    spark.createDataFrame([("p3",)], "seed string").write.parquet(str(tmp_path / "seeds"))
    run(
        monkeypatch, "recommend", "--model", tmp_path / "knn", "--seed-table", tmp_path / "seeds", "--top-k", 4, "--output", tmp_path / "a"
    )
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4

    run(monkeypatch, "evaluate-knn", "--model", tmp_path / "knn", "--ks", 3, 9, "--output", tmp_path / "metrics")
    report = spark.read.json(str(tmp_path / "metrics")).first()
    assert report.n_evaluated == 20 and 0 <= report.hit_at_3 <= report.hit_at_9 <= 1

    run(
        monkeypatch, "evaluate-als", "--path", tmp_path / "t", "--factors", 3, "--iterations", 2, "--ks", 5, "--output", tmp_path / "als"
    )
    report = spark.read.json(str(tmp_path / "als")).first()
    assert report.n_evaluated == 20 and report.n_items == 15

    # the same with a second part file whose ratings are text
    spark.read.parquet(str(tmp_path / "t")).selectExpr(
        "reviewerID", "asin", "CAST(rating AS STRING) AS rating", "reviewText", "timestamp + 1000 AS timestamp", "product_title", "main_category"
    ).write.mode("append").parquet(str(tmp_path / "t"))
    run(monkeypatch, "evaluate-als", "--path", tmp_path / "t", "--factors", 3, "--iterations", 2, "--ks", 5, "--output", tmp_path / "als2")
    assert spark.read.json(str(tmp_path / "als2")).first().nnz_train >= report.nnz_train

    histories = [("q", 1, "p3"), ("q", 2, "p4"), ("r", 1, "gone")]
    spark.createDataFrame(histories, "query string, pos int, asin string").write.parquet(str(tmp_path / "h"))
    for kind, model in (("knn", "knn"), ("als", "als_model")):
        run(
            monkeypatch, "recommend-history", "--kind", kind, "--model", tmp_path / model, "--history-table", tmp_path / "h",
            "--top-k", 3, "--output", tmp_path / f"answers-{kind}",
        )
        found = spark.read.parquet(str(tmp_path / f"answers-{kind}")).collect()
        assert sorted((r.query, r.status) for r in found) == [("q", "ok")] * 3 + [("r", "not_found")]
        assert not {r.asin for r in found} & {"p3", "p4"}
