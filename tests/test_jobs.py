"""Files in, model, files out."""

import json
import pathlib

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from txnlens.operators import evaluate, inject
from txnlens.operators.features import add_features
from txnlens.plans import profile, score, train
from txnlens.plans.rules import rule_scores
from txnlens.sources import csv, tables

SF = "/root/testdata/sf0.001"


def test_csv_keeps_text_and_fills_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("amount,recipient_entity\n1.50,0012\n2,77\n")
    (tmp_path / "in" / "b.txt").write_text("not,read\n")
    rows = csv.read_transactions(spark, str(tmp_path / "in")).collect()
    assert sorted(r.recipient_entity for r in rows) == ["0012", "77"]
    assert {r.customer_id for r in rows} == {"default_customer"}
    with pytest.raises(ValueError):
        csv.read_raw(spark, str(tmp_path / "in" / "b.txt"))


def test_csv_by_day(spark, tmp_path):
    txn = tables.txn_events(spark, SF)
    csv.write_csv(txn, str(tmp_path / "out"), by_day=True)
    days = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("day=")]
    assert len(days) == txn.select(F.to_date("timestamp")).distinct().count()
    back = csv.read_transactions(spark, str(tmp_path / "out"))
    same = [c for c in txn.columns if c != "timestamp"]
    assert back.select(same).exceptAll(txn.select(same)).count() == 0


def test_train_save_score(spark, tmp_path):
    txn = inject.inject_accidents(tables.txn_events(spark, "/root/testdata/sf0.01"))
    fitted, scored = train.fit(txn, trees=5, depth=3)
    judge = BinaryClassificationEvaluator(
        labelCol="target_accident", rawPredictionCol="accident_probability"
    )
    by_rule = rule_scores(scored.drop("accident_probability", "predicted_accident"))
    assert judge.evaluate(scored) > judge.evaluate(by_rule) > 0.5
    path = str(tmp_path / "model")
    fitted.write().overwrite().save(path)
    again = score.score(txn, PipelineModel.load(path))
    assert again.count() == add_features(txn).na.drop().count()
    flagged = evaluate.flagged(again)
    csv.write_json(flagged, str(tmp_path / "json"))
    lines = [
        json.loads(line)
        for part in pathlib.Path(tmp_path / "json").glob("part-*")
        for line in part.read_text().splitlines()
    ]
    assert len(lines) == flagged.count() > 0
    assert set(lines[0]) == set(flagged.columns)


def test_imputing_keeps_first_payments(spark):
    txn = tables.txn_events(spark, SF)
    featured = add_features(txn)
    assert train.split_rows(featured, "impute").count() == txn.count()
    assert train.split_rows(featured, "drop").count() < txn.count()


def test_profile_reports(spark):
    for name, report in profile.reports(tables.txn_events(spark, SF)).items():
        assert report.count() > 0, name


def test_jobs_from_files_to_files(spark, tmp_path, monkeypatch, capsys):
    txn = inject.inject_accidents(tables.txn_events(spark, SF))
    paths = {name: str(tmp_path / name) for name in ("in", "model", "out", "profile")}
    csv.write_csv(txn, paths["in"])

    def run(job, *words):
        monkeypatch.setattr("sys.argv", ["job", *words])
        job.main()

    run(train, paths["in"], paths["model"], "--trees", "2", "--depth", "2", "--na-policy", "impute")
    run(
        score,
        paths["in"],
        paths["model"],
        paths["out"],
        "--output-format",
        "csv",
        "--na-policy",
        "impute",
        "--recall",
    )
    run(profile, paths["in"], paths["profile"])
    shown = capsys.readouterr().out
    assert "weighted avg" in shown and "recall" in shown
    assert {p.name for p in pathlib.Path(paths["profile"]).iterdir()} == set(profile.reports(txn))
    assert list(pathlib.Path(paths["out"]).glob("*.csv"))
