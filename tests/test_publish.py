"""Publishing by manifest, and the job that writes labelled payments."""

import pathlib

import pytest
from pyspark.sql import functions as F

from txnlens.operators import inject, labels
from txnlens.plans import label
from txnlens.sources import csv, publish, tables

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("kind, by_day", [("csv", False), ("csv", True), ("json", False), ("parquet", False)])
def test_published_rows_come_back(spark, tmp_path, kind, by_day):
    txn = tables.txn_events(spark, SF)
    path = str(tmp_path / "out")
    manifest = publish.publish(txn, path, kind, by_day)
    back = publish.read_published(spark, path)
    assert manifest.rows == txn.count() == sum(f.rows for f in manifest.files)
    assert back.columns == txn.columns and rows_of(back) == rows_of(txn)
    assert all((tmp_path / "out" / f.name).stat().st_size == f.size for f in manifest.files)


def test_a_job_that_dies_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    publish.publish(spark.range(10).toDF("n"), path, "parquet")
    dies = spark.range(0, 1000, 1, 8).select(
        F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("n")
    )
    with pytest.raises(Exception, match="lost"):
        publish.publish(dies, path, "parquet")
    assert rows_of(publish.read_published(spark, path)) == rows_of(spark.range(10).toDF("n"))
    # the next one takes its place, and the run before the last one goes
    first = publish.read_manifest(spark, path).run
    for n in (20, 30):
        publish.publish(spark.range(n).toDF("n"), path, "parquet")
    assert publish.read_published(spark, path).count() == 30
    assert not (tmp_path / "out" / first).exists()
    manifest = publish.read_manifest(spark, path)
    assert (tmp_path / "out" / manifest.before).exists()


def test_files_that_arent_the_published_ones(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path)
    manifest = publish.publish(spark.range(5).selectExpr("cast(id AS string) AS n"), path, "csv")
    # a stray file beside them is not read
    (tmp_path / "out" / manifest.run / "part-stray.csv").write_text("n\n7\n")
    assert publish.read_published(spark, path).count() == 5
    with (tmp_path / "out" / manifest.files[-1].name).open("a") as file:
        file.write("9\n")
    with pytest.raises(ValueError, match="published"):
        publish.read_published(spark, path)


def test_no_rows(spark, tmp_path):
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / kind)
        assert publish.publish(spark.range(0).toDF("n"), path, kind).rows == 0
        assert publish.read_published(spark, path).collect() == []


def test_job_that_labels_by_accidents(spark, tmp_path, monkeypatch, capsys):
    txn = tables.txn_events(spark, SF)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    csv.write_csv(txn, source)
    monkeypatch.setattr("sys.argv", ["job", source, out, "--by-day"])
    label.main()
    want = inject.inject_accidents(txn)
    got = publish.read_published(spark, f"{out}/payments")
    same = [c for c in want.columns if c not in ("timestamp", "amount")]
    assert got.select(same).exceptAll(want.select(same)).count() == 0 and got.count() == want.count()
    flags = F.col("is_accident_burst") + F.col("is_high_amount_accident") + F.col("is_mistyped_entity_accident")
    assert got.where((flags > 0) != (F.col("target_accident") == 1)).count() == 0
    mistyped = publish.read_published(spark, f"{out}/mistyped")
    assert mistyped.count() == want.where("is_mistyped_entity_accident = 1").count()
    assert "payments:" in capsys.readouterr().out
    assert any(p.name.startswith("day=") for p in pathlib.Path(out, "payments").glob("run-*/*"))


def test_job_that_labels_by_rules(spark, tmp_path, monkeypatch):
    bank, phones = tables.bank_events(spark, SF), tables.expected_phones(spark, SF)
    source, expected, out = (str(tmp_path / n) for n in ("in", "phones", "out"))
    bank.write.parquet(source)
    csv.write_csv(phones, expected)
    monkeypatch.setattr("sys.argv", ["job", source, out, "--format", "parquet", "--expected", expected, "--output-format", "parquet"])
    label.main()
    changed = inject.inject_phones(inject.inject_locations(bank, label.BANK_CITIES), base=bank)
    want = labels.rule_label(changed, phones, 5, bank).select("transaction_id", "is_accident", "receiver_phone", "city")
    got = publish.read_published(spark, f"{out}/payments")
    assert rows_of(got.select(want.columns)) == rows_of(want)
    counts = publish.read_published(spark, f"{out}/counts").first()
    assert counts["accidents"] == want.where("is_accident").count() > 0
