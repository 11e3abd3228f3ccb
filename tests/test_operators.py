"""Profiling, joins, labels, injection, sampling and evaluation on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.constants import CITY_POPULATION, FLAGS
from txnlens.functions.text import differs, normalize_phone, percent_text, risk_band
from txnlens.operators import evaluate, inject, joins, labels, model, profile, sampling
from txnlens.schema import canonical, ensure_columns, normalize


def test_phone_and_risk_bounds(spark):
    row = spark.range(1).select(normalize_phone(F.lit("+1 (555) 123-4567")).alias("p")).first()
    assert row.p == "+15551234567"
    df = spark.createDataFrame([(0.8,), (0.6,), (0.5999,), (0.89,), (0.72,), (0.45,)], "p double")
    bands = [r[0] for r in df.select(risk_band("p")).collect()]
    assert bands == ["High", "Medium", "Low", "High", "Medium", "Low"]
    assert df.select(percent_text(F.col("p"))).first()[0] == "80.0%"


def test_missing_values_differ(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(differs(F.col("x"), F.col("y"))).collect()] == [False, True, True, True]


def test_ensure_columns(spark):
    df = canonical(spark.createDataFrame([("2024-03-01 10:00:00", "12.5")], "timestamp string, amount string"))
    row = df.first()
    assert (row.customer_id, row.recipient_entity, row.city) == (
        "default_customer",
        "default_recipient",
        "default_city",
    )
    assert row.amount == 12.5 and [row[f] for f in FLAGS] == [0, 0, 0]
    with pytest.raises(ValueError):
        ensure_columns(spark.createDataFrame([("x",)], "customer_id string"))


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0), ("A", float("nan"))], "customer_id string, amount double")
    rows = {r.customer_id: r.amount for r in canonical(df).collect()}
    assert rows == {"default_customer": 1.0, "A": None}


def test_flags_from_text(spark):
    df = spark.createDataFrame([("True",), ("False",), (None,), ("1",)], "is_accident_burst string")
    assert [r[0] for r in normalize(df).collect()] == [1, 0, 0, 1]


def test_bad_text_stops_or_becomes_null(spark):
    df = spark.createDataFrame([("no time", "x")], "timestamp string, amount string")
    with pytest.raises(Exception):
        normalize(df).collect()
    assert tuple(normalize(df, strict=False).first()) == (None, None)


def test_weeks_start_on_monday(payments):
    df = payments([("A", "1", "2024-01-07 10:00:00", 1.0), ("A", "2", "2024-01-08 10:00:00", 1.0)])
    weeks = {str(r.week) for r in profile.txn_per_week(df).collect()}
    assert weeks == {"2024-01-01", "2024-01-08"}


@pytest.mark.parametrize("rows", [1, 2, 5, 1000])
def test_quartiles_are_exact(spark, rows):
    rng = random.Random(rows)
    values = [rng.choice([1.0, 2.0, rng.random() * 100]) for _ in range(rows)]
    df = spark.createDataFrame([(v,) for v in values], "amount double").repartition(3)
    got = profile.number_summary(df).first()
    for name, q in [("p25", 25), ("p50", 50), ("p75", 75)]:
        assert got[name] == pytest.approx(np.percentile(values, q))


@pytest.mark.parametrize("hot", [False, True])
def test_order_statistic_by_narrowing(spark, hot):
    rng = random.Random(5)
    values = [1.0 if hot and i % 2 else round(rng.random() * 1000, 2) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "amount double").repartition(4)
    ordered = sorted(values)
    for rank in (0, 749, 1500, 2999):
        found = profile.order_statistic(df, "amount", 3000, rank, accuracy=100).first()[0]
        assert found == ordered[rank]



def test_summary_reads_the_table_three_times(spark):
    """At any size and accuracy; a bracket that misses its rank takes in everything."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = random.Random(6)
    for amounts in ([rng.gauss(0, 9) for _ in range(5000)], [float(rng.randint(0, 3)) for _ in range(4001)], [7.0], [1.0, 2.0], [1.0] * 999 + [None]):
        table = spark.createDataFrame([(a,) for a in amounts], "amount double").repartition(5)
        for accuracy in (50, 10_000):
            before = read.value
            got = profile.number_summary(table.mapInArrow(count, "amount double"), accuracy=accuracy).first()
            assert read.value - before == 3 * len(amounts)
            filled = sorted(a for a in amounts if a is not None)
            want = np.quantile(filled, [0.25, 0.5, 0.75])
            assert [got["p25"], got["p50"], got["p75"]] == pytest.approx(list(want))
            assert (got["count"], got["min"], got["max"]) == (len(filled), filled[0], filled[-1])
        values = profile.order_statistics(table, "amount", [(1e9, 2e9), None], [[0], [len(filled) - 1]])
        assert {(r.bracket, r.value) for r in values.collect()} == {(0, filled[0]), (1, filled[-1])}


def test_summary_of_nothing(spark):
    row = profile.number_summary(spark.createDataFrame([], "amount double")).first()
    assert row["count"] == 0 and row["p50"] is None


def test_one_hot_leaves_out_the_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "city string")
    coded = profile.one_hot(df, ["city"])
    assert coded.columns == ["city_b"]
    assert sorted(r[0] for r in coded.collect()) == [0, 0, 1]


@pytest.mark.parametrize("join_rows", [1_000_000, 10])
def test_join_by_key_with_a_crowded_key(spark, join_rows):
    rows = [("busy", i) for i in range(200)] + [("b", i) for i in range(5)] + [(None, 1), ("c", 1)]
    df = spark.createDataFrame(rows, "customer_id string, amount int")
    stats = (
        df.where("customer_id <> 'c'")
        .groupBy("customer_id")
        .agg(F.avg("amount").alias("mean"), F.count("*").alias("_rows"))
    )
    joined = joins.join_by_key(df, stats, "customer_id", "_rows", join_rows)
    assert joined.count() == len(rows)
    means = {r.customer_id: r["mean"] for r in joined.distinct().collect()}
    assert means == {"busy": 99.5, "b": 2.0, "c": None, None: None}


def test_sample_has_exact_size_and_does_not_move(payments):
    df = payments([("A", f"{i:04d}", "2024-01-01", 1.0) for i in range(1000)])
    one = {r.transaction_id for r in sampling.sample_rows(df, share=0.037).collect()}
    two = {r.transaction_id for r in sampling.sample_rows(df.repartition(7), share=0.037).collect()}
    assert len(one) == 37 and one == two
    assert sampling.sample_rows(df, share=0.0).count() == 0
    assert sampling.sample_rows(df, share=1.0).count() == 1000


def test_split_keeps_label_shares(spark):
    rows = [(f"{i}", int(i % 10 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "transaction_id string, target_accident int")
    split = sampling.stratified_split(df).groupBy("target_accident", "is_test").count()
    assert {(r[0], r[1]): r[2] for r in split.collect()} == {
        (0, True): 180,
        (0, False): 720,
        (1, True): 20,
        (1, False): 80,
    }


@pytest.mark.parametrize("crowded,chunk", [(20_000, 1_000_000), (0, 3)])
def test_burst_groups(payments, crowded, chunk):
    at = [0, 3, 8, 8, 30, 34.9, 60]
    rows = [("A", str(i), f"2024-01-01 00:00:{t:09.6f}", 1.0) for i, t in enumerate(at[:-1])]
    rows += [("A", "7", "2024-01-01 00:01:00", 1.0), ("B", "8", "2024-01-01 00:00:01", 1.0)]
    groups = labels.burst_groups(payments(rows), 5, crowded, chunk).collect()
    found = {(str(g.started_at)[17:19], str(g.ended_at)[17:19], g.payments) for g in groups}
    assert found == {("00", "08", 4), ("30", "34", 2)}


def test_typo_candidates_against_all_pairs(payments):
    rng = random.Random(9)
    base = ["".join(rng.choice("0123456789") for _ in range(6)) for _ in range(4)] + ["12", "1", "77"]
    numbers = set(base)
    for number in base * 4:
        digits = list(number)
        for _ in range(rng.choice([1, 2, 3])):
            digits[rng.randrange(len(digits))] = rng.choice("0123456789")
        numbers.add("".join(digits))
    numbers = sorted(numbers)
    rng.shuffle(numbers)
    rows = [("A", str(i), f"2024-01-01 00:{i:02d}:00", 1.0, n) for i, n in enumerate(numbers)]
    rows += [("B", "b", "2023-01-01 00:00:00", 1.0, numbers[0]), ("A", "x", "2024-01-01", 1.0, "Shop")]
    found = labels.typo_candidates(payments(rows))
    got = [(r.customer_id, r.likely_recipient, r.recipient_entity, r.digits_off) for r in found.collect()]
    want = [
        ("A", old, new, sum(a != b for a, b in zip(old, new, strict=True)))
        for i, old in enumerate(numbers)
        for new in numbers[i + 1 :]
        if len(old) == len(new) > 1 and sum(a != b for a, b in zip(old, new, strict=True)) <= 2
    ]
    assert sorted(got) == sorted(want) and len(want) > 10


def _injectable(payments):
    rows = [
        (f"c{i % 7}", f"{i:05d}", f"2024-01-01 {i % 24:02d}:00:00", 10.0, "1000000123" if i % 2 else "Shop")
        for i in range(3000)
    ]
    return payments(rows).withColumns(
        {
            "transaction_type": F.lit("Venmo/PayPal Transfer"),
            "entity_type": F.lit("Person-to-Person"),
            "original_recipient_entity": F.col("recipient_entity"),
        }
    )


def test_injection_leaves_other_rows_alone(payments):
    txn = _injectable(payments)
    out = inject.inject_accidents(txn)
    clean = out.where(" and ".join(f"{f} = 0" for f in FLAGS))
    same = [c for c in txn.columns if c not in FLAGS]
    assert clean.select(same).exceptAll(txn.select(same)).count() == 0
    kinds = out.select(sum(F.col(f) for f in FLAGS).alias("k")).agg(F.max("k")).first()[0]
    assert kinds == 1
    parents = out.where("not transaction_id like '%-A%'")
    assert parents.count() == 3000


def test_injected_children_follow_within_seconds(payments):
    out = inject.inject_bursts(_injectable(payments)).toPandas()
    children = out[out.transaction_id.str.contains("-A")].copy()
    assert len(children) > 50
    children["parent"] = children.transaction_id.str[:5]
    start = out.set_index("transaction_id")["timestamp"]
    for _, group in children.groupby("parent"):
        times = [start[group.parent.iloc[0]], *group.sort_values("transaction_id").timestamp]
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:], strict=False)]
        assert all(0.0099 <= g <= 5.0 for g in gaps) and 1 <= len(group) <= 3
    assert set(children.is_accident_burst) == {1}


def test_injected_typos_change_one_or_two_digits(payments):
    out = inject.mark_typos(_injectable(payments).repartition(3))
    hit = out.where("is_mistyped_entity_accident = 1").collect()
    assert hit
    for row in hit:
        off = [(a, b) for a, b in zip(row.original_recipient_entity, row.recipient_entity, strict=True) if a != b]
        assert row.original_recipient_entity == "1000000123" and len(off) <= 2
        for a, b in off:
            assert (int(b) - int(a)) % 10 in {1, 2, 3, 4, 5, 6, 7, 8, 9}


def test_locations_change_to_another_city(payments):
    df = payments([("A", f"{i:04d}", "2024-01-01", 1.0, "R", "Boston") for i in range(200)])
    out = inject.inject_locations(df, list(CITY_POPULATION), share=0.1).collect()
    assert sum(r.is_location_anomaly for r in out) == 20
    assert all((r.city != "Boston") == r.is_location_anomaly for r in out)


def test_usual_city_is_mostly_home(payments):
    df = payments([(f"c{i % 50}", f"{i:05d}", "2024-01-01", 1.0) for i in range(4000)])
    out = inject.with_usual_city(df).withColumn("home", inject.home_city())
    share = out.agg(F.avg((F.col("city") == F.col("home")).cast("int"))).first()[0]
    assert 0.78 < share < 0.92 and out.where("city is null").count() == 0


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "target_accident int, predicted_accident int")


def test_confusion_and_recall(spark):
    df = _scored(spark, [(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)])
    cells = {(r.actual, r.predicted): r.n for r in evaluate.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    assert evaluate.recall(df).first().recall == 0.6667
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["1"].precision == 1.0 and report["0"].recall == 1.0
    assert report["accuracy"].f1 == 0.8 and report["weighted avg"].support == 5


def test_no_positives_is_no_error(spark):
    df = _scored(spark, [(0, 0)])
    assert evaluate.recall(df).first().recall == 0.0
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["1"].precision == 0.0 and report["1"].support == 0


def test_scale_ignores_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scale = model.fit_scale(df, ["a", "b"])
    rows = sorted(tuple(r) for r in scale.apply(df).collect())
    assert rows == [(-1.0, 0.0), (1.0, 0.0)]


def test_na_policies(spark):
    from txnlens.constants import FEATURES

    schema = ", ".join(f"{c} double" for c in FEATURES)
    values = [1.0] * len(FEATURES)
    df = spark.createDataFrame([tuple(values), (None, *values[1:])], schema)
    assert model.model_rows(df, "drop").count() == 1
    assert sorted(r.amount for r in model.model_rows(df, "impute").collect()) == [0.0, 1.0]
    with pytest.raises(ValueError):
        model.model_rows(df, "guess")


def test_times_in_other_forms(spark):
    from txnlens.schema import canonical

    raw = spark.createDataFrame([("1", "31/01/2024 05:06", 1.0), ("2", "soon", 2.0)], "transaction_id string, timestamp string, amount double")
    got = canonical(raw, strict=False, timestamp_format="dd/MM/yyyy HH:mm").orderBy("transaction_id").collect()
    assert str(got[0]["timestamp"]) == "2024-01-31 05:06:00" and got[1]["timestamp"] is None


def test_csv_files_in_any_case(spark, tmp_path):
    from txnlens.sources.csv import read_transactions

    folder = tmp_path / "payments.v2"
    folder.mkdir()
    (folder / "a.csv").write_text("transaction_id,amount\n1,1.0\n")
    (folder / "b.CSV").write_text("transaction_id,amount\n2,2.0\n")
    (folder / "notes.txt").write_text("none")
    assert read_transactions(spark, str(folder)).count() == 2
    with pytest.raises(ValueError, match="not a CSV file"):
        read_transactions(spark, str(folder / "notes.txt"))
