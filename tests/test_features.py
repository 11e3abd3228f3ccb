"""Hand-computed cases of the history features, on plain rows and on rows cut into chunks."""

import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from txnlens.constants import FEATURES, LABEL
from txnlens.operators.features import add_features

# (crowded_rows, chunk_rows): no customer is crowded, or all are and chunks hold two rows
PATHS = {"plain": (20_000, 1_000_000), "chunks": (0, 2)}


@pytest.fixture(params=list(PATHS))
def featured(request, payments):
    crowded, chunk = PATHS[request.param]
    return lambda rows, **more: add_features(payments(rows), crowded_rows=crowded, chunk_rows=chunk, **more)


def test_day_frame_is_half_open(featured, by_id):
    df = featured(
        [
            ("A", "1", "2024-01-01 12:00:00", 10.0),
            ("A", "2", "2024-01-02 12:00:00", 30.0),
            ("B", "3", "2024-01-01 12:00:00", 10.0),
            ("B", "4", "2024-01-02 11:59:59.999999", 30.0),
        ]
    )
    assert by_id(df, "mean_24hr") == {"1": 10.0, "2": 30.0, "3": 10.0, "4": 20.0}
    assert by_id(df, "stddev_30day")["1"] is None
    assert by_id(df, "stddev_30day")["2"] == pytest.approx(statistics.stdev([10, 30]))


def test_week_maximum(featured, by_id):
    df = featured(
        [
            ("A", "1", "2024-01-01 00:00:00", 90.0),
            ("A", "2", "2024-01-07 23:59:59", 10.0),
            ("A", "3", "2024-01-08 00:00:00", 20.0),
        ]
    )
    assert by_id(df, "max_amount_7day") == {"1": 90.0, "2": 90.0, "3": 20.0}


def test_gap_and_no_leak_between_customers(featured, by_id):
    df = featured(
        [
            ("A", "1", "2024-01-01 00:00:00", 1.0, "R"),
            ("A", "2", "2024-01-01 00:00:01.5", 2.0, "R"),
            ("A", "3", "2024-01-01 00:00:01.5", 3.0, "R"),
            ("B", "4", "2024-01-01 00:00:02", 4.0, "R"),
        ]
    )
    assert by_id(df, "time_since_last_txn") == {"1": -1.0, "2": 1.5, "3": 0.0, "4": -1.0}
    assert by_id(df, "mean_amount_rolling") == {"1": None, "2": 1.0, "3": 1.5, "4": None}


def test_recipient_history(featured, by_id):
    df = featured([("A", str(i), f"2024-01-0{i} 10:00:00", float(i), "R") for i in (1, 2, 3)])
    assert by_id(df, "mean_amount_rolling") == {"1": None, "2": 1.0, "3": 1.5}
    std = by_id(df, "std_amount_rolling")
    assert std["1"] is None and std["2"] is None
    assert std["3"] == pytest.approx(statistics.stdev([1, 2]))
    assert by_id(df, "amount_deviation_rolling")["3"] == pytest.approx(1.5 / statistics.stdev([1, 2]))
    assert by_id(df, "amount_deviation_rolling")["1"] == 0.0


def test_only_thirty_earlier_payments_count(featured, by_id):
    rows = [
        ("A", f"{i:02d}", f"2024-01-01 00:{i:02d}:00", 1000.0 if i == 0 else float(i), "R")
        for i in range(32)
    ]
    mean = by_id(featured(rows), "mean_amount_rolling")
    assert mean["30"] == pytest.approx((1000 + sum(range(1, 30))) / 30)
    assert mean["31"] == pytest.approx(sum(range(1, 31)) / 30)


def test_constant_amounts_have_no_deviation(featured, by_id):
    rows = [("A", str(i), f"2024-01-0{i} 00:00:00", 1000.01, "R") for i in range(1, 6)]
    df = featured(rows)
    assert set(by_id(df, "amount_deviation_rolling").values()) == {0.0}
    assert by_id(df, "stddev_30day")["5"] == 0.0


def test_repeats_within_a_minute(featured, by_id):
    at = ["00:00:00", "00:00:00", "00:01:00", "00:02:00.000001"]
    df = featured([("A", str(i), f"2024-01-01 {t}", 5.0, "R") for i, t in enumerate(at)])
    flag = "is_duplicate_transaction_within_X_minutes"
    assert by_id(df, flag) == {"0": 0, "1": 0, "2": 1, "3": 0}
    longer = featured(
        [("A", str(i), f"2024-01-01 {t}", 5.0, "R") for i, t in enumerate(at)], duplicate_minutes=2
    )
    assert by_id(longer, flag) == {"0": 0, "1": 0, "2": 1, "3": 1}


def test_ties_at_first_payment_are_all_new(featured, by_id):
    df = featured(
        [
            ("A", "1", "2024-01-01 00:00:00", 1.0, "R"),
            ("A", "2", "2024-01-01 00:00:00", 2.0, "R"),
            ("A", "3", "2024-01-01 00:00:01", 3.0, "R"),
        ]
    )
    assert by_id(df, "is_new_recipient") == {"1": 1, "2": 1, "3": 0}


def test_first_time_in_a_city(featured, by_id):
    df = featured(
        [("A", str(i), f"2024-01-0{i + 1} 00:00:00", 1.0, "R", c) for i, c in enumerate("XXYX")]
    )
    assert by_id(df, "is_unusual_location_for_user") == {"0": 1, "1": 0, "2": 1, "3": 0}


def test_time_of_day_is_not_circular(featured, by_id):
    df = featured(
        [("A", "1", "2024-01-01 23:59:50", 1.0, "R"), ("A", "2", "2024-01-03 00:00:10", 1.0, "R")]
    )
    assert by_id(df, "time_deviation_from_user_norm") == {"1": None, "2": 86_380.0}


def test_weekday_starts_on_monday(featured, by_id):
    df = featured([("A", "1", "2024-01-01 05:00:00", 1.0), ("A", "2", "2024-01-07 05:00:00", 1.0)])
    assert by_id(df, "day_of_week") == {"1": 0, "2": 6}
    assert by_id(df, "is_weekend") == {"1": 0, "2": 1}


def _random_payments(payments, seed, rows=400):
    import random

    rng = random.Random(seed)
    made = []
    for i in range(rows):
        who = "busy" if rng.random() < 0.6 else f"c{rng.randrange(4)}"
        # coarse and fine steps, so rows tie, fall into the same second and sit on frame edges
        us = rng.choice([0, 1, 86_400_000_000, 30 * 86_400_000_000, 7 * 86_400_000_000]) * rng.randrange(3)
        us += rng.choice([0, 0, 1, 999_999, 1_000_000, 60_000_000, 3_600_000_000]) * rng.randrange(5)
        day, rest = divmod(us, 86_400_000_000)
        hour, rest = divmod(rest, 3_600_000_000)
        minute, rest = divmod(rest, 60_000_000)
        second, micro = divmod(rest, 1_000_000)
        month, dom = divmod(day, 28)
        made.append(
            (
                who,
                f"{i:05d}",
                f"2024-{month + 1:02d}-{dom + 1:02d} {hour:02d}:{minute:02d}:{second:02d}.{micro:06d}",
                rng.choice([1.0, 2.5, 99.99, 1000.01]),
                rng.choice("RST"),
                rng.choice("XYZ"),
            )
        )
    return payments(made)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowded,chunk", [(0, 7), (100, 40)])
def test_chunks_change_nothing(payments, seed, crowded, chunk):
    txn = _random_payments(payments, seed)
    columns = ["transaction_id", *FEATURES, LABEL]
    plain = add_features(txn).select(columns).orderBy("transaction_id").toPandas()
    split = add_features(txn, crowded_rows=crowded, chunk_rows=chunk)
    split = split.select(columns).orderBy("transaction_id").toPandas()
    assert len(plain) == len(split) == 400
    for name in [*FEATURES, LABEL]:
        assert (plain[name].isna() == split[name].isna()).all(), name
        assert (plain[name].astype(float) - split[name].astype(float)).abs().max() < 1e-6, name


@pytest.mark.parametrize("base", [1e4, 1e6, 1e8, 1e9])
def test_deviation_of_large_amounts(payments, by_id, base):
    """Cents of spread on a large amount, with chunks, against exact arithmetic."""
    amounts = [base + 0.01 * (i % 7) for i in range(60)]
    rows = [("A", f"{i:02}", f"2024-01-{1 + i // 3:02} 0{i % 3}:00:0{i % 5}", a) for i, a in enumerate(amounts)]
    got = by_id(add_features(payments(rows), crowded_rows=0, chunk_rows=7), "stddev_30day")
    for i in range(1, 60):
        exact = float(statistics.variance(map(Fraction, amounts[: i + 1]))) ** 0.5
        assert got[f"{i:02}"] == pytest.approx(exact, rel=1e-9)


def test_days_meet_seconds_not_moments(payments):
    """A customer's day has any number of moments, so no join by day may hold them."""
    from txnlens.functions.calendar import micros
    from txnlens.operators.skew import chunked
    from txnlens.operators.spans import span_columns

    rows = chunked(_random_payments(payments, 6).withColumn("_us", micros()), 400, 50)
    plan = span_columns(rows)._jdf.queryExecution().optimizedPlan().toString()
    by_day = [line for line in plan.splitlines() if "Join" in line and "_day" in line]
    assert by_day and not any("_us" in line for line in by_day)
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Join" in line and "_day" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = [x for x in lines[at + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert not any("m0" in x for x in below)


def test_many_crowded_customers(payments, monkeypatch):
    from txnlens.operators import skew

    txn = _random_payments(payments, 8, 150)
    plain = add_features(txn).orderBy("transaction_id").collect()
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 1)
    split = add_features(txn, crowded_rows=10, chunk_rows=30).orderBy("transaction_id").collect()
    exact = ["transaction_id", "time_since_last_txn", "mean_amount_rolling", "is_new_recipient"]
    assert [[r[c] for c in exact] for r in plain] == [[r[c] for c in exact] for r in split]


def test_a_payment_without_time_is_an_error(payments):
    txn = payments([("A", "1", None, 1.0), ("A", "2", "2024-01-01", 1.0)])
    with pytest.raises(Exception, match="no timestamp"):
        add_features(txn).collect()


def test_order_of_input_rows_does_not_matter(payments):
    txn = _random_payments(payments, 3)
    one = add_features(txn).orderBy("transaction_id").collect()
    other = add_features(txn.orderBy(F.rand(1)).repartition(5)).orderBy("transaction_id").collect()
    assert one == other


def test_later_rows_do_not_change_earlier_ones(payments):
    txn = _random_payments(payments, 4)
    cut = "2024-02-01"
    early = add_features(txn.where(F.col("timestamp") < cut)).orderBy("transaction_id").collect()
    full = add_features(txn).where(F.col("timestamp") < cut).orderBy("transaction_id").collect()
    assert early == full


def test_one_shuffle_and_no_python(payments):
    plan = add_features(_random_payments(payments, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(customer_id") == 1
    assert plan.count("Exchange") == 1
    assert "Python" not in plan and "ArrowEval" not in plan


def test_span_frames_of_chunks_use_no_moving_frame(payments):
    from txnlens.functions.calendar import micros
    from txnlens.operators.skew import chunked
    from txnlens.operators.spans import span_columns

    rows = chunked(_random_payments(payments, 6).withColumn("_us", micros()), 400, 50)
    plan = span_columns(rows)._jdf.queryExecution().executedPlan().toString()
    moving = [line for line in plan.split("\n") if "RangeFrame" in line]
    # only the frame over whole days moves
    assert moving and all("_pos" in line and "-86400000000)" in line for line in moving)


def test_chunks_are_bounded_and_in_time_order(payments):
    from txnlens.functions.calendar import micros
    from txnlens.operators.skew import chunked

    rows = chunked(_random_payments(payments, 7).withColumn("_us", micros()), 400, 50)
    pdf = rows.toPandas().sort_values(["customer_id", "_us", "transaction_id"])
    assert pdf.groupby("_chunk").size().max() <= 150
    assert pdf.groupby("customer_id")["_chunk"].apply(lambda c: c.is_monotonic_increasing).all()
    assert pdf[pdf.customer_id == "busy"]["_chunk"].nunique() > 2


def test_partitions_follow_rows_not_chunks(payments):
    """Each partition sends the driver a sample and a report, so small chunks mustn't be partitions of their own."""
    from txnlens.functions.calendar import micros
    from txnlens.operators.skew import chunked

    rows = chunked(_random_payments(payments, 7).withColumn("_us", micros()), 400, 5)
    assert len(rows.inputFiles()) <= 2
    sizes = rows.groupBy("_chunk").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) == 5
